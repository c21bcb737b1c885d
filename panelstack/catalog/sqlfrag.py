"""DuckDB SQL fragments shared by the oracle texts."""

from __future__ import annotations

from collections.abc import Sequence

KEYS = ("model", "scenario", "region")
VARS = ("economy", "large", "medium", "promo", "small", "standard")
TARGETS = ("economy", "large", "medium")


def part_by(keys=KEYS) -> str:
    return "PARTITION BY " + ", ".join(keys)


def interp_select(src: str, cols: Sequence[str], all_cols: Sequence[str], keys=KEYS,
                  time: str = "year") -> str:
    """SELECT that linearly interpolates ``cols`` of ``src`` (clamped edges)."""
    w_b = f"({part_by(keys)} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_f = f"({part_by(keys)} ORDER BY {time} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    inner = []
    for c in cols:
        inner += [
            f"last_value(CASE WHEN {c} IS NOT NULL THEN {time} END IGNORE NULLS) OVER {w_b} AS _pt_{c}",
            f"last_value({c} IGNORE NULLS) OVER {w_b} AS _pv_{c}",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN {time} END IGNORE NULLS) OVER {w_f} AS _nt_{c}",
            f"first_value({c} IGNORE NULLS) OVER {w_f} AS _nv_{c}",
        ]
    outer = []
    for c in all_cols:
        if c in cols:
            outer.append(
                f"CASE WHEN {c} IS NOT NULL THEN CAST({c} AS DOUBLE) WHEN _pt_{c} IS NULL THEN _nv_{c} "
                f"WHEN _nt_{c} IS NULL THEN _pv_{c} "
                f"ELSE _pv_{c} + (_nv_{c} - _pv_{c}) / CAST(_nt_{c} - _pt_{c} AS DOUBLE) "
                f"* CAST({time} - _pt_{c} AS DOUBLE) END AS {c}")
        else:
            outer.append(c)
    return (f"SELECT {', '.join(outer)} FROM (SELECT *, {', '.join(inner)} FROM {src}) AS _i")


def lags_select(src: str, cols: Sequence[str], n: int, keys=KEYS, time: str = "year") -> str:
    lags = []
    for k in range(1, n + 1):
        for c in cols:
            name = f"prev_{c}" if k == 1 else f"prev{k}_{c}"
            lags.append(f"lag({c}, {k}) OVER ({part_by(keys)} ORDER BY {time}) AS {name}")
    return f"SELECT *, {', '.join(lags)} FROM {src}"


def stack_sql(src: str, truth: Sequence[str], pred: Sequence[str], keep: Sequence[str] = (),
              names: Sequence[str] | None = None) -> str:
    names = list(names) if names is not None else list(truth)
    k = "".join(f"{c}, " for c in keep)
    return "\nUNION ALL\n".join(
        f"SELECT {k}'{n}' AS target, CAST({t} AS DOUBLE) AS y, CAST({p} AS DOUBLE) AS p FROM {src} "
        f"WHERE {t} IS NOT NULL AND {p} IS NOT NULL"
        for n, t, p in zip(names, truth, pred))


def metric_aggs(n_targets: int) -> str:
    return f"""avg((y - p) * (y - p)) AS mse,
  CASE WHEN count(*) > 1 AND var_pop(y) > 0 AND var_pop(p) > 0 THEN corr(y, p) END AS pearson,
  1.0 - CASE WHEN var_pop(y) * count(*) <> 0 THEN sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2,
  avg(abs(y - p)) AS mae,
  sqrt(avg((y - p) * (y - p))) AS rmse,
  CAST(count(*) / {n_targets} AS BIGINT) AS sample_size"""


REGION_TYPE_SQL = ("CASE WHEN starts_with(region, 'R10') THEN 'R10' WHEN starts_with(region, 'R6') THEN 'R6' "
                   "WHEN starts_with(region, 'R5') THEN 'R5' WHEN starts_with(region, 'World') THEN 'World' "
                   "ELSE 'ISO' END")
REGION_SCALE_SQL = ("CASE WHEN starts_with(region, 'World') THEN 'World' WHEN starts_with(region, 'R5') THEN 'R5' "
                    "WHEN starts_with(region, 'R6') THEN 'R6' WHEN starts_with(region, 'R10') THEN 'R10' "
                    "ELSE 'ISO3' END")
MODEL_FAMILY_SQL = "regexp_extract(model, '^[^_/ -]*', 0)"

METRIC_DOUBLES = ("mse", "pearson", "r2", "mae", "rmse")


def metrics_by_region_type_sql(src: str, truth, pred) -> str:
    stacked = stack_sql(f"(SELECT *, {REGION_TYPE_SQL} AS _rt FROM {src})", truth, pred, keep=["_rt"])
    return f"""SELECT CASE WHEN grouping(_rt) = 1 THEN 'Overall' ELSE _rt END AS region_type,
  {metric_aggs(len(truth))}
FROM ({stacked}) AS s GROUP BY ROLLUP (_rt)"""


def rank_sql(src: str, keys=KEYS, seed=0) -> str:
    """Distinct keys of ``src`` ranked by md5(seed|keys) then keys, with group count n."""
    k = ", ".join(keys)
    return (f"SELECT {k}, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {k})), {k}) - 1 AS rank, "
            f"count(*) OVER () AS n FROM (SELECT DISTINCT {k} FROM {src}) AS _d")


def split_case(test=0.1, val=0.1) -> str:
    nt = f"floor(n * {test})"
    nv = f"floor(n * {val})"
    return (f"CASE WHEN rank < n - {nt} - {nv} THEN 'train' WHEN rank < n - {nt} THEN 'val' "
            f"ELSE 'test' END")


def split_sql(src: str, keys=KEYS, seed=0, test=0.1, val=0.1) -> str:
    """Rows of ``src`` with a ``split`` column (train / val / test by whole series)."""
    on = " AND ".join(f"_s.{c} IS NOT DISTINCT FROM _r.{c}" for c in keys)
    return (f"SELECT _s.*, _r.split FROM {src} _s JOIN (SELECT *, {split_case(test, val)} AS split "
            f"FROM ({rank_sql(src, keys, seed)}) _k) _r ON {on}")


def unpivot_sql(src: str, cols, keep=(), where: str = "", feature: str = "feature",
                value: str = "value") -> str:
    k = "".join(f"{c}, " for c in keep)
    w = f" WHERE {where}" if where else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS {feature}, CAST({c} AS DOUBLE) AS {value} FROM {src}{w}" for c in cols)


def nn(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def short_number_sql(v: str) -> str:
    def fmt(x, suffix):
        return (f"(CASE WHEN {x} = floor({x}) THEN printf('%.0f', {x}) "
                f"ELSE printf('%.1f', CAST(round(CAST({x} AS DECIMAL(38,6)), 1) AS DOUBLE)) END) || '{suffix}'")
    return (f"CASE WHEN abs({v}) >= 1e6 THEN {fmt(f'({v} / 1e6)', 'M')} "
            f"WHEN abs({v}) >= 1e3 THEN {fmt(f'({v} / 1e3)', 'k')} "
            f"WHEN {v} = 0 THEN '0' ELSE {fmt(v, '')} END")


def feature_label_sql(f: str) -> str:
    """Label of a feature name: its stem, the years it looks back, and a note for missing flags."""
    parts = (f"regexp_extract({f}, '^(timestep_([0-9]+)_)?(prev([0-9]*)_)?(.+?)(_is_missing)?$', "
             "['at', 'step', 'back', 'lag', 'stem', 'flag'])")
    return (f"(SELECT x.stem || CASE WHEN x.back <> '' THEN ' (last ' || 5 * CAST(if(x.lag = '', '1', x.lag) AS INT) || 'y)' "
            f"WHEN x.at <> '' AND CAST(x.step AS INT) > 0 THEN ' (last ' || 5 * CAST(x.step AS INT) || 'y)' "
            f"ELSE ' (current)' END || if(x.flag <> '', ' N/A', '') FROM (SELECT {parts} AS x))")
