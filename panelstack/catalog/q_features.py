"""Per-series feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import region_scale
from ..operators import encode as E
from ..operators import features as D
from ..operators.split import split_by_series
from ..plans.base import KEYS, TARGETS, VARS, POP, quarterly_wide, ragged_wide, yearly_wide
from ..plans.prepare import prepare_sequence, prepare_tabular
from ..session import materialize
from ..sources.panels import with_panels
from . import register
from .sqlfrag import (REGION_SCALE_SQL, interp_select, lags_select, nn, split_sql, unpivot_sql)

INTERP = TARGETS + [POP]
FEATS = ["promo", "small", "standard"]
RP_COLS = list(KEYS) + ["year"] + VARS + ["region_scale"]
RP = with_panels("ragged_wide") + f", rp AS (SELECT *, {REGION_SCALE_SQL} AS region_scale FROM ragged_wide)"
QW = with_panels("quarterly_wide")
YW = with_panels("yearly_wide")
PART = "PARTITION BY model, scenario, region ORDER BY year"


def rp(spark, sf_dir):
    return ragged_wide(spark, sf_dir).withColumn("region_scale", region_scale("region"))


def rp_split(spark, sf_dir):
    # read by several passes (medians, imputation): materialise once
    return materialize(split_by_series(rp(spark, sf_dir), KEYS, 0.1, 0.1, seed=0))


@register("d1_interpolate", RP + f" {interp_select('rp', INTERP, RP_COLS)}", doubles=VARS)
def d1_interpolate(spark, sf_dir):
    return D.interpolate(rp(spark, sf_dir), INTERP, KEYS)


_RP2 = ", ".join(f"{c} AS _o_{c}" for c in INTERP)
_FR_COLS = list(KEYS) + ["year"] + INTERP + [f"_o_{c}" for c in INTERP]


@register("d1_fill_report", RP + f""",
rp2 AS (SELECT model, scenario, region, year, {', '.join(INTERP)}, {_RP2} FROM rp),
filled AS ({interp_select('rp2', INTERP, _FR_COLS)})
SELECT CAST(sum({' + '.join(f'CAST(_o_{c} IS NULL AS INT)' for c in INTERP)}) AS BIGINT) AS nulls_before,
       CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in INTERP)}) AS BIGINT) AS nulls_after,
       CAST(sum({' + '.join(f'CAST(_o_{c} IS NULL AS INT)' for c in INTERP)})
          - sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in INTERP)}) AS BIGINT) AS filled
FROM filled""")
def d1_fill_report(spark, sf_dir):
    return D.fill_report(rp(spark, sf_dir), INTERP, KEYS)


_PC = ", ".join(f"CASE WHEN standard > 0 THEN {t} / standard END AS {t}" for t in TARGETS)


@register("d2_per_capita", YW + f" SELECT model, scenario, region, year, {_PC}, promo, small, standard "
          "FROM yearly_wide", doubles=VARS)
def d2_per_capita(spark, sf_dir):
    return D.per_capita(yearly_wide(spark, sf_dir), TARGETS, POP)


_BACK = ", ".join(f"(CASE WHEN standard > 0 THEN {t} / standard END) * standard AS {t}" for t in TARGETS)


@register("d3_from_per_capita", YW + f" SELECT model, scenario, region, year, {_BACK}, promo, small, standard "
          "FROM yearly_wide", doubles=VARS)
def d3_from_per_capita(spark, sf_dir):
    return D.from_per_capita(D.per_capita(yearly_wide(spark, sf_dir), TARGETS, POP), TARGETS, POP)


_LAG_DOUBLES = VARS + [f"prev_{t}" for t in TARGETS] + [f"prev2_{t}" for t in TARGETS]


@register("d4_add_lags", QW + f" {lags_select('quarterly_wide', TARGETS, 2)}", doubles=_LAG_DOUBLES)
def d4_add_lags(spark, sf_dir):
    return D.add_lags(quarterly_wide(spark, sf_dir), TARGETS, 2, KEYS)


@register("d5_require_history", QW + f""", lagged AS ({lags_select('quarterly_wide', TARGETS, 2)})
SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2""",
          doubles=_LAG_DOUBLES)
def d5_require_history(spark, sf_dir):
    return D.require_history(D.add_lags(quarterly_wide(spark, sf_dir), TARGETS, 2, KEYS), 2, KEYS)


_D6 = RP + f", kept AS (SELECT * FROM rp WHERE {nn(TARGETS)})"


@register("d6_drop_missing_targets", _D6 + " SELECT * FROM kept", doubles=VARS)
def d6_drop_missing_targets(spark, sf_dir):
    return D.drop_missing(rp(spark, sf_dir), TARGETS)


@register("d7_add_step", _D6 + f" SELECT *, CAST(row_number() OVER ({PART}) - 1 AS BIGINT) AS step FROM kept",
          doubles=VARS)
def d7_add_step(spark, sf_dir):
    return D.add_step(D.drop_missing(rp(spark, sf_dir), TARGETS), KEYS)


@register("d8_add_delta_time", _D6 + f" SELECT *, CAST(coalesce(year - lag(year) OVER ({PART}), 0) AS INT) "
          "AS delta_years FROM kept", doubles=VARS)
def d8_add_delta_time(spark, sf_dir):
    return D.add_delta_time(D.drop_missing(rp(spark, sf_dir), TARGETS), KEYS)


@register("d9_min_context", _D6 + f""", stepped AS (SELECT *, CAST(row_number() OVER ({PART}) - 1 AS BIGINT) AS step,
  CAST(coalesce(year - lag(year) OVER ({PART}), 0) AS INT) AS delta_years FROM kept)
SELECT * FROM stepped WHERE step >= 3""", doubles=VARS)
def d9_min_context(spark, sf_dir):
    return D.min_context(D.add_step_and_delta(D.drop_missing(rp(spark, sf_dir), TARGETS), KEYS), 3)


@register("d10_missing_feature_rows", RP + """ SELECT count(*) AS rows,
  CAST(sum(CASE WHEN region IS NULL OR promo IS NULL OR small IS NULL OR standard IS NULL THEN 1 ELSE 0 END)
    AS BIGINT) AS rows_with_missing FROM rp""")
def d10_missing_feature_rows(spark, sf_dir):
    df = rp(spark, sf_dir)
    feats = D.feature_columns(df, ["model", "scenario", "region_scale", "year"], TARGETS)
    return D.missing_feature_rows(df, feats)


_FLAGS = ", ".join(f"CAST({f} IS NULL AS DOUBLE) AS {f}_is_missing" for f in FEATS)


@register("d11_add_missing_flags", RP + f" SELECT *, {_FLAGS} FROM rp",
          doubles=VARS + [f"{f}_is_missing" for f in FEATS])
def d11_add_missing_flags(spark, sf_dir):
    return D.add_missing_flags(rp(spark, sf_dir), ["region"] + FEATS, skip=["region"])


_MED = RP + f""", sp AS ({split_sql('rp')}),
tr AS (SELECT * FROM sp WHERE split = 'train'),
med AS (SELECT region_scale, feature, median(value) AS median
          FROM ({unpivot_sql('tr', FEATS, keep=['region_scale'])}) u WHERE value IS NOT NULL
          GROUP BY region_scale, feature
        UNION ALL
        SELECT CAST(NULL AS VARCHAR) AS region_scale, feature, median(value) AS median
          FROM ({unpivot_sql('tr', FEATS)}) u WHERE value IS NOT NULL GROUP BY feature)"""


@register("d12_fit_medians", _MED + " SELECT * FROM med", doubles=["median"])
def d12_fit_medians(spark, sf_dir):
    sp = rp_split(spark, sf_dir)
    return D.fit_medians(sp.where(F.col("split") == "train"), FEATS)


_PER = ", ".join(f"max(CASE WHEN feature = '{f}' THEN median END) AS m_{f}" for f in FEATS)
_GLOB = ", ".join(f"max(CASE WHEN feature = '{f}' THEN median END) AS g_{f}" for f in FEATS)
_IMP = ", ".join(f"coalesce(sp.{f}, per.m_{f}, gm.g_{f}, 0.0) AS {f}" for f in FEATS)


@register("d13_impute", _MED + f""",
per AS (SELECT region_scale, {_PER} FROM med WHERE region_scale IS NOT NULL GROUP BY region_scale),
gm AS (SELECT {_GLOB} FROM med WHERE region_scale IS NULL)
SELECT sp.model, sp.scenario, sp.region, sp.year, sp.economy, sp.large, sp.medium, {_IMP},
  sp.region_scale, sp.split
FROM sp LEFT JOIN per ON sp.region_scale = per.region_scale CROSS JOIN gm""", doubles=VARS)
def d13_impute(spark, sf_dir):
    sp = rp_split(spark, sf_dir)
    med = D.fit_medians(sp.where(F.col("split") == "train"), FEATS)
    return D.impute(sp, med, FEATS)


@register("d14_check_scale_coverage", RP + f""", sp AS ({split_sql('rp')})
SELECT DISTINCT region_scale FROM sp WHERE split <> 'train'
  AND region_scale NOT IN (SELECT region_scale FROM sp WHERE split = 'train')""")
def d14_check_scale_coverage(spark, sf_dir):
    sp = rp_split(spark, sf_dir)
    return D.check_scale_coverage(sp.where(F.col("split") == "train"), sp.where(F.col("split") != "train"))


_FF = ", ".join(
    f"last_value({f} IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {f}"
    for f in FEATS)


@register("d15_ffill_series", RP + f" SELECT model, scenario, region, year, economy, large, medium, {_FF}, "
          "region_scale FROM rp", doubles=VARS)
def d15_ffill_series(spark, sf_dir):
    return D.ffill_series(rp(spark, sf_dir), FEATS, KEYS)


_FM = ", ".join(f"coalesce(CAST({f} AS DOUBLE), -1.0) AS {f}" for f in FEATS)
_VALID = " AND ".join(f"coalesce(CAST({f} AS DOUBLE), -1.0) <> -1.0" for f in FEATS)


@register("d16_fill_mask", RP + f" SELECT model, scenario, region, year, economy, large, medium, {_FM}, "
          f"region_scale, ({_VALID}) AS row_valid FROM rp", doubles=VARS)
def d16_fill_mask(spark, sf_dir):
    return D.fill_mask(rp(spark, sf_dir), FEATS)


_CENTRE = ", ".join(f"coalesce(rp.{f}, c.m_{f}) AS {f}" for f in FEATS)


@register("d17_impute_with_center", RP + f""",
c AS (SELECT {', '.join(f'avg({f}) AS m_{f}' for f in FEATS)} FROM rp)
SELECT rp.model, rp.scenario, rp.region, rp.year, rp.economy, rp.large, rp.medium, {_CENTRE}, rp.region_scale
FROM rp CROSS JOIN c""", doubles=VARS)
def d17_impute_with_center(spark, sf_dir):
    df = rp(spark, sf_dir)
    stats = E.fit_scaler(df, FEATS).select(*[F.col(f"{f}_mean").alias(f) for f in FEATS])
    return D.impute_with_center(df, stats, FEATS)


@register("d17_impute_zero", RP + " SELECT model, scenario, region, year, "
          + ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in VARS) + ", region_scale FROM rp", doubles=VARS)
def d17_impute_zero(spark, sf_dir):
    return D.impute_zero(rp(spark, sf_dir), VARS)


_YW_COLS = list(KEYS) + ["year"] + VARS


@register("d18_prepare_tabular", YW + f""",
filled AS ({interp_select('yearly_wide', TARGETS, _YW_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2)
SELECT * FROM hist WHERE {nn(TARGETS)}""", doubles=_LAG_DOUBLES)
def d18_prepare_tabular(spark, sf_dir):
    return prepare_tabular(yearly_wide(spark, sf_dir), TARGETS, KEYS, n_lags=2)


@register("d18_prepare_sequence", RP + f""",
filled AS ({interp_select('rp', TARGETS, RP_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2),
kept AS (SELECT * FROM hist WHERE {nn(TARGETS)}),
stepped AS (SELECT *, CAST(row_number() OVER ({PART}) - 1 AS BIGINT) AS step,
  CAST(coalesce(year - lag(year) OVER ({PART}), 0) AS INT) AS delta_years FROM kept)
SELECT * FROM stepped WHERE step >= 1""", doubles=_LAG_DOUBLES)
def d18_prepare_sequence(spark, sf_dir):
    return prepare_sequence(rp(spark, sf_dir), TARGETS, KEYS, n_lags=2, min_context_length=1)
