"""Closed-form linear models of all targets on all features: fits and cross validation.

The oracles fit each fold on its own rows and score row by row; the elimination is a chain of window queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as L
from ..operators.split import group_kfold
from ..plans.base import KEYS, TARGETS
from ..session import materialize
from . import register
from .q_encode import _fold_sql
from .q_models import BASE_FEATS, FEATS, LAGS, _SP, K, model_frame
from .sqlfrag import rank_sql, unpivot_sql

FOLDS = 5
RIDGES = (0.0, 0.1, 1.0)
LAG_COLS = {f"prev{'' if k == 1 else k}_{t}": (t, k) for k in (1, 2) for t in TARGETS}

_PICK = lambda f: f"max(CASE WHEN feature = '{f}' THEN median END)"
#: The model frame: missing flags and the training rows' medians by region scale, then of all.
MF = _SP + f""",
md AS (SELECT region_scale, feature, median(value) AS median FROM ({unpivot_sql('tr', BASE_FEATS, keep=['region_scale'])}) u
       WHERE value IS NOT NULL GROUP BY region_scale, feature
       UNION ALL SELECT CAST(NULL AS VARCHAR), feature, median(value) FROM ({unpivot_sql('tr', BASE_FEATS)}) u WHERE value IS NOT NULL GROUP BY feature),
pm AS (SELECT region_scale AS rs, {', '.join(f'{_PICK(f)} AS m_{f}' for f in BASE_FEATS)} FROM md WHERE region_scale IS NOT NULL GROUP BY region_scale),
am AS (SELECT {', '.join(f'{_PICK(f)} AS g_{f}' for f in BASE_FEATS)} FROM md WHERE region_scale IS NULL),
mf AS (SELECT {K}, year, step, split, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in (*TARGETS, *LAGS))},
              {', '.join(f'coalesce({f}, m_{f}, g_{f}, 0.0) AS {f}, CAST({f} IS NULL AS DOUBLE) AS {f}_is_missing' for f in BASE_FEATS)}
       FROM sp LEFT JOIN pm ON sp.region_scale = pm.rs CROSS JOIN am)"""
TV = MF + f""", tv AS (SELECT * FROM mf WHERE split <> 'test'), rk AS ({rank_sql('tv', seed=42)}),
fd AS (SELECT tv.*, {_fold_sql(FOLDS)} AS fold FROM tv JOIN rk ON tv.model = rk.model AND tv.scenario = rk.scenario AND tv.region = rk.region)"""


def fit_sql(train: str, ridges=(0.0,), features=FEATS, targets=TARGETS) -> str:
    """CTEs from ``train`` (fold, columns): ``cw`` has (fold, ridge) and b_<target>_<i>, i = 0 the constant."""
    cols, p = [*features, *targets], len(features)
    n, t = len(cols), len(targets)
    lit = L.TOLERANCE
    sums = ", ".join([f"sum({c}) AS m_{i}" for i, c in enumerate(cols, 1)] + [f"sum({cols[i - 1]} * {cols[j - 1]}) AS s_{i}_{j}" for i in range(1, n + 1) for j in range(i, n + 1)])
    cen = lambda i, j: f"(s_{min(i, j)}_{max(i, j)} - m_{i} * m_{j} / n)"
    wide = ", ".join(f"CASE WHEN {cen(i, i)} > {lit * 1e-3} * s_{i}_{i} THEN sqrt({cen(i, i)}) ELSE 0.0 END AS d_{i}" for i in range(1, n + 1))
    cells = [(i, j) for i in range(1, p + 1) for j in range(1, n + 1)]
    value = lambda i, j: f"CASE WHEN d_{i} > 0 THEN 1.0 + ridge ELSE 0.0 END" if i == j else f"CASE WHEN d_{i} > 0 AND d_{j} > 0 THEN {cen(i, j)} / (d_{i} * d_{j}) ELSE 0.0 END"
    out = [f"gm AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, {sums} FROM ({train}) AS _t GROUP BY fold)",
           f"dm AS (SELECT *, {wide} FROM gm CROSS JOIN (SELECT unnest([{', '.join(f'CAST({r} AS DOUBLE)' for r in ridges)}]) AS ridge) AS _r)",
           f"a0 AS (SELECT fold, ridge, unnest([{', '.join(str(i) for i, _ in cells)}]) AS i, unnest([{', '.join(str(j) for _, j in cells)}]) AS j, unnest([{', '.join(value(i, j) for i, j in cells)}]) AS v FROM dm)"]
    for k in range(1, p + 1):
        out.append(f"""a{k} AS (SELECT fold, ridge, i, j, CASE WHEN pv > {lit} THEN CASE WHEN i = {k} THEN v / pv ELSE v - vi * (vj / pv) END WHEN i = {k} THEN 0.0 ELSE v END AS v FROM (
  SELECT *, max(CASE WHEN i = {k} AND j = {k} THEN v END) OVER (PARTITION BY fold, ridge) AS pv, max(CASE WHEN j = {k} THEN v END) OVER (PARTITION BY fold, ridge, i) AS vi,
         max(CASE WHEN i = {k} THEN v END) OVER (PARTITION BY fold, ridge, j) AS vj FROM a{k - 1}) AS _a)""")
    got = ", ".join(f"max(CASE WHEN i = {i} AND j = {p + k} THEN v END) AS r_{i}_{k}" for i in range(1, p + 1) for k in range(1, t + 1))
    out.append(f"rw AS (SELECT fold, ridge, {got} FROM a{p} GROUP BY fold, ridge)")
    slope = lambda i, k: f"CASE WHEN d_{i} > 0 THEN r_{i}_{k} * d_{p + k} / d_{i} ELSE 0.0 END"
    slopes = ", ".join(f"{slope(i, k)} AS b_{targets[k - 1]}_{i}" for k in range(1, t + 1) for i in range(1, p + 1))
    out.append(f"sw AS (SELECT dm.*, {slopes} FROM dm JOIN rw ON dm.fold = rw.fold AND dm.ridge = rw.ridge)")
    cut = ", ".join(f"m_{p + k} / n - ({' + '.join(f'b_{targets[k - 1]}_{i} * m_{i} / n' for i in range(1, p + 1))}) AS b_{targets[k - 1]}_0" for k in range(1, t + 1))
    out.append(f"cw AS (SELECT *, {cut} FROM sw)")
    return ", ".join(out)


_OTHERS = "SELECT f.fold, fd.* EXCLUDE (fold) FROM fd JOIN (SELECT DISTINCT fold FROM fd) f ON fd.fold <> f.fold"
_TRAIN = "SELECT 'val' AS fold, * FROM tv WHERE split = 'train'"


def _pred(t: str, lag=lambda c: c) -> str:
    return f"b_{t}_0 + " + " + ".join(f"b_{t}_{i} * {lag(f)}" for i, f in enumerate(FEATS, 1))


def _score(src: str) -> str:
    errors = " + ".join(f"(y_{t} - p_{t}) * (y_{t} - p_{t})" for t in TARGETS)
    return f"SELECT ridge, fold, count(*) AS rows, sqrt(sum({errors}) / (count(*) * {len(TARGETS)})) AS rmse FROM {src} GROUP BY ridge, fold"


def one_step_sql(rows: str, train: str, ridges) -> str:
    """CTE ``sc`` (ridge, fold, rows, rmse) of the held-out ``rows`` (a CTE with a fold column)."""
    made = ", ".join(f"{t} AS y_{t}, {_pred(t)} AS p_{t}" for t in TARGETS)
    return f", {fit_sql(train, ridges)}, pr AS (SELECT cw.ridge, cw.fold, {made} FROM {rows} h JOIN cw ON h.fold = cw.fold), sc AS ({_score('pr')})"


def recursive_sql(rows: str, train: str, ridges) -> str:
    """``one_step_sql`` with each series rolled out: lag k is the prediction k steps back, once there is one."""

    def lag(f):
        if f not in LAG_COLS:
            return f"te.{f}"
        t, k = LAG_COLS[f]
        return f"CASE WHEN te._k >= {k} THEN {'r.p_' if k == 1 else 'r.q_'}{t} ELSE te.{f} END"

    first = ", ".join(f"te.{t} AS y_{t}, {_pred(t, lambda f: f'te.{f}')} AS p_{t}, CAST(NULL AS DOUBLE) AS q_{t}" for t in TARGETS)
    after = ", ".join(f"te.{t}, {_pred(t, lag)}, r.p_{t}" for t in TARGETS)
    same = "te.model = r.model AND te.scenario = r.scenario AND te.region = r.region"
    return f""", {fit_sql(train, ridges)}, te AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY step) - 1 AS _k FROM {rows}),
r AS (SELECT cw.ridge, cw.fold, te.model, te.scenario, te.region, te._k, {first} FROM te JOIN cw ON te.fold = cw.fold WHERE te._k = 0
      UNION ALL
      SELECT r.ridge, r.fold, te.model, te.scenario, te.region, te._k, {after}
      FROM r JOIN te ON {same} AND te._k = r._k + 1 JOIN cw ON cw.fold = r.fold AND cw.ridge = r.ridge),
sc AS ({_score('r')})"""


def _rec(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_COEFS = " UNION ALL ".join(f"SELECT '{t}' AS target, '{f}' AS feature, b_{t}_{i} AS coefficient FROM cw" for t in TARGETS for i, f in enumerate([L.INTERCEPT, *FEATS]))


def folded(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    return materialize(group_kfold(mf.where(F.col("split") != "test"), KEYS, FOLDS, seed=42))


def validated(spark, sf_dir):
    return model_frame(spark, sf_dir).where(F.col("split") != "test")


@register("g1_fit_linear", MF + f", tv AS (SELECT * FROM mf WHERE split <> 'test'), {fit_sql('SELECT 0 AS fold, * FROM tv')} {_COEFS}", doubles=["coefficient"])
def g1_fit_linear(spark, sf_dir):
    """Every target on all features: one aggregate, one solve."""
    mf = model_frame(spark, sf_dir)
    return L.fit_linear(mf.where(F.col("split") != "test"), FEATS, TARGETS)


@register("g2_cv_linear", TV + one_step_sql("fd", _OTHERS, RIDGES) + " SELECT * FROM sc", doubles=["rmse"])
def g2_cv_linear(spark, sf_dir):
    """One-step errors of five folds and three ridges from one scan."""
    return L.cross_validate_linear(folded(spark, sf_dir), FEATS, TARGETS, "fold", RIDGES)


@register("g2_cv_linear_mean", TV + one_step_sql("fd", _OTHERS, RIDGES) + " SELECT ridge, count(*) AS folds, avg(rmse) AS mean_rmse FROM sc GROUP BY ridge", doubles=["mean_rmse"])
def g2_cv_linear_mean(spark, sf_dir):
    return L.mean_rmse(L.cross_validate_linear(folded(spark, sf_dir), FEATS, TARGETS, "fold", RIDGES))


@register("g2_cv_linear_recursive", _rec(TV) + recursive_sql("fd", _OTHERS, RIDGES) + " SELECT * FROM sc", doubles=["rmse"])
def g2_cv_linear_recursive(spark, sf_dir):
    """Every fold's model rolled out over its held-out series."""
    return L.cross_validate_linear(folded(spark, sf_dir), FEATS, TARGETS, "fold", RIDGES, recursive=True, keys=KEYS, lag_cols=LAG_COLS)


_VAL = MF + ", tv AS (SELECT * FROM mf WHERE split <> 'test'), hv AS (SELECT *, split AS fold FROM tv WHERE split = 'val')"


@register("g2_validation_split", _VAL + one_step_sql("hv", _TRAIN, RIDGES) + " SELECT ridge, fold AS split, rows, rmse FROM sc", doubles=["rmse"])
def g2_validation_split(spark, sf_dir):
    """Fitted on train, scored on val."""
    return L.cross_validate_linear(validated(spark, sf_dir), FEATS, TARGETS, "split", RIDGES, train="train")


@register("g2_validation_split_recursive", _rec(_VAL) + recursive_sql("hv", _TRAIN, RIDGES) + " SELECT ridge, fold AS split, rows, rmse FROM sc", doubles=["rmse"])
def g2_validation_split_recursive(spark, sf_dir):
    return L.cross_validate_linear(validated(spark, sf_dir), FEATS, TARGETS, "split", RIDGES, train="train", recursive=True, keys=KEYS, lag_cols=LAG_COLS)
