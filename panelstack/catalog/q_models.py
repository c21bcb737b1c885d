"""Model queries (G1-G8): fitting, search, recursive rollout, result tables.

Linear rollouts have a DuckDB oracle (recursive CTE); MLlib fits and
searches are checked rows-only plus invariant tests.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as D
from ..operators import metrics as H
from ..operators import model as G
from ..operators import rollout as R
from ..operators import trees as TR
from ..operators.search import search
from ..operators.split import group_kfold, split_by_series
from ..plans.base import KEYS, TARGETS
from ..session import materialize, shared_dir
from ..sources import files
from . import register
from .q_windows import SQ, sq
from .sqlfrag import METRIC_DOUBLES, metrics_by_region_type_sql, split_sql

PRED = [f"pred_{t}" for t in TARGETS]
K = "model, scenario, region"
ON = "te.model = r.model AND te.scenario = r.scenario AND te.region = r.region"


def sq_split(spark, sf_dir):
    # several passes read it (fit, predict, metrics): checkpoint once
    return materialize(split_by_series(sq(spark, sf_dir), KEYS, 0.1, 0.1, seed=0))


_SP = SQ + f", sp AS ({split_sql('sq')}), tr AS (SELECT * FROM sp WHERE split = 'train')"
_CF = "cf AS (SELECT " + ", ".join(
    f"regr_slope({t}, prev_{t}) AS b_{t}, regr_intercept({t}, prev_{t}) AS a_{t}" for t in TARGETS) + " FROM tr)"


def _rollout_sql(scope: str) -> str:
    first = ", ".join(f"cf.a_{t} + cf.b_{t} * te.prev_{t} AS pred_{t}" for t in TARGETS)
    nxt = ", ".join(f"cf.a_{t} + cf.b_{t} * r.pred_{t} AS pred_{t}" for t in TARGETS)
    body = _SP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_CF},
te AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY step) - 1 AS _k FROM sp {scope}),
r AS (SELECT te.model, te.scenario, te.region, te._k, te.step, {first} FROM te CROSS JOIN cf WHERE te._k = 0
      UNION ALL
      SELECT te.model, te.scenario, te.region, te._k, te.step, {nxt}
      FROM r JOIN te ON {ON} AND te._k = r._k + 1 CROSS JOIN cf)"""
    return body


def _ar1(spark, sf_dir, scope=None):
    sp = sq_split(spark, sf_dir)
    fit = G.fit_one_feature(sp.where(F.col("split") == "train"), {t: f"prev_{t}" for t in TARGETS})
    coefs = []
    for row in fit.collect():  # one row per target
        coefs += [(row["target"], "(intercept)", row["intercept"]), (row["target"], row["feature"], row["slope"])]
    rows = sp if scope is None else sp.where(F.col("split") == scope)
    preds = R.rollout_linear(rows, KEYS, "step", TARGETS, coefs, {f"prev_{t}": (t, 1) for t in TARGETS})
    return rows, preds


@register("g1_fit_one_feature", _SP + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS target, 'prev_{t}' AS feature, regr_slope({t}, prev_{t}) AS slope, "
    f"regr_intercept({t}, prev_{t}) AS intercept, count(*) AS n FROM tr "
    f"WHERE {t} IS NOT NULL AND prev_{t} IS NOT NULL" for t in TARGETS), doubles=["slope", "intercept"])
def g1_fit_one_feature(spark, sf_dir):
    sp = sq_split(spark, sf_dir)
    return G.fit_one_feature(sp.where(F.col("split") == "train"), {t: f"prev_{t}" for t in TARGETS})


@register("g6_rollout_linear", _rollout_sql("WHERE split = 'test'") + f" SELECT {K}, step, "
          + ", ".join(PRED) + " FROM r", doubles=PRED)
def g6_rollout_linear(spark, sf_dir):
    return _ar1(spark, sf_dir, "test")[1]


@register("g7_rollout_all", _rollout_sql("") + f" SELECT {K}, step, " + ", ".join(PRED) + " FROM r",
          doubles=PRED)
def g7_rollout_all(spark, sf_dir):
    return _ar1(spark, sf_dir, None)[1]


@register("g8_result_table", _rollout_sql("WHERE split = 'test'") + f""" SELECT te.model, te.scenario, te.region,
  te.step, te.year, {', '.join('r.' + p for p in PRED)} FROM te JOIN r ON {ON} AND te.step = r.step""",
          doubles=PRED)
def g8_result_table(spark, sf_dir):
    rows, preds = _ar1(spark, sf_dir, "test")
    return R.result_table(rows, preds, KEYS, "step", TARGETS)


@register("g_test_metrics_by_region_type", _rollout_sql("WHERE split = 'test'") + f""",
scored AS (SELECT te.*, {', '.join('r.' + p for p in PRED)} FROM te JOIN r ON {ON} AND te.step = r.step)
{metrics_by_region_type_sql('scored', TARGETS, PRED)}""", doubles=METRIC_DOUBLES)
def g_test_metrics_by_region_type(spark, sf_dir):
    """Test phase: fit on train, roll out over test series, score overall and per region type."""
    rows, preds = _ar1(spark, sf_dir, "test")
    scored = rows.join(preds, list(KEYS) + ["step"])
    return H.metrics_by_region_type(scored, TARGETS, PRED)


# ---------------------------------------------------------------- MLlib (rows-only)

BASE_FEATS = ["promo", "small"]
LAGS = [f"prev_{t}" for t in TARGETS] + [f"prev2_{t}" for t in TARGETS]
FEATS = BASE_FEATS + [f"{f}_is_missing" for f in BASE_FEATS] + LAGS


def model_frame(spark, sf_dir):
    """Split panel with flags and train-median imputation: MLlib-ready features."""
    sp = sq_split(spark, sf_dir)
    sp = D.add_missing_flags(sp, BASE_FEATS)
    med = D.fit_medians(sp.where(F.col("split") == "train"), BASE_FEATS)
    return materialize(D.impute(sp, med, BASE_FEATS))


@register("g1_fit_targets_linear", None, notes="MLlib LinearRegression (normal equations) per target")
def g1_fit_targets_linear(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "linear")
    return G.coefficient_table(spark, models, FEATS)


@register("g1_fit_targets_gbt", None, notes="MLlib GBTRegressor per target")
def g1_fit_targets_gbt(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "gbt", maxIter=10, maxDepth=3)
    return G.importance_table(spark, models, FEATS)


def _folded(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    return group_kfold(mf.where(F.col("split") != "test"), KEYS, 3, seed=42)


@register("g2_cross_validate", None, notes="CrossValidator with series folds")
def g2_cross_validate(spark, sf_dir):
    res = G.cross_validate(_folded(spark, sf_dir), FEATS, "economy", "fold", "linear",
                           {"regParam": [0.0, 0.1, 1.0]})
    return G.cv_table(spark, res)


STAGES = [{"maxDepth": [2, 3]}, {"stepSize": [0.1, 0.3]}, {"subsamplingRate": [0.8, 1.0]}]


def _search(spark, sf_dir):
    return G.staged_search(_folded(spark, sf_dir), FEATS, "economy", "fold", STAGES, "gbt", maxIter=5)


@register("g3_staged_search", None, notes="three-stage GBT search, each stage keeps the best so far")
def g3_staged_search(spark, sf_dir):
    return _search(spark, sf_dir)


#: 16, 16 and 24 points: tree structure, rate and number of trees, regularisation.
WHOLE_STAGES = [{"maxDepth": [2, 3, 4, 5], "minInstancesPerNode": [10, 12, 15, 20], "stepSize": [0.4], "maxIter": [3]}, {"stepSize": [0.1, 0.3, 0.4, 0.5], "maxIter": [2, 3, 4, 5]},
                {"minInfoGain": [0.0, 0.1], "subsamplingRate": [0.5, 0.7, 0.9, 1.0], "featureSubsetStrategy": ["all", "sqrt", "onethird"]}]


@register("g3_search_whole_grids", None, notes="three-stage GBT search over 56 points, all targets and folds, from a resumable ledger")
def g3_search_whole_grids(spark, sf_dir):
    return search(_folded(spark, sf_dir), FEATS, TARGETS, "fold", WHOLE_STAGES, shared_dir(spark, "search"))


SEARCH = ("maxDepth", "maxIter", "stepSize", "subsamplingRate")


def _search_schema():
    return T.StructType([*(T.StructField(k, T.DoubleType()) for k in (*SEARCH, "val_loss")), T.StructField("stage", T.StringType()),
                         T.StructField("status", T.StringType()), T.StructField("trial_id", T.LongType())])


@register("g4_rank_trials", None, notes="ledger bookkeeping: remaining, top-k, best")
def g4_rank_trials(spark, sf_dir):
    ledger_path = shared_dir(spark, "trials")
    files.append_trials(_search(spark, sf_dir), ledger_path)
    schema = _search_schema()
    ledger = files.read_trials(spark, ledger_path, schema)
    grid = list(itertools.product([2.0, 3.0], [5.0], [0.1, 0.3], [0.8, 1.0]))
    cand = spark.createDataFrame(grid, ", ".join(f"{k} double" for k in SEARCH))
    out = G.rank_trials(ledger, cand, top_k=2, keys=SEARCH)
    return out["best"].select(*SEARCH, "val_loss", "stage", "signature")


@register("g5_best_per", None, notes="best finite trial per stage")
def g5_best_per(spark, sf_dir):
    return G.best_per(_search(spark, sf_dir), "stage")


@register("g6_rollout_mllib_linear", None, notes="MLlib linear model rolled out by the fold expression")
def g6_rollout_mllib_linear(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "linear")
    coefs = [tuple(r) for r in G.coefficient_table(spark, models, FEATS).collect()]
    lag_cols = {f"prev_{t}": (t, 1) for t in TARGETS}
    lag_cols.update({f"prev2_{t}": (t, 2) for t in TARGETS})
    return R.rollout_linear(mf.where(F.col("split") == "test"), KEYS, "step", TARGETS, coefs, lag_cols)


@register("g6_rollout_stepwise_gbt", None, notes="step-synchronous rollout of MLlib GBT models")
def g6_rollout_stepwise_gbt(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "gbt", maxIter=5, maxDepth=3)
    lag_cols = {f"prev_{t}": (t, 1) for t in TARGETS}
    lag_cols.update({f"prev2_{t}": (t, 2) for t in TARGETS})
    return R.rollout_stepwise(mf.where(F.col("split") == "test"), KEYS, "step", TARGETS,
                              lambda rows: G.predict(models, rows, FEATS), lag_cols)


def _lag_spec():
    return {f"prev{'' if k == 1 else k}_{t}": (t, k) for k in (1, 2) for t in TARGETS}


@register("g7_rollout_trees", None, notes="GBT ensembles rolled out over all series as one fold")
def g7_rollout_trees(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "gbt", maxIter=5, maxDepth=3)
    return TR.rollout_trees(mf, KEYS, "step", TARGETS, TR.node_table(spark, models), FEATS, _lag_spec())


@register("j1_attribution_trees", None, notes="exact path-dependent contributions of GBT ensembles")
def j1_attribution_trees(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    models = G.fit_targets(mf.where(F.col("split") != "test"), FEATS, TARGETS, "gbt", maxIter=5, maxDepth=3)
    return TR.tree_attribution(mf.where(F.col("split") == "test"), [*KEYS, "step"], FEATS, TR.leaf_table(TR.node_table(spark, models)))


@register("a7_write_predictions", _rollout_sql("WHERE split = 'test'") + f""" SELECT te.model, te.scenario, te.region,
  te.step, te.year, {', '.join('r.' + p for p in PRED)} FROM te JOIN r ON {ON} AND te.step = r.step""",
          doubles=PRED)
def a7_write_predictions(spark, sf_dir):
    """Write the result table keyed by (run, series, step) and load it back by run id."""
    rows, preds = _ar1(spark, sf_dir, "test")
    path = shared_dir(spark, "predictions")
    files.write_predictions(R.result_table(rows, preds, KEYS, "step", TARGETS), path, "run-1",
                            keys=list(KEYS) + ["step"])
    return files.load_predictions(spark, path, "run-1")
