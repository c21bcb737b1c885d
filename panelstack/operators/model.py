"""Model fitting and search on Spark MLlib.

Estimators run distributed (MLlib); the driver only sees fitted
coefficients and metric values, whose size is bounded by the number of
features and parameter combinations.  Features must be non-null: impute and
flag them first (D11-D13); MLlib rejects NULL and NaN.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES_COL = "_features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL,
                           handleInvalid="error").transform(df)


def make_estimator(algo: str, target: str, **params):
    if algo == "linear":
        return LinearRegression(featuresCol=FEATURES_COL, labelCol=target, predictionCol=f"pred_{target}",
                                solver=params.pop("solver", "normal"), **params)
    if algo == "gbt":
        return GBTRegressor(featuresCol=FEATURES_COL, labelCol=target, predictionCol=f"pred_{target}",
                            seed=params.pop("seed", 0), **params)
    raise ValueError(f"unknown algorithm {algo!r}")


def fit_targets(train: DataFrame, features: Sequence[str], targets: Sequence[str],
                algo: str = "linear", **params) -> dict:
    """One regressor per target (multi-output as independent models)."""
    data = assemble(train, features)
    return {t: make_estimator(algo, t, **dict(params)).fit(data) for t in targets}


def predict(models: dict, df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = assemble(df, features)
    for t, m in models.items():
        out = m.transform(out)
    return out.drop(FEATURES_COL)


def coefficient_table(spark: SparkSession, models: dict, features: Sequence[str]) -> DataFrame:
    """(target, feature, coefficient) for linear models; intercept as feature '(intercept)'."""
    rows = []
    for t, m in models.items():
        rows.append((t, "(intercept)", float(m.intercept)))
        rows += [(t, f, float(c)) for f, c in zip(features, m.coefficients.toArray())]
    return spark.createDataFrame(rows, "target string, feature string, coefficient double")


def importance_table(spark: SparkSession, models: dict, features: Sequence[str]) -> DataFrame:
    """(target, feature, importance) for tree ensembles."""
    rows = [(t, f, float(v)) for t, m in models.items()
            for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def fit_one_feature(train: DataFrame, target_feature: dict[str, str]) -> DataFrame:
    """Closed-form least squares of each target on one feature (slope, intercept, n): one aggregate for all."""
    fits = [F.struct(F.lit(t).alias("target"), F.lit(x).alias("feature"), F.regr_slope(F.col(t), F.col(x)).alias("slope"),
                     F.regr_intercept(F.col(t), F.col(x)).alias("intercept"),
                     F.count(F.when(F.col(t).isNotNull() & F.col(x).isNotNull(), 1)).alias("n"))
            for t, x in target_feature.items()]
    return train.agg(F.array(*fits).alias("_fits")).select(F.inline("_fits"))


def cross_validate(df: DataFrame, features: Sequence[str], target: str, fold_col: str,
                   algo: str, grid: dict[str, list], parallelism: int = 4, **fixed) -> list[tuple[dict, float]]:
    """Mean RMSE over series folds for every parameter combination (MLlib CrossValidator).

    Returns (params, mean_rmse) pairs; the params include the fixed ones.
    """
    est = make_estimator(algo, target, **dict(fixed))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    ev = RegressionEvaluator(labelCol=target, predictionCol=f"pred_{target}", metricName="rmse")
    n_folds = df.agg(F.max(fold_col)).collect()[0][0] + 1
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        parallelism=parallelism, numFolds=int(n_folds))
    model = cv.fit(assemble(df, features).withColumn(fold_col, F.col(fold_col).cast("int")))
    out = []
    for pm, metric in zip(maps, model.avgMetrics):
        params = dict(fixed)
        params.update({p.name: v for p, v in pm.items()})
        out.append((params, float(metric)))
    return out


def cv_table(spark: SparkSession, results: list[tuple[dict, float]]) -> DataFrame:
    rows = [(json.dumps(p, sort_keys=True), m) for p, m in results]
    return spark.createDataFrame(rows, "params string, mean_rmse double")


def staged_search(df: DataFrame, features: Sequence[str], target: str, fold_col: str,
                  stages: Sequence[dict[str, list]], algo: str = "gbt", **fixed) -> DataFrame:
    """Stage after stage, search one group of parameters keeping the best of the previous stages.

    Returns the trials ledger: one row per trial with every parameter as a
    column, ``val_loss`` (mean fold RMSE), ``stage``, ``status``, ``trial_id``.
    """
    best: dict = dict(fixed)
    trials = []
    names = sorted({*fixed, *[k for g in stages for k in g]})
    for i, grid in enumerate(stages, start=1):
        res = cross_validate(df, features, target, fold_col, algo, grid, **best)
        for params, loss in res:
            trials.append((params, loss, f"stage{i}"))
        best = dict(min(res, key=lambda r: (r[1], json.dumps(r[0], sort_keys=True)))[0])
    rows = [(*[float(p.get(n)) if p.get(n) is not None else None for n in names], loss, st,
             "completed", j) for j, (p, loss, st) in enumerate(trials)]
    schema = ", ".join(f"{n} double" for n in names) + ", val_loss double, stage string, status string, trial_id long"
    return df.sparkSession.createDataFrame(rows, schema)


SEARCH_KEYS = ("dropout", "hidden_size", "learning_rate", "lstm_layers")


def _canon(c: str, dtype) -> F.Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # 12 significant digits: through scientific text and back
        return F.format_string("%.11e", F.col(c).cast("double")).cast("double").alias(c)
    return F.col(c).alias(c)


def signature(df: DataFrame, keys: Sequence[str] = SEARCH_KEYS) -> F.Column:
    """Canonical JSON of the search parameters (sorted keys, floats to 12 significant digits)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[_canon(k, types[k]) for k in sorted(keys)]))


def completed_trials(ledger: DataFrame, keys: Sequence[str] = SEARCH_KEYS) -> DataFrame:
    ok = (F.col("status") == "completed") & F.col("val_loss").isNotNull() \
        & ~F.isnan("val_loss") & (F.abs("val_loss") != float("inf"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ledger.where(ok)


def rank_trials(ledger: DataFrame, candidates: DataFrame, top_k: int,
                keys: Sequence[str] = SEARCH_KEYS) -> dict[str, DataFrame]:
    """Resume bookkeeping of a two-stage search over a trials ledger.

    Returns stage1_remaining (candidates never explored), stage2_candidates
    (top-k distinct stage-1 signatures by loss), stage2_remaining (those not
    yet run in stage 2) and best (lowest loss, stage 2 preferred).
    """
    done = completed_trials(ledger, keys)
    done = done.withColumn("signature", F.coalesce(F.col("signature"), signature(done, keys))) \
        if "signature" in done.columns else done.withColumn("signature", signature(done, keys))
    stage = F.coalesce(F.col("stage"), F.lit("stage1"))
    cand = candidates.withColumn("signature", signature(candidates, keys))
    explored = done.select("signature").distinct()
    stage1_remaining = cand.join(explored, "signature", "left_anti")
    s1 = done.where(stage != "stage2")
    first = s1.withColumn("_r", F.row_number().over(
        Window.partitionBy("signature").orderBy("val_loss", "trial_id")))
    ranked = first.where(F.col("_r") == 1).drop("_r")
    top = ranked.orderBy("val_loss", "signature").limit(max(1, top_k))
    stage2_done = done.where(stage == "stage2").select("signature").distinct()
    stage2_remaining = top.select("signature").join(stage2_done, "signature", "left_anti") \
        .join(cand.select("signature", *keys), "signature")
    has2 = done.where(stage == "stage2").limit(1).count() > 0
    pool = done.where(stage == "stage2") if has2 else s1
    best = pool.orderBy("val_loss", "signature", *([c for c in ("trial_id",) if c in pool.columns])).limit(1)
    return {"stage1_remaining": stage1_remaining, "stage2_candidates": top.select("signature", "val_loss"),
            "stage2_remaining": stage2_remaining, "best": best}


def best_per(trials: DataFrame, group: str, loss: str = "val_loss", tie: str = "trial_id") -> DataFrame:
    """Best (lowest finite loss, then lowest trial id) trial per group value."""
    ok = trials.where(F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) != float("inf")))
    w = Window.partitionBy(group).orderBy(loss, *([tie] if tie in trials.columns else []))
    return ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def finite(x: float) -> bool:
    return x is not None and math.isfinite(x)
