"""Evaluation tables: one aggregate pass over (truth, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import region_type as region_type_expr
from ..functions.columns import safe_div


def stack_pairs(df: DataFrame, truth: Sequence[str], pred: Sequence[str],
                keep: Sequence[str] = (), target_names: Sequence[str] | None = None) -> DataFrame:
    """Wide (truth_i, pred_i) columns -> long rows (keep..., target, y, p)."""
    names = list(target_names) if target_names is not None else list(truth)
    pairs = F.array(*[F.struct(F.lit(n).alias("target"), F.col(t).cast("double").alias("y"),
                               F.col(p).cast("double").alias("p"))
                      for n, t, p in zip(names, truth, pred)])
    return df.select(*keep, F.inline(pairs))


def complete(pairs: DataFrame) -> DataFrame:
    """Pairs of which both sides exist: only they count in a metric, in every term of it."""
    return pairs.where(F.col("y").isNotNull() & F.col("p").isNotNull())


def _metric_cols(n_targets: int) -> list[Column]:
    y, p = F.col("y"), F.col("p")
    err2 = (y - p) * (y - p)
    n = F.count("*")
    mse = F.avg(err2)
    ss_tot = F.var_pop(y) * n
    return [
        mse.alias("mse"),
        F.when((n > 1) & (F.var_pop(y) > 0) & (F.var_pop(p) > 0), F.corr(y, p)).alias("pearson"),
        (F.lit(1.0) - safe_div(F.sum(err2), ss_tot)).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        (n / F.lit(n_targets)).cast("long").alias("sample_size"),
    ]


def metrics(df: DataFrame, truth: Sequence[str], pred: Sequence[str]) -> DataFrame:
    """MSE, Pearson, R2, MAE, RMSE over all complete pairs; sample size = pairs by target."""
    return complete(stack_pairs(df, truth, pred)).agg(*_metric_cols(len(truth)))


def metrics_by_region_type(df: DataFrame, truth: Sequence[str], pred: Sequence[str],
                           region: str = "region") -> DataFrame:
    """Overall plus one row per region type (R10, R6, R5, World, ISO).

    ``rollup`` gives the grouping sets ((), (region_type)) in one aggregate.
    """
    long = complete(stack_pairs(df.withColumn("_rt", region_type_expr(region)), truth, pred, keep=["_rt"]))
    out = long.rollup("_rt").agg(F.grouping("_rt").alias("_g"), *_metric_cols(len(truth)))
    return out.select(F.when(F.col("_g") == 1, F.lit("Overall")).otherwise(F.col("_rt"))
                      .alias("region_type"), "mse", "pearson", "r2", "mae", "rmse", "sample_size")


def valid_pairs(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows where truth and prediction both exist for one target."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())


def r2_per_target(df: DataFrame, truth: Sequence[str], pred: Sequence[str],
                  target_names: Sequence[str] | None = None) -> DataFrame:
    """R2 per target on non-null pairs; NULL below 2 points or at zero variance."""
    long = stack_pairs(df, truth, pred, target_names=target_names) \
        .where(F.col("y").isNotNull() & F.col("p").isNotNull())
    y, p = F.col("y"), F.col("p")
    n = F.count("*")
    ss_tot = F.var_pop(y) * n
    return long.groupBy("target").agg(
        n.alias("n"),
        F.when((n >= 2) & (ss_tot > 0), F.lit(1.0) - F.sum((y - p) * (y - p)) / ss_tot).alias("r2"))


def sliced_metrics(df: DataFrame, truth: Sequence[str], pred: Sequence[str]) -> DataFrame:
    """Count, R2, MAE, RMSE, MAPE% with an element-wise NULL mask (one row)."""
    long = stack_pairs(df, truth, pred).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    y, p = F.col("y"), F.col("p")
    n = F.count("*")
    ss_tot = F.var_pop(y) * n
    nz = F.abs(y) > 1e-12
    return long.agg(
        n.alias("count"),
        F.when(ss_tot > 0, F.lit(1.0) - F.sum((y - p) * (y - p)) / ss_tot).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (F.avg(F.when(nz, F.abs((y - p) / y))) * 100).alias("mape_pct"))


def trajectory_table(df: DataFrame, keys: Sequence[str], truth: Sequence[str],
                     pred: Sequence[str], target_names: Sequence[str] | None = None,
                     time: str = "year") -> DataFrame:
    """Per series, time and target of complete pairs: truth, prediction and their gap."""
    long = complete(stack_pairs(df, truth, pred, keep=list(keys) + [time], target_names=target_names))
    return long.select(*keys, time, "target", F.col("y").alias("truth"),
                       F.col("p").alias("prediction"), (F.col("p") - F.col("y")).alias("gap"))


def scatter_table(df: DataFrame, truth: Sequence[str], pred: Sequence[str],
                  target_names: Sequence[str] | None = None, time: str = "year") -> DataFrame:
    """Per target and time: points, with the target's common axis range and R2."""
    long = stack_pairs(df, truth, pred, keep=[time], target_names=target_names) \
        .where(F.col("y").isNotNull() & F.col("p").isNotNull())
    per_time = long.groupBy("target", time).agg(
        F.count("*").alias("points"), F.avg("y").alias("mean_truth"), F.avg("p").alias("mean_pred"))
    y, p = F.col("y"), F.col("p")
    n = F.count("*")
    ss_tot = F.var_pop(y) * n
    per_target = long.groupBy("target").agg(
        F.least(F.min(y), F.min(p)).alias("axis_min"),
        F.greatest(F.max(y), F.max(p)).alias("axis_max"),
        F.when((n >= 2) & (ss_tot > 0), F.lit(1.0) - F.sum((y - p) * (y - p)) / ss_tot).alias("r2"))
    return per_time.join(per_target, "target")
