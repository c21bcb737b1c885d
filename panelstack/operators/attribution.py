"""Attribution tables (J1-J7) for linear models.

Contributions are ``coef * (x - mean)`` per row, feature and target: the
exact additive attribution of a linear model.  The coefficient and mean
tables are bounded by #targets x #features and are broadcast; everything
else is aggregation over the long contribution table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_features(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(*keep, F.inline(pairs))


def feature_means(train: DataFrame, features: Sequence[str]) -> DataFrame:
    return long_features(train, [], features).groupBy("feature").agg(F.avg("x").alias("mean"))


def univariate_slopes(train: DataFrame, targets: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Least-squares slope of every target on every single feature: (target, feature, coefficient)."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"),
                               F.col(t).cast("double").alias("y"), F.col(f).cast("double").alias("x"))
                      for t in targets for f in features])
    return train.select(F.inline(pairs)).groupBy("target", "feature") \
                .agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("coefficient"))


def linear_attribution(rows: DataFrame, keep: Sequence[str], features: Sequence[str],
                       coefficients: DataFrame, means: DataFrame) -> DataFrame:
    """(keep..., target, feature, x, contribution); a missing x counts as the mean."""
    long = long_features(rows, keep, features)
    c = coefficients.where(F.col("feature") != "(intercept)").select("target", "feature", "coefficient")
    j = long.join(F.broadcast(means), "feature").join(F.broadcast(c), "feature")
    x = F.coalesce(F.col("x"), F.col("mean"))
    return j.select(*keep, "target", "feature", x.alias("x"),
                    (F.col("coefficient") * (x - F.col("mean"))).alias("contribution"))


def linear_importance(rows: DataFrame, features: Sequence[str], coefficients: DataFrame, means: DataFrame) -> DataFrame:
    """``importance`` of a linear model without its contributions: a coefficient is the same for all rows, so
    mean |c (x - m)| = |c| mean |x - m|, one aggregate with a column for each feature."""
    features = list(features)
    centres = means.agg(*[F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"_m_{f}") for f in features])  # one row
    away = [F.avg(F.abs(F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")) - F.col(f"_m_{f}"))).alias(f) for f in features]
    spread = rows.select(*features).crossJoin(F.broadcast(centres)).agg(*away).unpivot([], features, "feature", "_away")
    c = coefficients.where(F.col("feature") != "(intercept)").select("target", "feature", "coefficient")
    return _ranked(c.join(spread, "feature").where(F.col("_away").isNotNull())
                    .select("target", "feature", (F.abs("coefficient") * F.col("_away")).alias("mean_abs")))


def importance(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per target and feature, normalised to sum 1 per target, ranked."""
    return _ranked(contrib.groupBy("target", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")))


def _ranked(m: DataFrame) -> DataFrame:
    tot = F.sum("mean_abs").over(Window.partitionBy("target"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("mean_abs"), "feature"))
    return m.select("target", "feature", "mean_abs",
                    F.when(tot != 0, F.col("mean_abs") / tot).alias("importance"),
                    rank.cast("int").alias("rank"))


def trace_lag_map(imp: DataFrame, targets: Sequence[str], top_lags: int | None = None,
                  top_inputs: int | None = None) -> DataFrame:
    """For a lag of another target among a target's strongest features, that target's
    strongest non-lag input: (target, feature, source_target, traced_feature, renamed).
    Ranks are limited only if asked for."""
    every = F.lit(True)
    lag_rank = every if top_lags is None else F.col("rank") <= top_lags
    input_rank = every if top_inputs is None else F.col("rank") <= top_inputs
    lag_re = r"^prev(\d*)_(.+)$"
    cand = imp.where(lag_rank & F.col("feature").rlike(lag_re)) \
        .select("target", "feature", F.regexp_extract("feature", lag_re, 1).alias("_n"),
                F.regexp_extract("feature", lag_re, 2).alias("source_target")) \
        .where((F.col("source_target") != F.col("target")) & F.col("source_target").isin(list(targets)))
    inputs = imp.where(input_rank & ~F.col("feature").startswith("prev")) \
        .groupBy("target").agg(F.min(F.struct("rank", "feature"))["feature"].alias("traced_feature")) \
        .withColumnRenamed("target", "source_target")
    j = cand.join(inputs, "source_target")
    prefix = F.when(F.col("_n") == "", F.lit("prev_")).otherwise(F.concat(F.lit("prev"), F.col("_n"), F.lit("_")))
    return j.select("target", "feature", "source_target", "traced_feature",
                    F.concat(prefix, F.col("traced_feature")).alias("renamed"))


def trace_lag_contributions(contrib: DataFrame, imp: DataFrame, keys: Sequence[str],
                            targets: Sequence[str]) -> DataFrame:
    """Per row: normalised contribution of the traced input times that of the lag it replaces."""
    m = trace_lag_map(imp, targets)
    tot = imp.groupBy("target").agg(F.sum("mean_abs").alias("_tot"))
    norm = contrib.join(F.broadcast(tot), "target") \
        .select(*keys, "target", "feature",
                F.when(F.col("_tot") != 0, F.col("contribution") / F.col("_tot")).alias("_v"))
    own = norm.join(F.broadcast(m), ["target", "feature"])
    src = norm.select(*keys, F.col("target").alias("source_target"),
                      F.col("feature").alias("traced_feature"), F.col("_v").alias("_s"))
    return own.join(src, list(keys) + ["source_target", "traced_feature"]) \
        .select(*keys, "target", F.col("renamed").alias("feature"), (F.col("_s") * F.col("_v")).alias("contribution"))


def top_features(imp: DataFrame, k: int = 8, exclude_top: bool = False) -> DataFrame:
    """k strongest features per target (k - 1 after the strongest when excluding it)."""
    if exclude_top:
        return imp.where((F.col("rank") > 1) & (F.col("rank") <= k))
    return imp.where(F.col("rank") <= k)


def sequence_cube(seqs: DataFrame, keys: Sequence[str], arrays: dict[str, str]) -> DataFrame:
    """(keys, start, timestep, feature, x) from per-sample feature arrays; timestep 0 = latest."""
    names = list(arrays)
    z = F.arrays_zip(*[F.col(arrays[n]).alias(n) for n in names])
    e = seqs.select(*keys, "start", F.size(arrays[names[0]]).alias("_len"), F.posexplode(z).alias("_p", "_z"))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_z.{n}").cast("double").alias("x"))
                      for n in names])
    return e.select(*keys, "start", (F.col("_len") - 1 - F.col("_p")).cast("int").alias("timestep"),
                    F.inline(pairs))


def cube_attribution(cube: DataFrame, coefficients: DataFrame, means: DataFrame) -> DataFrame:
    c = coefficients.select("target", "feature", "coefficient")
    j = cube.join(F.broadcast(means), "feature").join(F.broadcast(c), "feature")
    x = F.coalesce(F.col("x"), F.col("mean"))
    return j.select(*[c_ for c_ in cube.columns if c_ != "x"], "target", x.alias("x"),
                    (F.col("coefficient") * (x - F.col("mean"))).alias("contribution"))


def collapse_time(cube_contrib: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum contributions and average feature values over timesteps per sample."""
    return cube_contrib.groupBy(*keys, "start", "target", "feature").agg(
        F.sum("contribution").alias("contribution"), F.avg("x").alias("x"))


def time_feature_heat(cube_contrib: DataFrame, k: int = 8) -> DataFrame:
    """Mean |contribution| by timestep for the k strongest features of each target."""
    overall = cube_contrib.groupBy("target", "feature").agg(F.avg(F.abs("contribution")).alias("_m"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("_m"), "feature"))
    top = overall.select("target", "feature", rank.alias("_r")).where(F.col("_r") <= k).drop("_r")
    return cube_contrib.join(F.broadcast(top), ["target", "feature"]) \
        .groupBy("target", "feature", "timestep").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def timestep_importance(cube_contrib: DataFrame) -> DataFrame:
    return cube_contrib.groupBy("target", "timestep").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
