"""Per-series features with window functions.

All windows partition by the series key and order by time, so Spark sorts
each series partition once and evaluates every derived column of one
``select`` in the same Window operator.  Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast

from ..functions.columns import any_null, col
from .stats import grouped_medians


def series_window(keys: Sequence[str], time: str = "year"):
    return Window.partitionBy(*keys).orderBy(time)


def _interp_expr(c: str, keys, time) -> Column:
    w = series_window(keys, time)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(c).isNotNull(),
                   F.struct(F.col(time).cast("double").alias("t"), F.col(c).cast("double").alias("v")))
    prev = F.last(point, ignorenulls=True).over(back)
    nxt = F.first(point, ignorenulls=True).over(fwd)
    t = F.col(time).cast("double")
    slope = (nxt["v"] - prev["v"]) / (nxt["t"] - prev["t"])
    return (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
             .when(prev.isNull(), nxt["v"])
             .when(nxt.isNull(), prev["v"])
             .otherwise(prev["v"] + slope * (t - prev["t"])))


def interpolate(df: DataFrame, cols: Sequence[str], keys: Sequence[str],
                time: str = "year") -> DataFrame:
    """Linear in time inside a series, nearest value at both edges.

    A series whose column is entirely NULL stays NULL.  (series, time) must
    be unique (pivoted panels are).
    """
    cols = list(cols)
    return df.select(*[(_interp_expr(c, keys, time).alias(c) if c in cols else F.col(c))
                       for c in df.columns])


def fill_report(df: DataFrame, cols: Sequence[str], keys: Sequence[str],
                time: str = "year") -> DataFrame:
    """NULL cells of ``cols`` before and after interpolation, and how many were filled (one row)."""
    originals = [F.col(c).alias(f"_o_{c}") for c in cols]
    filled = interpolate(df.select(*keys, time, *cols, *originals), cols, keys, time)
    before = sum(F.col(f"_o_{c}").isNull().cast("long") for c in cols)
    after = sum(F.col(c).isNull().cast("long") for c in cols)
    return filled.agg(F.sum(before).alias("nulls_before"), F.sum(after).alias("nulls_after")) \
                 .withColumn("filled", F.col("nulls_before") - F.col("nulls_after"))


def per_capita(df: DataFrame, targets: Sequence[str], population: str) -> DataFrame:
    """target / population; NULL when population is NULL or <= 0."""
    p = F.col(population)
    return df.select(*[(F.when(p > 0, F.col(c) / p).alias(c) if c in targets else F.col(c))
                       for c in df.columns])


def from_per_capita(df: DataFrame, cols: Sequence[str], population: str) -> DataFrame:
    """Multiply back row by row (NULL propagates)."""
    return df.select(*[((F.col(c) * F.col(population)).alias(c) if c in cols else F.col(c))
                       for c in df.columns])


def lag_name(c: str, k: int) -> str:
    return f"prev_{c}" if k == 1 else f"prev{k}_{c}"


def add_lags(df: DataFrame, cols: Sequence[str], n: int, keys: Sequence[str],
             time: str = "year") -> DataFrame:
    """``prev_x``, ``prev2_x`` ... by row order inside the series."""
    w = series_window(keys, time)
    return df.select("*", *[F.lag(c, k).over(w).alias(lag_name(c, k))
                            for k in range(1, n + 1) for c in cols])


def require_history(df: DataFrame, n: int, keys: Sequence[str], time: str = "year") -> DataFrame:
    """Drop the first ``n`` rows of every series."""
    rn = F.row_number().over(series_window(keys, time))
    return df.withColumn("_rn", rn).where(F.col("_rn") > n).drop("_rn")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL."""
    return df.dropna(subset=list(cols))


def add_step(df: DataFrame, keys: Sequence[str], time: str = "year", name: str = "step") -> DataFrame:
    """0-based ordinal of the row inside its series."""
    return df.withColumn(name, (F.row_number().over(series_window(keys, time)) - 1).cast("long"))


def add_delta_time(df: DataFrame, keys: Sequence[str], time: str = "year",
                   name: str = "delta_years") -> DataFrame:
    """Years since the previous row of the series (0 for the first)."""
    w = series_window(keys, time)
    return df.withColumn(name, F.coalesce(F.col(time) - F.lag(time, 1).over(w), F.lit(0)).cast("int"))


def add_step_and_delta(df: DataFrame, keys: Sequence[str], time: str = "year") -> DataFrame:
    """D7 + D8 in one window pass."""
    w = series_window(keys, time)
    return df.select("*", (F.row_number().over(w) - 1).cast("long").alias("step"),
                     F.coalesce(F.col(time) - F.lag(time, 1).over(w), F.lit(0)).cast("int")
                     .alias("delta_years"))


def min_context(df: DataFrame, k: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) >= k)


def feature_columns(df: DataFrame, non_features: Sequence[str], targets: Sequence[str]) -> list[str]:
    drop = set(non_features) | set(targets)
    return [c for c in df.columns if c not in drop]


def missing_feature_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, and rows with at least one NULL feature (one aggregate)."""
    return df.agg(F.count("*").alias("rows"),
                  F.sum(any_null(features).cast("long")).alias("rows_with_missing"))


def add_missing_flags(df: DataFrame, features: Sequence[str],
                      skip: Sequence[str] = ()) -> DataFrame:
    """``<f>_is_missing`` = 1.0 when f is NULL else 0.0 (categoricals skipped)."""
    flags = [F.col(f).isNull().cast("double").alias(f"{f}_is_missing")
             for f in features if f not in set(skip)]
    return df.select("*", *flags)


def fit_medians(train: DataFrame, cols: Sequence[str], by: str = "region_scale") -> DataFrame:
    """Medians from the training rows: per ``by`` value and globally (``by`` NULL).

    Long result (by, feature, median); at most (#groups + 1) x #cols rows.
    """
    med = grouped_medians(train.withColumn(by, F.col(by).cast("string")), [by], cols, total=True)
    return med.where(F.col(by).isNotNull() | F.col("_all")).select(by, "feature", "median")


def impute(df: DataFrame, medians: DataFrame, cols: Sequence[str],
           by: str = "region_scale") -> DataFrame:
    """Fill NULLs with the group median, else the global median, else 0.0.

    ``medians`` is pivoted to one row per group; the single global row is
    broadcast.
    """
    cols = list(cols)
    pick = lambda c: F.max(F.when(F.col("feature") == c, F.col("median")))
    per = medians.where(F.col(by).isNotNull()).groupBy(by) \
                 .agg(*[pick(c).alias(f"_m_{c}") for c in cols])
    # an aggregate without grouping always yields exactly one row
    glob = medians.where(F.col(by).isNull()).agg(*[pick(c).alias(f"_g_{c}") for c in cols])
    # per-group medians: one row per value of ``by``, broadcast if few; global: exactly one row
    out = df.join(checked_broadcast(per), by, "left").crossJoin(F.broadcast(glob))
    filled = [F.coalesce(F.col(c), F.col(f"_m_{c}"), F.col(f"_g_{c}"), F.lit(0.0)).alias(c)
              if c in cols else F.col(c) for c in df.columns]
    return out.select(*filled)


def check_scale_coverage(train: DataFrame, others: DataFrame, by: str = "region_scale",
                         strict: bool = False) -> DataFrame:
    """Values of ``by`` present in ``others`` but never in ``train``."""
    missing = others.select(by).distinct().join(train.select(by).distinct(), by, "left_anti")
    if strict and missing.limit(1).count() > 0:
        raise ValueError("scales missing from the training split")
    return missing


def ffill_series(df: DataFrame, cols: Sequence[str], keys: Sequence[str],
                 time: str = "year") -> DataFrame:
    """Carry the last known value forward inside the series."""
    w = series_window(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[(F.last(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c))
                       for c in df.columns])


def fill_mask(df: DataFrame, cols: Sequence[str], mask: float = -1.0,
              flag: str = "row_valid") -> DataFrame:
    """NULL -> mask value; ``row_valid`` is true when no feature equals the mask."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(mask)).alias(c) if c in cols else F.col(c)
              for c in df.columns]
    out = df.select(*filled)
    valid = None
    for c in cols:
        e = F.col(c) != F.lit(mask)
        valid = e if valid is None else (valid & e)
    return out.withColumn(flag, valid)


def impute_with_center(df: DataFrame, centers: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs from a one-row table of centres (e.g. scaler means)."""
    c1 = centers.select(*[F.col(c).alias(f"_c_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(c1))
    return out.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))
