"""Slicing, filter options and labels for report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import REGION_OPTION_ORDER, feature_label, region_type, short_number


def filter_options(df: DataFrame, category: str = "scenario_category", family: str = "model_family",
                   region: str = "region") -> DataFrame:
    """Distinct filter values: categories and families sorted, regions ISO, R10, R6, R5, World.

    Output (kind, value, position); the ranking runs over distinct values only.
    """
    order = F.array(*[F.lit(x) for x in REGION_OPTION_ORDER])
    cats = df.select(F.lit("scenario_category").alias("kind"), F.col(category).alias("value"),
                     F.lit(0).alias("_grp")).distinct()
    fams = df.select(F.lit("model_family").alias("kind"), F.col(family).alias("value"),
                     F.lit(0).alias("_grp")).distinct()
    regs = df.where(F.col(region).isNotNull()).select(
        F.lit("region").alias("kind"), F.col(region).alias("value"),
        F.array_position(order, region_type(F.col(region))).cast("int").alias("_grp")).distinct()
    allv = cats.unionByName(fams).unionByName(regs)
    w = Window.partitionBy("kind").orderBy("_grp", F.col("value").asc_nulls_first())
    return allv.select("kind", "value", (F.row_number().over(w) - 1).cast("int").alias("position"))


def slice_rows(df: DataFrame, categories: Sequence[str] | None = None,
               regions: Sequence[str] | None = None, families: Sequence[str] | None = None,
               category: str = "scenario_category", region: str = "region",
               family: str = "model_family") -> DataFrame:
    """AND of membership filters, applied only to columns that exist."""
    cond = F.lit(True)
    for col, vals in ((category, categories), (region, regions), (family, families)):
        if vals is not None and col in df.columns:
            cond = cond & F.col(col).isin(list(vals))
    return df.where(cond)


def filter_region(df: DataFrame, region: str | None, mode: str = "exact",
                  col: str = "region") -> DataFrame:
    """Trimmed, case-insensitive region filter with the fallback chain.

    exact: equal, else contains, else no filter; prefix: starts with, else no
    filter.  Whether anything matched is one aggregate (a single row) that is
    broadcast back to the rows, so the choice is made on the cluster.
    """
    if region is None or col not in df.columns:
        return df
    s = F.lower(F.trim(F.col(col).cast("string")))
    target = region.strip().lower()
    if mode == "prefix":
        hit = s.startswith(target)
        flags = df.agg(F.max(hit).alias("_p"))
        return df.crossJoin(F.broadcast(flags)) \
                 .where(F.when(F.col("_p"), hit).otherwise(F.lit(True))).drop("_p")
    exact = s == F.lit(target)
    contains = s.contains(target)
    flags = df.agg(F.max(exact).alias("_e"), F.max(contains).alias("_c"))
    chosen = F.when(F.col("_e"), exact).when(F.col("_c"), contains).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(flags)).where(chosen).drop("_e", "_c")


def matched_values(filtered: DataFrame, col: str = "region") -> DataFrame:
    return filtered.select(col).distinct()


def label_features(df: DataFrame, feature: str = "feature", out: str = "label") -> DataFrame:
    return df.withColumn(out, feature_label(feature))


def label_numbers(df: DataFrame, value: str, out: str = "text") -> DataFrame:
    return df.withColumn(out, short_number(value))
