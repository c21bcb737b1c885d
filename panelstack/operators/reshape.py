"""Projection, casts and reshape (long <-> wide) of scenario panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_not_null


def year_columns(df: DataFrame, lo: int = 1800, hi: int = 2300,
                 max_year: int | None = None) -> list[str]:
    """Names of columns that are integer years in [lo, hi] (and <= max_year)."""
    out = []
    for c in df.columns:
        s = c.strip()
        if s.isdigit() and lo <= int(s) <= hi and (max_year is None or int(s) <= max_year):
            out.append(c)
    return out


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Unparsable text becomes NULL (``try_cast`` keeps ANSI mode happy)."""
    wanted = set(cols)
    return df.select(*[
        F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in wanted else F.col(f"`{c}`")
        for c in df.columns])


def unpivot_years(df: DataFrame, lo: int = 1800, hi: int = 2300, max_year: int | None = None,
                  time: str = "year", value: str = "value") -> DataFrame:
    """Wide yearly table -> long: one row per year column, year INT, value DOUBLE.

    Only columns whose names are years are melted; all others are ids.
    Raises when no year column exists.  The upper cut-off prunes columns
    before the melt, so the scan never reads them.
    """
    all_years = year_columns(df, lo, hi)
    if not all_years:
        raise ValueError("no year columns found")
    years = [c for c in all_years if max_year is None or int(c.strip()) <= max_year]
    ids = [c for c in df.columns if c not in all_years]
    slim = df.select(*[F.col(f"`{c}`") for c in ids],
                     *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c.strip()) for c in years])
    return (slim.unpivot(ids, [c.strip() for c in years], time, value)
                .withColumn(time, F.col(time).cast("int")))


def pivot_variables(long: DataFrame, variables: Sequence[str], keys: Sequence[str],
                    time: str = "year", variable: str = "variable", value: str = "value",
                    names: Sequence[str] | None = None, by_series: bool = True) -> DataFrame:
    """Long -> one column per variable (mean of duplicates).

    Rows with a NULL key or NULL value are dropped first and only listed
    variables are kept, so no all-NULL row can appear (pivot-table rules).
    The explicit variable list avoids the extra distinct job of ``pivot``.
    With ``by_series`` the long rows are hash-partitioned by the series keys
    only: that partitioning satisfies the pivot's grouping (keys + time) and
    every later per-series window, so the panel is shuffled once.
    """
    names = list(names) if names is not None else [v.lower() for v in variables]
    group = list(keys) + [time]
    rows = long.where(all_not_null(group + [value]) & F.col(variable).isin(list(variables)))
    if by_series:
        rows = rows.repartition(*keys)
    pivoted = rows.groupBy(*group).pivot(variable, list(variables)).agg(F.avg(value))
    return pivoted.select(*group, *[F.col(f"`{v}`").alias(n) for v, n in zip(variables, names)])


def unpivot_variables(wide: DataFrame, variables: Sequence[str], keys: Sequence[str],
                      time: str = "year", variable: str = "variable", value: str = "value",
                      labels: Sequence[str] | None = None, drop_null: bool = True) -> DataFrame:
    """Wide panel -> long (keys, time, variable, value); NULL cells dropped by default."""
    labels = list(labels) if labels is not None else list(variables)
    tmp = wide.select(*keys, time, *[F.col(v).cast("double").alias(l) for v, l in zip(variables, labels)])
    long = tmp.unpivot(list(keys) + [time], labels, variable, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def pivot_years(wide: DataFrame, variables: Sequence[str], keys: Sequence[str],
                years: Sequence[int] | None = None, time: str = "year",
                labels: Sequence[str] | None = None) -> DataFrame:
    """Panel (keys, year, variables) -> keys + variable + one column per year.

    ``years=None`` lets Spark find the distinct years (one small extra job).
    """
    long = unpivot_variables(wide, variables, keys, time, labels=labels)
    g = long.groupBy(*keys, "variable")
    out = g.pivot(time, list(years)) if years is not None else g.pivot(time)
    return out.agg(F.avg("value"))


# Canonical placement: keys first, family after model, ssp after scenario,
# scale after region.
_ORDER = ("model", "model_family", "scenario", "ssp_family", "scenario_category",
          "region", "region_scale", "variable", "unit", "year")


def place_columns(df: DataFrame) -> DataFrame:
    first = [c for c in _ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def extract_marker(long: DataFrame, model: str, scenario: str, region: str,
                   targets: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One reference series as a year x target table of non-null values."""
    one = long.where((F.col("model") == model) & (F.col("scenario") == scenario)
                     & (F.col("region") == region) & F.col("variable").isin(list(targets))
                     & F.col("value").isNotNull())
    return (pivot_variables(one, targets, ["model"], names=names)
            .drop("model").orderBy("year"))
