"""Cleaning, selection and quality reports of raw scenario tables.

Dimension joins use broadcast only for tables whose size is fixed by their
definition (metadata dimensions, rule tables).  Tables derived from the data
(variable counts, model base years) are bounded by the catalogue size but
left to AQE, which broadcasts them once their runtime size is known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale


def variable_counts(raw: DataFrame, variable: str = "variable") -> DataFrame:
    """Rows per variable over all raw files, most frequent first."""
    return raw.groupBy(variable).agg(F.count("*").alias("count")).orderBy(F.desc("count"), variable)


def join_classification(counts: DataFrame, classification: DataFrame,
                        variable: str = "variable") -> DataFrame:
    """Attach type and model type (left join); the first row of a repeated variable counts."""
    return counts.join(first_rows(classification, [variable]), variable, "left")


def select_variables(classified: DataFrame, min_count: int | None, outputs: Sequence[str],
                     include_intermediate: bool = False, default_min_count: int = 10100,
                     variable: str = "variable") -> DataFrame:
    """count >= min and (input, or an output, or optionally intermediate).

    ``min_count`` None means "use the default"; 0 keeps every count.
    """
    m = default_min_count if min_count is None else min_count
    keep = (F.col("type") == "input") | F.col(variable).isin(list(outputs))
    if include_intermediate:
        keep = keep | (F.col("type") == "intermediate")
    return classified.where((F.col("count") >= m) & keep)


def keep_selected(raw: DataFrame, selected: DataFrame, variable: str = "variable") -> DataFrame:
    """Rows whose variable is selected (left-semi join)."""
    return raw.join(selected.select(variable), variable, "left_semi")


def join_scenario_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join the category per scenario; the first row of a repeated scenario counts."""
    return df.join(first_rows(categories, ["scenario"]), "scenario", "left")


def first_rows(dim: DataFrame, keys: Sequence[str], order: str = "file_order") -> DataFrame:
    """One row per key, so that a join never repeats rows: the first by ``order`` if the table has it,
    else the smallest by its other columns. Left to AQE to broadcast by its measured size."""
    by = order if order in dim.columns else None
    others = [c for c in dim.columns if c not in keys and c != by]
    first = F.min(F.struct(*([F.col(by)] if by else []), *[F.col(c) for c in others])).alias("_f")
    return dim.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in others])


def join_ssp_family(df: DataFrame, ssp: DataFrame, order: str = "file_order") -> DataFrame:
    """Left join the SSP family per (model, scenario), first row of a duplicate key wins."""
    need = {"model", "scenario", "ssp_family"}
    if not need.issubset(ssp.columns):
        raise KeyError(f"SSP families metadata missing columns: {sorted(need - set(ssp.columns))}")
    dim = first_rows(ssp, ["model", "scenario"], order)
    return df.join(dim, ["model", "scenario"], "left")


def normalise_units(long: DataFrame, rules: DataFrame, unit: str = "unit",
                    value: str = "value") -> DataFrame:
    """Apply unit conversion rules (factor and new unit) by a broadcast rule join."""
    r = rules.select(F.col("unit").alias("_u"), "factor", "new_unit")
    j = long.join(F.broadcast(r), long[unit] == F.col("_u"), "left")
    out = [(F.col(value) * F.coalesce(F.col("factor"), F.lit(1.0))).alias(value) if c == value
           else F.coalesce(F.col("new_unit"), F.col(unit)).alias(unit) if c == unit
           else F.col(c) for c in long.columns]
    return j.select(*out)


def unit_conflicts(long: DataFrame, keys: Sequence[str] = ("model", "scenario", "region", "variable"),
                   unit: str = "unit", strict: bool = False) -> DataFrame:
    """Keys carrying more than one (non-null) unit; strict mode raises."""
    bad = long.groupBy(*keys).agg(F.count_distinct(unit).alias("n_units")).where(F.col("n_units") > 1)
    if strict and bad.limit(1).count() > 0:
        raise ValueError("unit mismatch found")
    return bad


def unit_table(raw: DataFrame, year_cols: Sequence[str]) -> DataFrame:
    """All non-year columns (unit included)."""
    return raw.select(*[c for c in raw.columns if c not in set(year_cols)])


def effective_base_year(panel: DataFrame, base_years: DataFrame, default_year: int = 2020,
                        none_year: int = 10000) -> DataFrame:
    """Per model: declared base year (else default), raised to the first available year >= it.

    ``base_years`` (model, base_year text) may hold blanks or duplicates; the
    first parsable value per model is used (by ``file_order`` if the table has it, else by its text).  Models with no year at or after
    the candidate get ``none_year``.
    """
    order = F.col("file_order") if "file_order" in base_years.columns else F.col("base_year")
    declared = base_years.select("model", F.expr("try_cast(trim(base_year) AS INT)").alias("_b"), order.alias("_o")) \
        .where(F.col("_b").isNotNull()).groupBy("model").agg(F.min_by("_b", "_o").alias("_b"))
    years = panel.select("model", "year").where(F.col("year").isNotNull()).distinct()
    j = years.join(declared, "model", "left") \
        .withColumn("_cand", F.coalesce(F.col("_b"), F.lit(default_year)))
    return j.groupBy("model").agg(
        F.first("_cand").alias("candidate"),
        F.coalesce(F.min(F.when(F.col("year") >= F.col("_cand"), F.col("year"))),
                   F.lit(none_year)).alias("effective_base_year"))


def filter_from_base_year(panel: DataFrame, effective: DataFrame) -> DataFrame:
    """Drop rows before the model's effective base year."""
    e = effective.select("model", "effective_base_year")
    return panel.join(e, "model").where(F.col("year") >= F.col("effective_base_year")) \
                .drop("effective_base_year")


def base_year_report(panel: DataFrame, effective: DataFrame) -> DataFrame:
    """One row: rows before, rows dropped by the base-year filter, rows kept."""
    e = effective.select("model", "effective_base_year")
    before = F.col("year") < F.col("effective_base_year")
    return panel.join(e, "model", "left").agg(
        F.count("*").alias("rows_before"),
        F.sum(F.coalesce(before, F.lit(True)).cast("long")).alias("rows_dropped"),
        F.sum((~F.coalesce(before, F.lit(True))).cast("long")).alias("rows_kept"))


def completeness_filter(wide: DataFrame, variables: Sequence[str], ratio: float,
                        n_key_columns: int) -> DataFrame:
    """Keep rows with ``n_key_columns + non-null variables >= int(n_vars * ratio)``.

    The key columns count as in the source pipeline (they are never null).
    """
    if not (0.0 < ratio <= 1.0):
        raise ValueError("ratio must be in (0, 1]")
    threshold = int(len(variables) * ratio)
    nn = sum(F.col(v).isNotNull().cast("int") for v in variables)
    return wide.where(F.lit(n_key_columns) + nn >= threshold)


def missing_stats(wide: DataFrame, variables: Sequence[str], counts: DataFrame,
                  labels: Sequence[str] | None = None) -> DataFrame:
    """Percent NULL per variable, left-joined onto the variable counts."""
    labels = list(labels) if labels is not None else list(variables)
    pct = wide.agg(*[(F.avg(F.col(v).isNull().cast("double")) * 100.0).alias(l)
                     for v, l in zip(variables, labels)])
    long = pct.unpivot([], labels, "variable", "pct_missing")
    return counts.join(long, "variable", "left")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and percent missing (one aggregate)."""
    n_cols = len(df.columns)
    nulls = sum(F.col(f"`{c}`").isNull().cast("long") for c in df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(nulls).alias("missing_cells")) \
             .select("rows", F.lit(n_cols).cast("long").alias("columns"),
                     F.coalesce(F.col("missing_cells"), F.lit(0)).alias("missing_cells"),
                     F.when(F.col("rows") > 0, F.col("missing_cells") * 100.0 / (F.col("rows") * n_cols))
                      .alias("pct_missing"))


def missing_matrix(long: DataFrame, keys: Sequence[str], time: str = "year",
                   variable: str = "variable", value: str = "value") -> DataFrame:
    """NULL pattern per variable x year over the series-by-variable grid.

    A cell is missing when a series has the variable but no value for that
    year.  The grid is rectangular: every variable with every year of the data,
    a cell without any row counting all its series as missing.
    """
    per_var = long.select(*keys, variable).distinct().groupBy(variable) \
        .agg(F.count("*").alias("total"))
    present = long.groupBy(variable, time).agg(
        F.count_distinct(F.when(F.col(value).isNotNull(), F.struct(*keys))).alias("present"))
    years = long.where(F.col(time).isNotNull()).agg(F.sort_array(F.collect_set(time)).alias("_years"))  # one row
    grid = per_var.crossJoin(F.broadcast(years)).select(variable, "total", F.explode("_years").alias(time))
    return grid.join(present, [variable, time], "left") \
        .select(variable, time, "total", F.coalesce("present", F.lit(0)).cast("long").alias("present")).select(variable, time, "total", "present",
                (F.col("total") - F.col("present")).alias("missing"))


def add_family_and_scale(df: DataFrame) -> DataFrame:
    return df.select("*", model_family("model").alias("model_family"),
                     region_scale("region").alias("region_scale"))
