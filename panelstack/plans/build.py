"""Raw wide tables -> cleaned, reshaped, filtered panel (one lazy plan).

Order as in the source pipeline: counts -> classification -> selection ->
keep -> scenario category -> units (on long form) -> pivot to variables ->
base year -> completeness -> missing stats -> series-wide table.
The only driver round trip is the list of selected variables (bounded by the
variable catalogue), needed because it becomes column names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.reshape import pivot_variables, pivot_years, place_columns, unpivot_years


@dataclass(frozen=True)
class BuildSpec:
    outputs: tuple
    min_count: int | None = None
    completeness_ratio: float = 0.4
    include_intermediate: bool = False
    max_year: int | None = None  # the build keeps every year; a cut-off belongs to the reload
    default_base_year: int = 2020
    keys: tuple = ("model", "scenario", "scenario_category", "region")
    strict_units: bool = False
    count_keys: bool = True     # whether the never-null key columns count towards completeness
    variables: tuple | None = None  # selected variables if already known


@dataclass
class BuildResult:
    panel: DataFrame            # keys + year + one column per variable
    counts: DataFrame           # variable counts with classification
    selected: DataFrame         # selected variables
    unit_table: DataFrame
    stats: DataFrame            # counts + pct_missing
    conflicts: DataFrame        # series with more than one unit
    variables: list


def build_panel(spark: SparkSession, raw: DataFrame, classification: DataFrame,
                categories: DataFrame, rules: DataFrame, base_years: DataFrame,
                spec: BuildSpec) -> BuildResult:
    counts = Q.variable_counts(raw)
    classified = Q.join_classification(counts, classification)
    selected = Q.select_variables(classified, spec.min_count, spec.outputs, spec.include_intermediate)
    if spec.variables is not None:
        variables = list(spec.variables)
    else:
        variables = sorted(r["variable"] for r in selected.select("variable").collect())
    kept = Q.keep_selected(raw, selected)
    with_cat = Q.join_scenario_category(kept, categories)
    long = unpivot_years(with_cat, max_year=spec.max_year)
    long = Q.normalise_units(long, rules)
    conflicts = Q.unit_conflicts(long.where(F.col("value").isNotNull()), strict=spec.strict_units)
    units = Q.unit_table(with_cat, [c for c in with_cat.columns if c.strip().isdigit()])
    names = [v.lower() for v in variables]
    wide = pivot_variables(long, variables, list(spec.keys), names=names)
    eff = Q.effective_base_year(wide, base_years, spec.default_base_year)
    wide = Q.filter_from_base_year(wide, eff)
    wide = Q.completeness_filter(wide, names, spec.completeness_ratio, n_key_columns=len(spec.keys) + 1 if spec.count_keys else 0)
    stats = Q.missing_stats(wide, names, classified, labels=variables)
    return BuildResult(wide, classified, selected, units, stats, conflicts, variables)


def series_wide(panel: DataFrame, names: list, ssp: DataFrame, keys=("model", "scenario", "scenario_category", "region"),
                years=None) -> DataFrame:
    """Processed series: keys, SSP and model family, region scale, variable and one column per year."""
    wide = pivot_years(panel, names, list(keys), years=years)
    return place_columns(Q.add_family_and_scale(Q.join_ssp_family(wide, ssp)))
