"""Sources (A1, A2), reshape (B) and cleaning / quality (C) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale
from ..operators import quality as Q
from ..operators.reshape import (coerce_numeric, extract_marker, place_columns, pivot_years,
                                 unpivot_years, year_columns)
from ..plans.base import KEYS, TARGETS, VARS, ragged_wide, yearly_wide
from ..plans.build import BuildSpec, build_panel
from ..session import shared_dir, stored
from ..sources import dims, files, panels
from ..sources.panels import FIXTURE_YEARS, with_panels
from . import register
from .q_core import FLAGSHIP_SQL, flagship
from .sqlfrag import METRIC_DOUBLES, MODEL_FAMILY_SQL, REGION_SCALE_SQL

YEARS = FIXTURE_YEARS
UP_TARGETS = panels.TARGETS
MIN_COUNT = 100
MARKER = ("F0-Brand#10 1.0", "AUTOMOBILE", "World")


def _quote_years(prefix=""):
    return ", ".join(f'{prefix}"{y}"' for y in YEARS)


def _unpivot_raw_sql(src: str, ids: str, cast_value: bool = True) -> str:
    v = (lambda y: f'TRY_CAST("{y}" AS DOUBLE)') if cast_value else (lambda y: f'"{y}"')
    return "\nUNION ALL\n".join(
        f"SELECT {ids}, CAST({y} AS INT) AS year, {v(y)} AS value FROM {src}" for y in YEARS)


# ---------------------------------------------------------------- A1, A2

@register("a1_read_raw_wide", with_panels("raw_wide") + " SELECT * FROM raw_wide")
def a1_read_raw_wide(spark, sf_dir):
    """Write the raw wide table as one CSV per region scale, read all back, concatenate."""
    raw = panels.raw_wide_yearly(spark, sf_dir).withColumn("_scale", region_scale("region"))
    root = shared_dir(spark, "raw")
    paths = files.write_raw_wide(raw, root, "_scale", ["ISO3", "R10", "R6", "R5", "World"])
    return files.read_raw_wide(spark, paths)


@register("a2_read_dimension", with_panels("panel_yearly") + f"""
SELECT p.scenario, d.scenario_category, count(*) AS rows
FROM panel_yearly p LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON p.scenario = d.scenario
GROUP BY p.scenario, d.scenario_category""")
def a2_read_dimension(spark, sf_dir):
    """Read a lookup CSV with padded header names and use it on the panel."""
    path = shared_dir(spark, "dim")
    dims.scenario_category(spark).toDF(" scenario ", "scenario_category  ") \
        .coalesce(1).write.option("header", True).csv(path)
    dim = files.read_dimension(spark, path, ["scenario", "scenario_category"])
    p = panels.panel_yearly(spark, sf_dir)
    return Q.join_scenario_category(p, dim).groupBy("scenario", "scenario_category") \
        .agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- B

@register("b1_unpivot_years", with_panels("raw_wide") + "\n"
          + _unpivot_raw_sql("raw_wide", "model, scenario, region, variable, unit"),
          doubles=("value",))
def b1_unpivot_years(spark, sf_dir):
    return unpivot_years(panels.raw_wide_yearly(spark, sf_dir), max_year=2100)


@register("b2_pivot_variables", with_panels("yearly_wide") + " SELECT * FROM yearly_wide",
          doubles=VARS)
def b2_pivot_variables(spark, sf_dir):
    return yearly_wide(spark, sf_dir)


_LONG_FROM_WIDE = "\nUNION ALL\n".join(
    f"SELECT model, scenario, region, year, '{v}' AS variable, {v} AS value FROM yearly_wide"
    for v in VARS)


@register("b3_pivot_years", with_panels("yearly_wide") + f""",
long AS ({_LONG_FROM_WIDE})
SELECT model, scenario, region, variable,
  {', '.join(f'avg(value) FILTER (WHERE year = {y}) AS "{y}"' for y in YEARS)}
FROM long WHERE value IS NOT NULL GROUP BY model, scenario, region, variable""",
          doubles=[str(y) for y in YEARS])
def b3_pivot_years(spark, sf_dir):
    return pivot_years(yearly_wide(spark, sf_dir), VARS, KEYS)


@register("b4_coerce_numeric", with_panels("raw_wide") + f"""
SELECT model, scenario, region, variable, unit,
  {', '.join(f'TRY_CAST("{y}" AS DOUBLE) AS "{y}"' for y in YEARS)} FROM raw_wide""",
          doubles=[str(y) for y in YEARS])
def b4_coerce_numeric(spark, sf_dir):
    raw = panels.raw_wide_yearly(spark, sf_dir)
    return coerce_numeric(raw, year_columns(raw))


@register("b5_place_columns", with_panels("yearly_wide") + f"""
SELECT w.model, {MODEL_FAMILY_SQL} AS model_family, w.scenario, d.scenario_category, w.region,
  {REGION_SCALE_SQL} AS region_scale, w.year, {', '.join('w.' + v for v in VARS)}
FROM yearly_wide w LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON w.scenario = d.scenario""",
          doubles=VARS)
def b5_place_columns(spark, sf_dir):
    w = Q.join_scenario_category(yearly_wide(spark, sf_dir), dims.scenario_category(spark))
    return place_columns(Q.add_family_and_scale(w))


@register("b6_extract_marker", with_panels("panel_yearly") + f"""
SELECT year, {', '.join(f"avg(value) FILTER (WHERE variable = '{t}') AS {t.lower()}" for t in UP_TARGETS)}
FROM panel_yearly WHERE model = '{MARKER[0]}' AND scenario = '{MARKER[1]}' AND region = '{MARKER[2]}'
  AND variable IN ({', '.join(repr(t) for t in UP_TARGETS)}) AND value IS NOT NULL
GROUP BY year""", doubles=TARGETS)
def b6_extract_marker(spark, sf_dir):
    return extract_marker(panels.panel_yearly(spark, sf_dir), *MARKER, targets=UP_TARGETS)


# ---------------------------------------------------------------- C

_COUNTS_SQL = "counts AS (SELECT variable, count(*) AS count FROM raw_wide GROUP BY variable)"
_CLASSIFIED_SQL = (f"classified AS (SELECT c.variable, c.count, v.type, v.model_type FROM counts c "
                   f"LEFT JOIN {dims.VARIABLE_CLASS_SQL} v ON c.variable = v.variable)")
_OUT_LIST = ", ".join(repr(t) for t in UP_TARGETS)
_SELECTED_SQL = (f"selected AS (SELECT * FROM classified WHERE count >= {MIN_COUNT} "
                 f"AND (type = 'input' OR variable IN ({_OUT_LIST})))")


def _classified(spark, sf_dir):
    raw = panels.raw_wide_yearly(spark, sf_dir)
    return raw, Q.join_classification(Q.variable_counts(raw), dims.variable_class(spark))


@register("c1_variable_counts", with_panels("raw_wide") + f", {_COUNTS_SQL} SELECT * FROM counts")
def c1_variable_counts(spark, sf_dir):
    return Q.variable_counts(panels.raw_wide_yearly(spark, sf_dir))


@register("c2_join_classification",
          with_panels("raw_wide") + f", {_COUNTS_SQL}, {_CLASSIFIED_SQL} SELECT * FROM classified")
def c2_join_classification(spark, sf_dir):
    return _classified(spark, sf_dir)[1]


@register("c3_select_variables", with_panels("raw_wide")
          + f", {_COUNTS_SQL}, {_CLASSIFIED_SQL}, {_SELECTED_SQL} SELECT * FROM selected")
def c3_select_variables(spark, sf_dir):
    return Q.select_variables(_classified(spark, sf_dir)[1], MIN_COUNT, UP_TARGETS)


@register("c4_keep_selected", with_panels("raw_wide")
          + f", {_COUNTS_SQL}, {_CLASSIFIED_SQL}, {_SELECTED_SQL} "
          "SELECT * FROM raw_wide WHERE variable IN (SELECT variable FROM selected)")
def c4_keep_selected(spark, sf_dir):
    raw, classified = _classified(spark, sf_dir)
    return Q.keep_selected(raw, Q.select_variables(classified, MIN_COUNT, UP_TARGETS))


@register("c5_join_scenario_category", with_panels("panel_yearly") + f"""
SELECT p.*, d.scenario_category FROM panel_yearly p
LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON p.scenario = d.scenario""", doubles=("value",))
def c5_join_scenario_category(spark, sf_dir):
    return Q.join_scenario_category(panels.panel_yearly(spark, sf_dir), dims.scenario_category(spark))


@register("c6_join_ssp_family", with_panels("yearly_wide") + f""",
ssp AS (SELECT model, scenario, arg_min(ssp_family, file_order) AS ssp_family
        FROM {dims.SSP_FAMILY_SQL} GROUP BY model, scenario)
SELECT w.*, s.ssp_family FROM yearly_wide w LEFT JOIN ssp s
  ON w.model = s.model AND w.scenario = s.scenario""", doubles=VARS)
def c6_join_ssp_family(spark, sf_dir):
    return Q.join_ssp_family(yearly_wide(spark, sf_dir), dims.ssp_family(spark))


@register("c7_normalise_units", with_panels("panel_yearly") + f"""
SELECT p.model, p.scenario, p.region, p.variable, coalesce(r.new_unit, p.unit) AS unit, p.year,
  p.value * coalesce(r.factor, 1.0) AS value
FROM panel_yearly p LEFT JOIN {dims.UNIT_RULES_SQL} r ON p.unit = r.unit""", doubles=("value",))
def c7_normalise_units(spark, sf_dir):
    return Q.normalise_units(panels.panel_yearly(spark, sf_dir), dims.unit_rules(spark))


@register("c8_unit_conflicts", with_panels("panel_yearly") + """
SELECT model, scenario, region, variable, count(DISTINCT unit) AS n_units FROM panel_yearly
GROUP BY model, scenario, region, variable HAVING count(DISTINCT unit) > 1""")
def c8_unit_conflicts(spark, sf_dir):
    return Q.unit_conflicts(panels.panel_yearly(spark, sf_dir))


@register("c9_unit_table", with_panels("raw_wide")
          + " SELECT model, scenario, region, variable, unit FROM raw_wide")
def c9_unit_table(spark, sf_dir):
    raw = panels.raw_wide_yearly(spark, sf_dir)
    return Q.unit_table(raw, year_columns(raw))


def _base_years_sql(default: int) -> str:
    return f"""models AS (SELECT DISTINCT model FROM panel_yearly),
declared AS (SELECT m.model, TRY_CAST(trim(b.base_year) AS INT) AS b FROM models m
  LEFT JOIN {dims.BASE_YEAR_BY_FAMILY_SQL} b ON {MODEL_FAMILY_SQL.replace('model', 'm.model')} = b.model_family),
yrs AS (SELECT DISTINCT model, year FROM panel_yearly),
eff AS (SELECT y.model, any_value(coalesce(d.b, {default})) AS candidate,
  coalesce(min(CASE WHEN y.year >= coalesce(d.b, {default}) THEN y.year END), 10000) AS effective_base_year
  FROM yrs y LEFT JOIN declared d ON y.model = d.model GROUP BY y.model)"""


def _effective(spark, sf_dir, default):
    p = panels.panel_yearly(spark, sf_dir)
    return Q.effective_base_year(p, dims.base_years_for_models(spark, p), default)


@register("c10_effective_base_year",
          with_panels("panel_yearly") + ", " + _base_years_sql(2020) + " SELECT * FROM eff")
def c10_effective_base_year(spark, sf_dir):
    return _effective(spark, sf_dir, 2020)


@register("c10_effective_base_year_default_1998",
          with_panels("panel_yearly") + ", " + _base_years_sql(1998) + " SELECT * FROM eff")
def c10_effective_base_year_1998(spark, sf_dir):
    return _effective(spark, sf_dir, 1998)


@register("c11_filter_from_base_year", with_panels("yearly_wide") + ", " + _base_years_sql(1998)
          + " SELECT w.* FROM yearly_wide w JOIN eff e ON w.model = e.model "
            "WHERE w.year >= e.effective_base_year", doubles=VARS)
def c11_filter_from_base_year(spark, sf_dir):
    eff = _effective(spark, sf_dir, 1998)
    return Q.filter_from_base_year(yearly_wide(spark, sf_dir), eff)


@register("c12_completeness_filter", with_panels("ragged_wide") + f"""
SELECT * FROM ragged_wide WHERE {' + '.join(f'CAST({v} IS NOT NULL AS INT)' for v in VARS)} >= 3""",
          doubles=VARS)
def c12_completeness_filter(spark, sf_dir):
    return Q.completeness_filter(ragged_wide(spark, sf_dir), VARS, 0.5, n_key_columns=0)


_PCT_SQL = " UNION ALL ".join(
    f"SELECT '{v.upper()}' AS variable, avg(CASE WHEN {v} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 "
    f"AS pct_missing FROM yearly_wide" for v in VARS)


@register("c13_missing_stats", with_panels("raw_wide", "yearly_wide")
          + f", {_COUNTS_SQL}, {_CLASSIFIED_SQL}, pct AS ({_PCT_SQL}) "
          "SELECT c.*, p.pct_missing FROM classified c LEFT JOIN pct p ON c.variable = p.variable",
          doubles=("pct_missing",))
def c13_missing_stats(spark, sf_dir):
    _, classified = _classified(spark, sf_dir)
    return Q.missing_stats(yearly_wide(spark, sf_dir), VARS, classified, labels=panels.VARIABLES)


_NULLS_SQL = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in list(KEYS) + ["year"] + VARS)


@register("c14_dataset_summary", with_panels("yearly_wide") + f"""
SELECT count(*) AS rows, CAST({len(KEYS) + 1 + len(VARS)} AS BIGINT) AS columns,
  CAST(coalesce(sum({_NULLS_SQL}), 0) AS BIGINT) AS missing_cells,
  CASE WHEN count(*) > 0 THEN sum({_NULLS_SQL}) * 100.0 / (count(*) * {len(KEYS) + 1 + len(VARS)}) END AS pct_missing
FROM yearly_wide""", doubles=("pct_missing",))
def c14_dataset_summary(spark, sf_dir):
    return Q.dataset_summary(yearly_wide(spark, sf_dir))


@register("c15_missing_matrix", with_panels("panel_ragged") + """,
per_var AS (SELECT variable, count(*) AS total FROM (SELECT DISTINCT model, scenario, region, variable
            FROM panel_ragged) GROUP BY variable),
present AS (SELECT variable, year, count(DISTINCT CASE WHEN value IS NOT NULL
            THEN model || '|' || scenario || '|' || region END) AS present FROM panel_ragged GROUP BY variable, year)
SELECT v.variable, y.year, v.total, coalesce(p.present, 0) AS present, v.total - coalesce(p.present, 0) AS missing
FROM per_var v CROSS JOIN (SELECT DISTINCT year FROM panel_ragged) y
LEFT JOIN present p ON p.variable = v.variable AND p.year = y.year""")
def c15_missing_matrix(spark, sf_dir):
    return Q.missing_matrix(panels.panel_ragged(spark, sf_dir), KEYS)


@register("c16_model_family", with_panels("panel_yearly")
          + f" SELECT DISTINCT model, {MODEL_FAMILY_SQL} AS model_family FROM panel_yearly")
def c16_model_family(spark, sf_dir):
    return panels.panel_yearly(spark, sf_dir).select("model").distinct() \
        .select("model", model_family("model").alias("model_family"))


@register("c17_region_scale", with_panels("panel_yearly")
          + f" SELECT DISTINCT region, {REGION_SCALE_SQL} AS region_scale FROM panel_yearly")
def c17_region_scale(spark, sf_dir):
    return panels.panel_yearly(spark, sf_dir).select("region").distinct() \
        .select("region", region_scale("region").alias("region_scale"))


_SEL_VARS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
_C18_KEYS = "model, scenario, scenario_category, region, year"
_C18_SQL = with_panels("raw_wide") + f""", {_COUNTS_SQL}, {_CLASSIFIED_SQL}, {_SELECTED_SQL},
kept AS (SELECT * FROM raw_wide WHERE variable IN (SELECT variable FROM selected)),
withcat AS (SELECT k.*, d.scenario_category FROM kept k LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d
            ON k.scenario = d.scenario),
long AS ({_unpivot_raw_sql('withcat', 'model, scenario, region, variable, unit, scenario_category')}),
norm AS (SELECT l.model, l.scenario, l.scenario_category, l.region, l.variable, l.year,
         l.value * coalesce(r.factor, 1.0) AS value
         FROM long l LEFT JOIN {dims.UNIT_RULES_SQL} r ON l.unit = r.unit),
wide AS (SELECT {_C18_KEYS},
  {', '.join(f"avg(value) FILTER (WHERE variable = '{v}') AS {v.lower()}" for v in _SEL_VARS)}
  FROM norm WHERE model IS NOT NULL AND scenario IS NOT NULL AND scenario_category IS NOT NULL
    AND region IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL
    AND variable IN ({', '.join(repr(v) for v in _SEL_VARS)})
  GROUP BY {_C18_KEYS}),
models AS (SELECT DISTINCT model FROM wide),
declared AS (SELECT m.model, TRY_CAST(trim(b.base_year) AS INT) AS b FROM models m
  LEFT JOIN {dims.BASE_YEAR_BY_FAMILY_SQL} b ON {MODEL_FAMILY_SQL.replace('model', 'm.model')} = b.model_family),
yrs AS (SELECT DISTINCT model, year FROM wide),
eff AS (SELECT y.model, coalesce(min(CASE WHEN y.year >= coalesce(d.b, 2020) THEN y.year END), 10000)
        AS effective_base_year FROM yrs y LEFT JOIN declared d ON y.model = d.model GROUP BY y.model)
SELECT w.* FROM wide w JOIN eff e ON w.model = e.model
WHERE w.year >= e.effective_base_year
  AND 5 + {' + '.join(f'CAST(w.{v.lower()} IS NOT NULL AS INT)' for v in _SEL_VARS)} >= {int(len(_SEL_VARS) * 0.4)}
"""


@register("c18_build_panel", _C18_SQL, doubles=[v.lower() for v in _SEL_VARS])
def c18_build_panel(spark, sf_dir):
    # the raw tables are read by several passes (counts, selection, base years)
    raw = stored(panels.raw_wide_yearly(spark, sf_dir))
    spec = BuildSpec(outputs=UP_TARGETS, min_count=MIN_COUNT, completeness_ratio=0.4)
    res = build_panel(spark, raw, dims.variable_class(spark), dims.scenario_category(spark),
                      dims.unit_rules(spark), dims.base_years_for_models(spark, raw), spec)
    return res.panel


# ---------------------------------------------------------------- A3-A9 (sinks and stores)

@register("a6_cache_panel", with_panels("yearly_wide") + " SELECT * FROM yearly_wide", doubles=VARS)
def a6_cache_panel(spark, sf_dir):
    """Persist the reshaped panel once (shared parquet table) and reload it for later phases."""
    path = shared_dir(spark, "panel")
    files.cache_panel(yearly_wide(spark, sf_dir), path)
    return files.load_panel(spark, path)


@register("a4_write_dataset", _C18_SQL, doubles=[v.lower() for v in _SEL_VARS])
def a4_write_dataset(spark, sf_dir):
    root = shared_dir(spark, "datasets")
    # counts, selection, base years and each written table read it
    raw = stored(panels.raw_wide_yearly(spark, sf_dir))
    spec = BuildSpec(outputs=UP_TARGETS, min_count=MIN_COUNT, completeness_ratio=0.4)
    res = build_panel(spark, raw, dims.variable_class(spark), dims.scenario_category(spark),
                      dims.unit_rules(spark), dims.base_years_for_models(spark, raw), spec)
    label = files.version_label("panel", MIN_COUNT, 0.4, ["out=3vars", "apply-base-year"],
                                include_date=False)
    files.write_dataset(spark, root, label, res.panel,
                        {"var_selected": res.selected, "unit_table": res.unit_table, "stat_table": res.stats},
                        {"min_count": MIN_COUNT, "completeness_ratio": 0.4, "output_variables": list(UP_TARGETS)})
    return files.read_processed(spark, root, label)


@register("a3_read_processed", with_panels("yearly_wide") + " SELECT * FROM yearly_wide", doubles=VARS)
def a3_read_processed(spark, sf_dir):
    root = shared_dir(spark, "datasets")
    files.write_dataset(spark, root, "v1", yearly_wide(spark, sf_dir))
    return files.read_processed(spark, root, None, default="v1")


@register("a5_register_version", with_panels("panel_yearly") + """
SELECT 'panel-' || scenario AS name, row_number() OVER (ORDER BY scenario) AS seq
FROM (SELECT DISTINCT scenario FROM panel_yearly) s""")
def a5_register_version(spark, sf_dir):
    """One version per scenario of the panel, each registered twice: the list keeps the first, in order."""
    root = shared_dir(spark, "datasets")
    names = [r.scenario for r in panels.panel_yearly(spark, sf_dir).select("scenario").distinct().orderBy("scenario").collect()]
    for name in [*names, *names]:
        files.register_version(spark, root, f"panel-{name}")
    return files.read_versions(spark, root)


@register("a8_trials_ledger", with_panels("raw_wide") + f""", {_COUNTS_SQL}
SELECT CAST(16 AS BIGINT) AS hidden_size, CAST(1 AS BIGINT) AS lstm_layers, CAST(0.1 AS DOUBLE) AS dropout,
  1.0 / CAST(count AS DOUBLE) AS learning_rate, CAST(count AS DOUBLE) AS val_loss, CAST(3 AS BIGINT) AS best_epoch,
  count AS trial_id, CAST(NULL AS VARCHAR) AS signature, 'completed' AS status, 'stage1' AS stage FROM counts""",
          doubles=("dropout", "learning_rate", "val_loss"))
def a8_trials_ledger(spark, sf_dir):
    from ..operators.model import SEARCH_KEYS
    path = shared_dir(spark, "ledger")
    c = Q.variable_counts(panels.raw_wide_yearly(spark, sf_dir))
    # one trial per variable count row (derived from the data), then a malformed line
    trials = c.select(F.lit(16).cast("long").alias("hidden_size"), F.lit(1).cast("long").alias("lstm_layers"),
                      F.lit(0.1).alias("dropout"), (F.lit(1.0) / F.col("count")).alias("learning_rate"),
                      F.col("count").cast("double").alias("val_loss"), F.lit(3).cast("long").alias("best_epoch"),
                      F.col("count").cast("long").alias("trial_id"), F.lit(None).cast("string").alias("signature"),
                      F.lit("completed").alias("status"), F.lit("stage1").alias("stage"))
    files.append_trials(trials, path)
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return files.read_trials(spark, path)


@register("a9_write_metrics", FLAGSHIP_SQL, doubles=METRIC_DOUBLES)
def a9_write_metrics(spark, sf_dir):
    """The metric table written as CSV and read back."""
    path = shared_dir(spark, "metrics")
    made = flagship(spark, sf_dir)
    files.write_metrics(made, path)
    return files.read_metrics(spark, path, made.schema)


@register("c11_base_year_report", with_panels("yearly_wide") + ", " + _base_years_sql(1998) + """
SELECT count(*) AS rows_before,
  CAST(sum(CASE WHEN e.effective_base_year IS NULL OR w.year < e.effective_base_year THEN 1 ELSE 0 END) AS BIGINT)
    AS rows_dropped,
  CAST(sum(CASE WHEN e.effective_base_year IS NULL OR w.year < e.effective_base_year THEN 0 ELSE 1 END) AS BIGINT)
    AS rows_kept
FROM yearly_wide w LEFT JOIN eff e ON w.model = e.model""")
def c11_base_year_report(spark, sf_dir):
    return Q.base_year_report(yearly_wide(spark, sf_dir), _effective(spark, sf_dir, 1998))
