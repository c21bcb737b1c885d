"""Metric tables (H1-H7) and slicing / label queries.

Predictions here are the naive forecast (last step's value); the model
queries (G) feed the same operators with fitted predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale
from ..operators import features as D
from ..operators import metrics as H
from ..operators import quality as Q
from ..operators import slicing as I
from ..operators.reshape import unpivot_variables
from ..plans.base import KEYS, TARGETS, VARS, quarterly_wide, yearly_wide
from ..plans.prepare import prepare_sequence, prepare_tabular
from ..sources import dims, panels
from ..sources.panels import with_panels
from . import register
from .sqlfrag import (METRIC_DOUBLES, MODEL_FAMILY_SQL, REGION_SCALE_SQL, REGION_TYPE_SQL,
                      feature_label_sql, interp_select, lags_select, metric_aggs,
                      metrics_by_region_type_sql, nn, short_number_sql, stack_sql)

PREV = [f"prev_{t}" for t in TARGETS]
PART = "PARTITION BY model, scenario, region ORDER BY year"
EV = with_panels("yearly_wide") + f""",
ev AS (SELECT w.*, {MODEL_FAMILY_SQL.replace('model', 'w.model')} AS model_family,
         {REGION_SCALE_SQL.replace('region', 'w.region')} AS region_scale, d.scenario_category,
         {', '.join(f'lag(w.{t}) OVER (PARTITION BY w.model, w.scenario, w.region ORDER BY w.year) AS prev_{t}' for t in TARGETS)}
       FROM yearly_wide w LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON w.scenario = d.scenario)"""
EV_DOUBLES = VARS + PREV


def ev(spark, sf_dir):
    w = yearly_wide(spark, sf_dir).select("*", model_family("model").alias("model_family"),
                                          region_scale("region").alias("region_scale"))
    w = Q.join_scenario_category(w, dims.scenario_category(spark))
    return D.add_lags(w, TARGETS, 1, KEYS)


_YW_COLS = list(KEYS) + ["year"] + VARS
_TAB = with_panels("yearly_wide") + f""",
filled AS ({interp_select('yearly_wide', TARGETS, _YW_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2),
tab AS (SELECT * FROM hist WHERE {nn(TARGETS)})"""


@register("h1_metrics", _TAB + f" SELECT {metric_aggs(3)} FROM ({stack_sql('tab', TARGETS, PREV)}) s",
          doubles=METRIC_DOUBLES)
def h1_metrics(spark, sf_dir):
    tab = prepare_tabular(yearly_wide(spark, sf_dir), TARGETS, KEYS, n_lags=2)
    return H.metrics(tab, TARGETS, PREV)


_QW_COLS = list(KEYS) + ["year"] + VARS
_SEQ = with_panels("quarterly_wide") + f""",
filled AS ({interp_select('quarterly_wide', TARGETS, _QW_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2),
seq AS (SELECT * FROM hist WHERE {nn(TARGETS)})"""


@register("h2_metrics_by_region_type", _SEQ + " " + metrics_by_region_type_sql("seq", TARGETS, PREV),
          doubles=METRIC_DOUBLES)
def h2_metrics_by_region_type(spark, sf_dir):
    seq = prepare_sequence(quarterly_wide(spark, sf_dir), TARGETS, KEYS, n_lags=2)
    return H.metrics_by_region_type(seq, TARGETS, PREV)


@register("h3_r2_per_target", EV + f""" SELECT target, count(*) AS n,
  CASE WHEN count(*) >= 2 AND var_pop(y) * count(*) > 0
       THEN 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2
FROM ({stack_sql('ev', TARGETS, PREV)}) s WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY target""",
          doubles=["r2"])
def h3_r2_per_target(spark, sf_dir):
    return H.r2_per_target(ev(spark, sf_dir), TARGETS, PREV)


_SLICE = "scenario_category IN ('C3') AND region IN ('World')"


@register("h4_sliced_metrics", EV + f""" SELECT count(*) AS count,
  CASE WHEN var_pop(y) * count(*) > 0 THEN 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2,
  avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  avg(CASE WHEN abs(y) > 1e-12 THEN abs((y - p) / y) END) * 100 AS mape_pct
FROM ({stack_sql(f'(SELECT * FROM ev WHERE {_SLICE})', TARGETS, PREV)}) s
WHERE y IS NOT NULL AND p IS NOT NULL""", doubles=["r2", "mae", "rmse", "mape_pct"])
def h4_sliced_metrics(spark, sf_dir):
    sliced = I.slice_rows(ev(spark, sf_dir), categories=["C3"], regions=["World"])
    return H.sliced_metrics(sliced, TARGETS, PREV)


@register("h5_valid_pairs", EV + " SELECT * FROM ev WHERE economy IS NOT NULL AND prev_economy IS NOT NULL",
          doubles=EV_DOUBLES)
def h5_valid_pairs(spark, sf_dir):
    return H.valid_pairs(ev(spark, sf_dir), "economy", "prev_economy")


@register("h6_trajectory_table", EV + f""" SELECT model, scenario, region, year, target, y AS truth,
  p AS prediction, p - y AS gap FROM ({stack_sql('ev', TARGETS, PREV, keep=['model', 'scenario', 'region', 'year'])}) s""",
          doubles=["truth", "prediction", "gap"])
def h6_trajectory_table(spark, sf_dir):
    return H.trajectory_table(ev(spark, sf_dir), KEYS, TARGETS, PREV)


@register("h7_scatter_table", EV + f""",
s AS (SELECT * FROM ({stack_sql('ev', TARGETS, PREV, keep=['year'])}) x WHERE y IS NOT NULL AND p IS NOT NULL),
pt AS (SELECT target, year, count(*) AS points, avg(y) AS mean_truth, avg(p) AS mean_pred FROM s GROUP BY target, year),
tg AS (SELECT target, least(min(y), min(p)) AS axis_min, greatest(max(y), max(p)) AS axis_max,
  CASE WHEN count(*) >= 2 AND var_pop(y) * count(*) > 0
       THEN 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2 FROM s GROUP BY target)
SELECT pt.*, tg.axis_min, tg.axis_max, tg.r2 FROM pt JOIN tg ON pt.target = tg.target""",
          doubles=["mean_truth", "mean_pred", "axis_min", "axis_max", "r2"])
def h7_scatter_table(spark, sf_dir):
    return H.scatter_table(ev(spark, sf_dir), TARGETS, PREV)


# ---------------------------------------------------------------- I

@register("i1_filter_options", EV + f""",
opts AS (SELECT DISTINCT 'scenario_category' AS kind, scenario_category AS value, 0 AS grp FROM ev
         UNION ALL SELECT DISTINCT 'model_family', model_family, 0 FROM ev
         UNION ALL SELECT DISTINCT 'region', region,
           CAST(list_position(['ISO', 'R10', 'R6', 'R5', 'World'], {REGION_TYPE_SQL}) AS INT) FROM ev
           WHERE region IS NOT NULL)
SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY grp, value ASC NULLS FIRST) - 1 AS INT)
  AS position FROM opts""")
def i1_filter_options(spark, sf_dir):
    return I.filter_options(ev(spark, sf_dir))


@register("i2_slice_rows", EV + """ SELECT * FROM ev WHERE scenario_category IN ('C3')
  AND region IN ('World', 'EU') AND model_family IN ('F1', 'F2')""", doubles=EV_DOUBLES)
def i2_slice_rows(spark, sf_dir):
    return I.slice_rows(ev(spark, sf_dir), ["C3"], ["World", "EU"], ["F1", "F2"])


def _region_filter_sql(target: str, mode: str) -> str:
    s = "lower(trim(CAST(region AS VARCHAR)))"
    if mode == "prefix":
        return EV + f""", f AS (SELECT max(starts_with({s}, '{target}')) AS _p FROM ev)
SELECT ev.* FROM ev CROSS JOIN f WHERE CASE WHEN _p THEN starts_with({s}, '{target}') ELSE true END"""
    return EV + f""", f AS (SELECT max({s} = '{target}') AS _e, max(contains({s}, '{target}')) AS _c FROM ev)
SELECT ev.* FROM ev CROSS JOIN f
WHERE CASE WHEN _e THEN {s} = '{target}' WHEN _c THEN contains({s}, '{target}') ELSE true END"""


@register("i3_filter_region_exact", _region_filter_sql("world", "exact"), doubles=EV_DOUBLES)
def i3_filter_region_exact(spark, sf_dir):
    return I.filter_region(ev(spark, sf_dir), " World ", "exact")


@register("i3_filter_region_contains", _region_filter_sql("afr", "exact"), doubles=EV_DOUBLES)
def i3_filter_region_contains(spark, sf_dir):
    return I.filter_region(ev(spark, sf_dir), "AFR", "exact")


@register("i3_filter_region_unmatched", _region_filter_sql("atlantis", "exact"), doubles=EV_DOUBLES)
def i3_filter_region_unmatched(spark, sf_dir):
    return I.filter_region(ev(spark, sf_dir), "Atlantis", "exact")


@register("i3_filter_region_prefix", _region_filter_sql("r", "prefix"), doubles=EV_DOUBLES)
def i3_filter_region_prefix(spark, sf_dir):
    return I.filter_region(ev(spark, sf_dir), "R", "prefix")


# Name forms of a feature: prefix and suffix around each variable of the panel.
_FORMS = [(p, s) for p in ("", "prev_", "prev2_", "timestep_0_", "timestep_3_", "timestep_2_prev_") for s in ("", "_is_missing")]


@register("i4_feature_label", with_panels("panel_yearly") + f"""
SELECT feature, {feature_label_sql('feature')} AS label FROM (
  SELECT a || lower(variable) || b AS feature FROM (SELECT DISTINCT variable FROM panel_yearly) v
  CROSS JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _FORMS)}) t(a, b)) f""")
def i4_feature_label(spark, sf_dir):
    """Every name form of every variable of the panel, with its label."""
    stem = F.lower("variable")
    forms = F.array(*[F.concat(F.lit(a), stem, F.lit(b)) for a, b in _FORMS])
    names = panels.panel_yearly(spark, sf_dir).select("variable").distinct()
    return I.label_features(names.select(F.explode(forms).alias("feature")))


@register("i5_short_number", with_panels("panel_yearly") + f"""
SELECT variable, year, sum(value) AS total, {short_number_sql('sum(value)')} AS text
FROM panel_yearly GROUP BY variable, year
UNION ALL
SELECT DISTINCT variable, year, value AS total, {short_number_sql('value')} AS text FROM panel_yearly""",
          doubles=["total"])
def i5_short_number(spark, sf_dir):
    p = panels.panel_yearly(spark, sf_dir)
    totals = p.groupBy("variable", "year").agg(F.sum("value").alias("total"))
    values = p.select("variable", "year", F.col("value").alias("total")).distinct()
    return I.label_numbers(totals.unionByName(values), "total")


@register("i3_matched_values", _region_filter_sql("afr", "exact").replace("SELECT ev.* FROM ev CROSS JOIN f",
          "SELECT DISTINCT ev.region FROM ev CROSS JOIN f"))
def i3_matched_values(spark, sf_dir):
    return I.matched_values(I.filter_region(ev(spark, sf_dir), "AFR", "exact"))
