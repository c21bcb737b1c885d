"""Queries whose inputs reach the branch that defines an operator: conflicts, unseen values, gaps, fallbacks.

The inputs are the panels with holes cut by a rule on their keys, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import features as D
from ..operators import metrics as H
from ..operators import model as G
from ..operators import quality as Q
from ..operators import rollout as R
from ..operators import split as S
from ..operators import windows as W
from ..plans.base import KEYS, TARGETS, VARS, yearly_wide
from ..plans.build import BuildSpec, build_panel, series_wide
from ..plans.infer import scaled_rollout
from ..plans.prepare import prepare_tabular
from ..session import materialize, stored
from ..sources import dims, panels
from ..sources.panels import with_panels
from . import register
from .q_cf import _K9, synthetic
from .q_clean import _C18_KEYS, _C18_SQL, _COUNTS_SQL, _SEL_VARS, MIN_COUNT, UP_TARGETS, YEARS
from .q_encode import YP_SPLIT, yp_split
from .q_eval import _TAB, PREV
from .q_features import RP, rp_split
from .q_models import _rollout_sql, sq_split
from .q_windows import _ED_ALL, _HZ, ENC, K, MAXDEC, MINDEC, PRED, SEQ_DOUBLES, SQ, horizon, sq
from .sqlfrag import METRIC_DOUBLES, MODEL_FAMILY_SQL, REGION_SCALE_SQL, metric_aggs, split_sql, stack_sql

#: The part of the keys whose hash begins with 8 to f.
_HALF_SQL = "md5(model || scenario || region) >= '8'"


def half():
    return F.md5(F.concat(*KEYS)) >= "8"


@register("c2_join_classification_repeated", with_panels("raw_wide") + f""", {_COUNTS_SQL}
SELECT c.variable, c.count, v.type, v.model_type FROM counts c LEFT JOIN {dims.VARIABLE_CLASS_SQL} v ON c.variable = v.variable""")
def c2_join_classification_repeated(spark, sf_dir):
    """Every variable stands twice in the classification; the first of them counts."""
    first = dims.variable_class(spark).withColumn("file_order", F.lit(1))
    again = first.withColumn("type", F.lit("other")).withColumn("file_order", F.lit(2))
    return Q.join_classification(Q.variable_counts(panels.raw_wide_yearly(spark, sf_dir)), again.unionByName(first))


@register("c8_unit_conflicts_mixed", with_panels("panel_yearly") + """
SELECT model, scenario, region, variable, count(DISTINCT u) AS n_units FROM (
  SELECT *, CASE WHEN variable = 'ECONOMY' AND year % 2 = 0 THEN 'other' ELSE unit END AS u FROM panel_yearly) p
GROUP BY model, scenario, region, variable HAVING count(DISTINCT u) > 1""")
def c8_unit_conflicts_mixed(spark, sf_dir):
    p = panels.panel_yearly(spark, sf_dir)
    other = (F.col("variable") == "ECONOMY") & (F.col("year") % 2 == 0)
    return Q.unit_conflicts(p.withColumn("unit", F.when(other, "other").otherwise(F.col("unit"))))


@register("c15_missing_matrix_absent_cells", with_panels("panel_ragged") + """,
part AS (SELECT * FROM panel_ragged WHERE variable <> 'SMALL' OR year > (SELECT min(year) + 1 FROM panel_ragged)),
per_var AS (SELECT variable, count(*) AS total FROM (SELECT DISTINCT model, scenario, region, variable FROM part) GROUP BY variable),
present AS (SELECT variable, year, count(DISTINCT (model, scenario, region)) AS present FROM part WHERE value IS NOT NULL GROUP BY variable, year)
SELECT v.variable, y.year, v.total, coalesce(p.present, 0) AS present, v.total - coalesce(p.present, 0) AS missing
FROM per_var v CROSS JOIN (SELECT DISTINCT year FROM part) y LEFT JOIN present p ON p.variable = v.variable AND p.year = y.year""")
def c15_missing_matrix_absent_cells(spark, sf_dir):
    """One variable has no row at all in the first two years."""
    p = panels.panel_ragged(spark, sf_dir)
    first = p.agg(F.min("year").alias("_first"))
    part = p.crossJoin(F.broadcast(first)).where((F.col("variable") != "SMALL") | (F.col("year") > F.col("_first") + 1)).drop("_first")
    return Q.missing_matrix(part, KEYS)


@register("d14_check_scale_coverage_gap", RP + f""", sp AS ({split_sql('rp')}),
train AS (SELECT * FROM sp WHERE split = 'train' AND region_scale = 'ISO3')
SELECT DISTINCT region_scale FROM sp WHERE split <> 'train' AND region_scale NOT IN (SELECT region_scale FROM train)""")
def d14_check_scale_coverage_gap(spark, sf_dir):
    sp = rp_split(spark, sf_dir)
    return D.check_scale_coverage(sp.where("split = 'train' AND region_scale = 'ISO3'"), sp.where("split <> 'train'"))


_KNOWN = " AND md5(model) >= '6'"


@register("e5_drop_unseen_models", YP_SPLIT + f"""
SELECT * FROM sp WHERE split = 'test' AND model IN (SELECT model FROM sp WHERE split = 'train'{_KNOWN})""", doubles=VARS)
def e5_drop_unseen_models(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    vocab = E.learn_vocab(sp.where("split = 'train'" + _KNOWN), "model")
    return E.drop_unseen(sp.where("split = 'test'"), "model", vocab)[0]


@register("e5_unseen_models", YP_SPLIT + f"""
SELECT DISTINCT model FROM sp WHERE split = 'test' AND model NOT IN (SELECT model FROM sp WHERE split = 'train'{_KNOWN})""")
def e5_unseen_models(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    vocab = E.learn_vocab(sp.where("split = 'train'" + _KNOWN), "model")
    return E.drop_unseen(sp.where("split = 'test'"), "model", vocab)[1]


@register("f7_min_length_long", SQ + f""" SELECT * EXCLUDE (_c) FROM (
  SELECT *, count(*) OVER (PARTITION BY {K}) AS _c FROM sq) x WHERE _c >= 17""", doubles=SEQ_DOUBLES)
def f7_min_length_long(spark, sf_dir):
    return W.min_length(sq(spark, sf_dir), KEYS, 17)


@register("f12_with_fallback_series", _HZ + f""",
prim AS (SELECT * FROM hz WHERE {_HALF_SQL}),
alt AS (SELECT {K}, step, {', '.join(f'-{p} AS {p}' for p in PRED)} FROM hz)
SELECT * FROM prim UNION ALL SELECT * FROM alt WHERE NOT {_HALF_SQL}""", doubles=PRED)
def f12_with_fallback_series(spark, sf_dir):
    """The primary covers half of the series; the others come from the fallback."""
    hz = horizon(spark, sf_dir)
    return W.with_fallback(hz.where(half()), hz.select(*KEYS, "step", *[(-F.col(p)).alias(p) for p in PRED]), KEYS)


@register("f13_coverage_report_gap", _HZ + f""", part AS (SELECT * FROM hz WHERE {_HALF_SQL})
SELECT (SELECT count(*) FROM part) AS horizon_rows, (SELECT count(*) FROM (SELECT DISTINCT {K} FROM part)) AS covered_series,
  (SELECT count(*) FROM (SELECT DISTINCT {K} FROM sq)) AS all_series,
  (SELECT count(*) FROM (SELECT DISTINCT {K} FROM sq EXCEPT SELECT DISTINCT {K} FROM part)) AS dropped_series""")
def f13_coverage_report_gap(spark, sf_dir):
    return W.coverage_report(horizon(spark, sf_dir).where(half()), sq(spark, sf_dir), KEYS)


@register("f13_first_dropped_gap", _HZ + f"""
SELECT * FROM (SELECT DISTINCT {K} FROM sq EXCEPT SELECT DISTINCT {K} FROM hz WHERE {_HALF_SQL}) ORDER BY {K} LIMIT 5""")
def f13_first_dropped_gap(spark, sf_dir):
    return W.first_dropped(horizon(spark, sf_dir).where(half()), sq(spark, sf_dir), KEYS, 5)


_LEDGER_SQL = ("ledger AS (SELECT 'stage' || (1 + count % 2) AS stage, CAST(floor(count / 1000) AS DOUBLE) AS val_loss, "
               "row_number() OVER (ORDER BY variable) AS trial_id FROM counts)")


@register("g5_best_per_stage", with_panels("raw_wide") + f""", {_COUNTS_SQL}, {_LEDGER_SQL}
SELECT stage, val_loss, trial_id FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY val_loss, trial_id) AS r FROM ledger) l
WHERE r = 1""", doubles=("val_loss",))
def g5_best_per_stage(spark, sf_dir):
    """Best trial per stage of a ledger with equal losses; the smallest trial id settles them."""
    from pyspark.sql import Window

    counts = Q.variable_counts(panels.raw_wide_yearly(spark, sf_dir))  # one row per variable
    ledger = counts.select(F.concat(F.lit("stage"), 1 + F.col("count") % 2).alias("stage"), F.floor(F.col("count") / 1000).cast("double").alias("val_loss"),
                           F.row_number().over(Window.orderBy("variable")).cast("long").alias("trial_id"))
    return G.best_per(ledger, "stage")


_GAPPED = "CASE WHEN year % 3 = 0 THEN NULL ELSE {p} END AS {p}"


@register("h1_metrics_null_predictions", _TAB + f""",
gap AS (SELECT * REPLACE ({', '.join(_GAPPED.format(p=p) for p in PREV)}) FROM tab)
SELECT {metric_aggs(3)} FROM ({stack_sql('gap', TARGETS, PREV)}) s WHERE y IS NOT NULL AND p IS NOT NULL""", doubles=METRIC_DOUBLES)
def h1_metrics_null_predictions(spark, sf_dir):
    """A third of the years has no prediction: only complete pairs count, in every term."""
    tab = prepare_tabular(yearly_wide(spark, sf_dir), TARGETS, KEYS, n_lags=2)
    gap = tab.withColumns({p: F.when(F.col("year") % 3 != 0, F.col(p)) for p in PREV})
    return H.metrics(gap, TARGETS, PREV)


_NULL_KEY = "nk AS (SELECT * REPLACE (nullif(scenario, 'AUTOMOBILE') AS scenario) FROM yearly_wide)"


@register("s1_split_null_key", with_panels("yearly_wide") + f", {_NULL_KEY} {split_sql('nk')}", doubles=VARS)
def s1_split_null_key(spark, sf_dir):
    """Series whose scenario is NULL are split like all others."""
    w = yearly_wide(spark, sf_dir).withColumn("scenario", F.nullif("scenario", F.lit("AUTOMOBILE")))
    return S.split_by_series(w, KEYS, 0.1, 0.1, seed=0)


_IN_SAMPLE = "CASE WHEN rel < 0 THEN economy END"
_SAMPLE = f"OVER (PARTITION BY {K}, sample)"


@register("e9_normalise_samples", f"""WITH ed AS ({_ED_ALL}),
c AS (SELECT *, avg({_IN_SAMPLE}) {_SAMPLE} AS economy_norm_center, CASE WHEN stddev_pop({_IN_SAMPLE}) {_SAMPLE} = 0 THEN 1.0
  ELSE stddev_pop({_IN_SAMPLE}) {_SAMPLE} END AS economy_norm_scale FROM ed)
SELECT *, (economy - economy_norm_center) / economy_norm_scale AS economy_norm FROM c""",
          doubles=[*TARGETS, "economy_norm_center", "economy_norm_scale", "economy_norm"])
def e9_normalise_samples(spark, sf_dir):
    """Every encoder / decoder sample in the units of its own encoder rows."""
    samples = W.encoder_decoder_windows(sq(spark, sf_dir), KEYS, "year", TARGETS, ENC, MAXDEC, MINDEC, "all")
    return E.normalise_samples(samples, "economy", KEYS)


@register("g6_rollout_scaled", _rollout_sql("WHERE split = 'test'") + f" SELECT {K}, step, " + ", ".join(PRED) + " FROM r", doubles=PRED)
def g6_rollout_scaled(spark, sf_dir):
    """Fitting and rolling out in scaled spaces gives, in raw units, what the raw fit gives."""
    sp = sq_split(spark, sf_dir)
    return scaled_rollout(sp.where("split = 'train'"), sp.where("split = 'test'"), "step", {f"prev_{t}": t for t in TARGETS}, KEYS)


@register("k9_infer_region_scaled", _K9, doubles=PRED)
def k9_infer_region_scaled(spark, sf_dir):
    """Counterfactual rows -> lags -> centre-imputed -> scaled fit and rollout -> raw units."""
    c, made = synthetic(spark, sf_dir)
    hs = D.require_history(D.add_lags(made, TARGETS, 1, KEYS), 1, KEYS)
    prevs = [f"prev_{t}" for t in TARGETS]
    centres = E.fit_scaler(c, TARGETS).select(*[F.col(f"{t}_mean").alias(f"prev_{t}") for t in TARGETS])
    train = D.add_lags(c, TARGETS, 1, KEYS)
    out = scaled_rollout(train, D.impute_with_center(hs, centres, prevs), "year", dict(zip(prevs, TARGETS)), KEYS)
    return out.withColumn("year", F.col("year").cast("int"))


# A search ledger derived from the panel: one trial per model, its one parameter and loss from the model's rows.
_TRIALS = with_panels("panel_yearly") + """,
per AS (SELECT model, count(*) AS c FROM panel_yearly GROUP BY model),
ledger AS (SELECT c % 11 AS size, CAST(c % 13 AS DOUBLE) AS val_loss, CASE WHEN c % 3 = 0 THEN 'stage2' ELSE 'stage1' END AS stage,
  row_number() OVER (ORDER BY model) AS trial_id, '{"size":' || (c % 11) || '}' AS signature FROM per),
cand AS (SELECT size, '{"size":' || size || '}' AS signature FROM (
  SELECT DISTINCT unnest([year % 11, year % 11 + 9]) AS size FROM panel_yearly) y),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY val_loss, trial_id) AS r FROM ledger
          WHERE stage <> 'stage2') x WHERE r = 1),
top AS (SELECT * FROM first ORDER BY val_loss, signature LIMIT 3),
pool AS (SELECT * FROM ledger WHERE stage = 'stage2' OR NOT EXISTS (SELECT 1 FROM ledger WHERE stage = 'stage2'))"""


def _trials(spark, sf_dir, part):
    """The named table of ``rank_trials`` over a ledger that was written as JSON lines and read back."""
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from ..session import shared_dir
    from ..sources import files

    p = panels.panel_yearly(spark, sf_dir)
    c = F.col("c")
    per = p.groupBy("model").agg(F.count("*").alias("c"))  # one row per model
    ledger = per.select((c % 11).alias("size"), (c % 13).cast("double").alias("val_loss"), F.when(c % 3 == 0, "stage2").otherwise("stage1").alias("stage"),
                        F.row_number().over(Window.orderBy("model")).cast("long").alias("trial_id"), F.lit("completed").alias("status"))
    path = shared_dir(spark, "ledger")
    files.append_trials(ledger, path)
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("val_loss", T.DoubleType()), T.StructField("stage", T.StringType()),
                           T.StructField("trial_id", T.LongType()), T.StructField("status", T.StringType())])
    size = (F.col("year") % 11).cast("long")
    cand = p.select(F.explode(F.array(size, size + 9)).alias("size")).distinct()
    return G.rank_trials(files.read_trials(spark, path, schema), cand, 3, ("size",))[part]


@register("g4_stage1_remaining", _TRIALS + " SELECT size FROM cand WHERE signature NOT IN (SELECT signature FROM ledger)")
def g4_stage1_remaining(spark, sf_dir):
    return _trials(spark, sf_dir, "stage1_remaining").select("size")


@register("g4_stage2_candidates", _TRIALS + " SELECT signature, val_loss FROM top", doubles=("val_loss",))
def g4_stage2_candidates(spark, sf_dir):
    return _trials(spark, sf_dir, "stage2_candidates")


@register("g4_stage2_remaining", _TRIALS + """ SELECT t.signature, c.size FROM top t JOIN cand c USING (signature)
WHERE t.signature NOT IN (SELECT signature FROM ledger WHERE stage = 'stage2')""")
def g4_stage2_remaining(spark, sf_dir):
    return _trials(spark, sf_dir, "stage2_remaining")


@register("g4_best", _TRIALS + " SELECT size, val_loss, stage, trial_id FROM pool ORDER BY val_loss, signature, trial_id LIMIT 1", doubles=("val_loss",))
def g4_best(spark, sf_dir):
    return _trials(spark, sf_dir, "best").select("size", "val_loss", "stage", "trial_id")


_C18_COMPLETE = _C18_SQL.replace("  AND 5 + ", "  AND ").replace(f">= {int(len(_SEL_VARS) * 0.4)}", f">= {len(_SEL_VARS)}")
_SERIES = "model, scenario, scenario_category, region"


def _complete(spark, sf_dir):
    """The build with every variable required, keys not counted: incomplete rows go."""
    raw = stored(panels.raw_wide_yearly(spark, sf_dir))
    spec = BuildSpec(outputs=UP_TARGETS, min_count=MIN_COUNT, completeness_ratio=1.0, count_keys=False)
    return build_panel(spark, raw, dims.variable_class(spark), dims.scenario_category(spark), dims.unit_rules(spark), dims.base_years_for_models(spark, raw), spec)


@register("c18_build_panel_complete", _C18_COMPLETE, doubles=[v.lower() for v in _SEL_VARS])
def c18_build_panel_complete(spark, sf_dir):
    return _complete(spark, sf_dir).panel


@register("c18_series_wide", f"""WITH p AS ({_C18_COMPLETE}),
long AS ({' UNION ALL '.join(f"SELECT {_C18_KEYS}, '{v.lower()}' AS variable, {v.lower()} AS value FROM p" for v in _SEL_VARS)}),
wide AS (SELECT {_SERIES}, variable, {', '.join(f'avg(value) FILTER (WHERE year = {y}) AS "{y}"' for y in YEARS)}
  FROM long WHERE value IS NOT NULL GROUP BY {_SERIES}, variable),
ssp AS (SELECT model, scenario, arg_min(ssp_family, file_order) AS ssp_family FROM {dims.SSP_FAMILY_SQL} GROUP BY model, scenario)
SELECT w.*, s.ssp_family, {MODEL_FAMILY_SQL.replace('model', 'w.model')} AS model_family, {REGION_SCALE_SQL} AS region_scale
FROM wide w LEFT JOIN ssp s ON w.model = s.model AND w.scenario = s.scenario""", doubles=[str(y) for y in YEARS])
def c18_series_wide(spark, sf_dir):
    """The whole build down to the processed series table."""
    res = _complete(spark, sf_dir)
    return series_wide(res.panel, [v.lower() for v in res.variables], dims.ssp_family(spark), years=YEARS)


@register("c18_summary", f"""WITH p AS ({_C18_COMPLETE})
SELECT count(*) AS rows, CAST({5 + len(_SEL_VARS)} AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells,
  CASE WHEN count(*) > 0 THEN 0.0 END AS pct_missing FROM p""", doubles=("pct_missing",))
def c18_summary(spark, sf_dir):
    return Q.dataset_summary(_complete(spark, sf_dir).panel)
