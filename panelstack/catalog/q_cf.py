"""Counterfactual queries for one region (K1-K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale
from ..operators import counterfactual as Kf
from ..operators import encode as E
from ..operators import features as D
from ..operators import model as G
from ..operators import quality as Q
from ..operators import rollout as R
from ..plans.base import KEYS, TARGETS, VARS, yearly_wide
from ..session import materialize
from ..sources import dims
from ..sources.panels import with_panels
from . import register
from .sqlfrag import MODEL_FAMILY_SQL, REGION_SCALE_SQL, interp_select

REGION = "EU"
NAMES = ["AUTOMOBILE"]
CATS = ["C3"]
MODEL_COLS = ["promo", "small"]
K = "model, scenario, region"
CACHE_COLS = ["model", "scenario", "region", "year"] + VARS + ["model_family", "scenario_category", "region_scale"]

CACHE = with_panels("yearly_wide") + f""",
cache AS (SELECT w.*, {MODEL_FAMILY_SQL} AS model_family, d.scenario_category, {REGION_SCALE_SQL} AS region_scale
          FROM yearly_wide w LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON w.scenario = d.scenario
          WHERE w.region <> '{REGION}' OR md5(w.model || w.scenario) >= '7'),
scen AS (SELECT scenario FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) t(scenario)
           WHERE scenario IN (SELECT scenario FROM cache)
         UNION SELECT scenario FROM cache WHERE region = '{REGION}'
           AND scenario_category IN ({', '.join(repr(c) for c in CATS)})),
cnt AS (SELECT model, count(DISTINCT CASE WHEN region = '{REGION}' THEN scenario END) AS n_region,
          count(DISTINCT scenario) AS n_global FROM cache WHERE scenario IN (SELECT scenario FROM scen) GROUP BY model),
tm AS (SELECT CASE WHEN (SELECT max(n_region) FROM cnt) > 0
            THEN (SELECT model FROM cnt ORDER BY n_region DESC, model LIMIT 1)
            ELSE (SELECT model FROM cnt ORDER BY n_global DESC, model LIMIT 1) END AS model,
          CASE WHEN (SELECT max(n_region) FROM cnt) > 0 THEN 'region' ELSE 'global' END AS scope),
reps AS (SELECT model_family, min(model) AS model FROM cache WHERE model_family IS NOT NULL
         GROUP BY model_family HAVING count(*) >= 200),
d AS (SELECT * FROM cache WHERE model IN (SELECT model FROM reps)),
flag AS (SELECT model, bool_or(region = '{REGION}' AND ({' OR '.join(f'{c} IS NOT NULL' for c in MODEL_COLS)}))
         AS _in FROM d GROUP BY model),
src AS (SELECT d.* FROM d JOIN flag ON d.model = flag.model WHERE NOT flag._in OR d.region = '{REGION}'),
med AS (SELECT model, year, {', '.join(f'median({c}) AS {c}' for c in MODEL_COLS)} FROM src GROUP BY model, year),
lookup AS ({interp_select('med', MODEL_COLS, ['model', 'year'] + MODEL_COLS, keys=('model',))}),
actual AS (SELECT * FROM cache WHERE region = '{REGION}' AND scenario IN (SELECT scenario FROM scen)
           AND model IN (SELECT model FROM reps)),
tpl0 AS (SELECT * FROM cache WHERE model = (SELECT model FROM tm) AND region = '{REGION}'
         AND scenario IN (SELECT scenario FROM scen)),
tplany AS (SELECT * FROM cache WHERE model = (SELECT model FROM tm) AND scenario IN (SELECT scenario FROM scen)),
tpl AS (SELECT * FROM tpl0 UNION ALL
        SELECT * REPLACE ('{REGION}' AS region) FROM tplany
        WHERE region = (SELECT min(region) FROM tplany) AND NOT EXISTS (SELECT 1 FROM tpl0)),
cand AS (SELECT t.* REPLACE (r.model AS model, r.model_family AS model_family) FROM tpl t CROSS JOIN reps r),
cand2 AS (SELECT c.* FROM cand c ANTI JOIN (SELECT DISTINCT model, scenario FROM actual) a
          ON c.model = a.model AND c.scenario = a.scenario),
synth AS (SELECT c.* REPLACE ({', '.join(f'CASE WHEN l.model IS NOT NULL THEN l.{m} ELSE c.{m} END AS {m}' for m in MODEL_COLS)},
            {', '.join(f'CAST(NULL AS DOUBLE) AS {t}' for t in TARGETS)})
          FROM cand2 c LEFT JOIN lookup l ON c.model = l.model AND c.year = l.year),
allrows AS (SELECT * FROM actual UNION ALL SELECT * FROM synth)"""


def cache(spark, sf_dir):
    w = yearly_wide(spark, sf_dir).select("*", model_family("model").alias("model_family"))
    # holes: some (model, scenario) pairs were never observed in the region
    w = w.where((F.col("region") != REGION) | (F.md5(F.concat("model", "scenario")) >= "7"))
    w = Q.join_scenario_category(w, dims.scenario_category(spark))
    return w.select(*CACHE_COLS[:-1], region_scale("region").alias("region_scale"))


def _scen(c):
    return Kf.resolve_scenarios(c, REGION, NAMES, CATS)[0]


def synthetic(spark, sf_dir):
    c = materialize(cache(spark, sf_dir))
    scen = _scen(c)
    tm = Kf.template_model(c, REGION, scen).collect()[0]["model"]  # one row
    reps = Kf.representatives(c, 200)
    lookup = Kf.feature_lookup(c, reps, MODEL_COLS, REGION)
    return c, Kf.synthesise(c, REGION, scen, tm, reps, lookup, MODEL_COLS, TARGETS)


@register("k1_region_summary", CACHE + f""" SELECT count(*) AS rows, count(DISTINCT model_family) AS families,
  count(DISTINCT model) AS models, count(DISTINCT scenario) AS scenarios,
  count(DISTINCT (model, scenario)) AS combos FROM cache WHERE region = '{REGION}'""")
def k1_region_summary(spark, sf_dir):
    return Kf.region_summary(cache(spark, sf_dir), REGION)


@register("k1_region_models", CACHE + f""" SELECT model_family, list_sort(list(DISTINCT model)) AS models
FROM cache WHERE region = '{REGION}' GROUP BY model_family""")
def k1_region_models(spark, sf_dir):
    return Kf.region_models(cache(spark, sf_dir), REGION)


@register("k2_resolve_scenarios", CACHE + " SELECT * FROM scen")
def k2_resolve_scenarios(spark, sf_dir):
    return _scen(cache(spark, sf_dir))


@register("k3_template_model", CACHE + " SELECT * FROM tm")
def k3_template_model(spark, sf_dir):
    c = cache(spark, sf_dir)
    return Kf.template_model(c, REGION, _scen(c))


@register("k4_feature_lookup", CACHE + " SELECT * FROM lookup", doubles=MODEL_COLS)
def k4_feature_lookup(spark, sf_dir):
    c = cache(spark, sf_dir)
    return Kf.feature_lookup(c, Kf.representatives(c, 200), MODEL_COLS, REGION)


@register("k5_representatives", CACHE + " SELECT * FROM reps")
def k5_representatives(spark, sf_dir):
    return Kf.representatives(cache(spark, sf_dir), 200)


@register("k6_synthesise", CACHE + " SELECT * FROM allrows", doubles=VARS)
def k6_synthesise(spark, sf_dir):
    return synthetic(spark, sf_dir)[1]


@register("k7_fill_rate", CACHE + f""" SELECT count(*) AS rows, count(DISTINCT (model, scenario)) AS combos,
  avg(({' + '.join(f'CAST({m} IS NOT NULL AS DOUBLE)' for m in MODEL_COLS)}) / {len(MODEL_COLS)}) * 100.0
  AS pct_filled FROM allrows""", doubles=["pct_filled"])
def k7_fill_rate(spark, sf_dir):
    return Kf.fill_rate(synthetic(spark, sf_dir)[1], MODEL_COLS)


_PART = "PARTITION BY model, scenario, region ORDER BY year"
_LG = f""",
lg AS (SELECT *, {', '.join(f'lag({t}) OVER ({_PART}) AS prev_{t}' for t in TARGETS)},
         row_number() OVER ({_PART}) AS _rn FROM allrows),
hs AS (SELECT * EXCLUDE (_rn) FROM lg WHERE _rn > 1)"""


@register("k8_ground_truth_rows", CACHE + _LG + f" SELECT * FROM hs WHERE {TARGETS[0]} IS NOT NULL",
          doubles=VARS + [f"prev_{t}" for t in TARGETS])
def k8_ground_truth_rows(spark, sf_dir):
    _, syn = synthetic(spark, sf_dir)
    hs = D.require_history(D.add_lags(syn, TARGETS, 1, KEYS), 1, KEYS)
    return Kf.ground_truth_rows(hs, TARGETS[0])


_K9 = (CACHE + _LG).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
mu AS (SELECT {', '.join(f'avg({t}) AS m_{t}' for t in TARGETS)} FROM cache),
fl AS (SELECT hs.* REPLACE ({', '.join(f'coalesce(hs.prev_{t}, mu.m_{t}) AS prev_{t}' for t in TARGETS)})
       FROM hs CROSS JOIN mu),
cl AS (SELECT *, {', '.join(f'lag({t}) OVER ({_PART}) AS prev_{t}' for t in TARGETS)} FROM cache),
cf AS (SELECT {', '.join(f'regr_slope({t}, prev_{t}) AS b_{t}, regr_intercept({t}, prev_{t}) AS a_{t}' for t in TARGETS)} FROM cl),
te AS (SELECT *, row_number() OVER ({_PART}) - 1 AS _k FROM fl),
r AS (SELECT te.model, te.scenario, te.region, te._k, te.year,
        {', '.join(f'cf.a_{t} + cf.b_{t} * te.prev_{t} AS pred_{t}' for t in TARGETS)}
      FROM te CROSS JOIN cf WHERE te._k = 0
      UNION ALL
      SELECT te.model, te.scenario, te.region, te._k, te.year,
        {', '.join(f'cf.a_{t} + cf.b_{t} * r.pred_{t} AS pred_{t}' for t in TARGETS)}
      FROM r JOIN te ON te.model = r.model AND te.scenario = r.scenario AND te.region = r.region
        AND te._k = r._k + 1 CROSS JOIN cf)
SELECT model, scenario, region, year, {', '.join(f'pred_{t}' for t in TARGETS)} FROM r"""


@register("k9_infer_region", _K9, doubles=[f"pred_{t}" for t in TARGETS])
def k9_infer_region(spark, sf_dir):
    """Counterfactual rows -> lags -> centre-imputed lags -> AR(1) rollout -> result table."""
    c, syn = synthetic(spark, sf_dir)
    hs = D.require_history(D.add_lags(syn, TARGETS, 1, KEYS), 1, KEYS)
    prevs = [f"prev_{t}" for t in TARGETS]
    centres = E.fit_scaler(c, TARGETS).select(*[F.col(f"{t}_mean").alias(f"prev_{t}") for t in TARGETS])
    filled = D.impute_with_center(hs, centres, prevs)
    fit = G.fit_one_feature(D.add_lags(c, TARGETS, 1, KEYS), {t: f"prev_{t}" for t in TARGETS})
    coefs = []
    for row in fit.collect():  # one row per target
        coefs += [(row["target"], "(intercept)", row["intercept"]), (row["target"], row["feature"], row["slope"])]
    preds = R.rollout_linear(filled, KEYS, "year", TARGETS, coefs, {p: (t, 1) for p, t in zip(prevs, TARGETS)})
    return preds.select(*KEYS, F.col("year").cast("int").alias("year"), *[f"pred_{t}" for t in TARGETS])
