"""K9 from the stored artefacts of a run, and region queries by scenario category (K1, K9)."""

from __future__ import annotations

from ..operators import counterfactual as Kf
from ..plans import infer as I
from ..plans.base import KEYS, TARGETS
from ..session import shared_dir, stored
from . import register
from .q_cf import _LG, _PART, CACHE, CATS, MODEL_COLS, NAMES, REGION, cache
from .q_linear import fit_sql

PREVS = [f"prev_{t}" for t in TARGETS]
FE = [*PREVS, *MODEL_COLS, "model_family_code"]
_SCALE = lambda c, missing: f"coalesce((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 0.0) AS {c}" if missing else f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS {c}"


def _pred(t, value=lambda f: f"te.{f}"):
    return f"b_{t}_0 + " + " + ".join(f"b_{t}_{i} * {value(f)}" for i, f in enumerate(FE, 1))


def _own(f):
    t = f.removeprefix("prev_")
    return f"(r.p_{t} * (s_{t} / s_{f}) + (m_{t} - m_{f}) / s_{f})" if f in PREVS else f"te.{f}"


_SQL = (CACHE + _LG).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ct AS (SELECT *, {', '.join(f'lag({t}) OVER ({_PART}) AS prev_{t}' for t in TARGETS)}, row_number() OVER ({_PART}) AS _rn FROM cache),
vb AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT model_family AS value FROM ct WHERE _rn > 1 AND model_family IS NOT NULL) v),
tre AS (SELECT ct.*, coalesce(vb.code, -1) AS model_family_code FROM ct LEFT JOIN vb ON ct.model_family = vb.value WHERE _rn > 1),
sl AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}' for c in [*FE, *TARGETS])} FROM tre),
trs AS (SELECT 0 AS fold, {', '.join([_SCALE(c, True) for c in FE] + [_SCALE(c, False) for c in TARGETS])} FROM tre CROSS JOIN sl WHERE {' AND '.join(f'tre.{t} IS NOT NULL' for t in TARGETS)}),
{fit_sql('SELECT * FROM trs', (0.0,), FE, TARGETS)},
wt AS (SELECT {', '.join(f'b_{t}_{i}' for t in TARGETS for i in range(len(FE) + 1))} FROM cw),
he AS (SELECT hs.*, coalesce(vb.code, -1) AS model_family_code FROM hs LEFT JOIN vb ON hs.model_family = vb.value),
te AS (SELECT model, scenario, region, year, {', '.join(_SCALE(c, True) for c in FE)}, row_number() OVER ({_PART}) - 1 AS _k FROM he CROSS JOIN sl),
r AS (SELECT te.model, te.scenario, te.region, te._k, te.year, {', '.join(f'{_pred(t)} AS p_{t}' for t in TARGETS)} FROM te CROSS JOIN wt WHERE te._k = 0
      UNION ALL
      SELECT te.model, te.scenario, te.region, te._k, te.year, {', '.join(_pred(t, _own) for t in TARGETS)}
      FROM r JOIN te ON te.model = r.model AND te.scenario = r.scenario AND te.region = r.region AND te._k = r._k + 1 CROSS JOIN wt CROSS JOIN sl)
SELECT model, scenario, region, year, {', '.join(f'p_{t} * s_{t} + m_{t} AS pred_{t}' for t in TARGETS)} FROM r CROSS JOIN sl"""


@register("k9_infer_region_from_run", _SQL, doubles=[f"pred_{t}" for t in TARGETS])
def k9_infer_region_from_run(spark, sf_dir):
    """Train and store a run, load it, and forecast the region with it: encode, scale, roll out, unscale."""
    c = stored(cache(spark, sf_dir), "panel")
    root = shared_dir(spark, "runs")
    I.train_run(c, root, "run-1", KEYS, TARGETS, MODEL_COLS, ["model_family"])
    out = I.infer_region(c, I.load_run(spark, root, "run-1"), REGION, KEYS, MODEL_COLS, NAMES, CATS)
    return out.selectExpr(*KEYS, "cast(year as int) AS year", *[f"pred_{t}" for t in TARGETS])


@register("k1_region_scenarios", CACHE + f""" SELECT scenario_category, list_sort(list(DISTINCT scenario)) AS scenarios,
  count(DISTINCT (model, scenario)) AS combos, count(*) AS rows FROM cache WHERE region = '{REGION}' GROUP BY scenario_category""")
def k1_region_scenarios(spark, sf_dir):
    return Kf.region_scenarios(cache(spark, sf_dir), REGION)
