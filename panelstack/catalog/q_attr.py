"""Attribution queries.

Contributions of a linear attribution ``coef * (x - mean)``.  The oracle
queries use per-feature least-squares slopes from the training split (SQL can
compute them); the MLlib multi-feature linear model is attributed the same
way in a rows-only query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as J
from ..operators import model as G
from ..operators.split import split_by_series
from ..plans.base import KEYS, TARGETS, yearly_wide
from ..plans.prepare import prepare_tabular
from ..session import materialize
from . import register
from .q_eval import _TAB
from .q_windows import _SEQ_SQL, seqs, sq
from .sqlfrag import split_sql

FJ = ["promo", "small", "standard"] + [f"prev_{t}" for t in TARGETS] + [f"prev2_{t}" for t in TARGETS]
KY = ["model", "scenario", "region", "year"]
K = "model, scenario, region"


def _split_tab(spark, sf_dir):
    tab = prepare_tabular(yearly_wide(spark, sf_dir), TARGETS, KEYS, n_lags=2)
    return materialize(split_by_series(tab, KEYS, 0.1, 0.1, seed=0))


def contributions(spark, sf_dir):
    sp = _split_tab(spark, sf_dir)
    tr = sp.where(F.col("split") == "train")
    coefs = J.univariate_slopes(tr, TARGETS, FJ)
    means = J.feature_means(tr, FJ)
    return J.linear_attribution(sp.where(F.col("split") == "test"), KY, FJ, coefs, means)


def _pairs_sql(src, targets, feats):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{f}' AS feature, CAST({t} AS DOUBLE) AS y, CAST({f} AS DOUBLE) AS x FROM {src}"
        for t in targets for f in feats)


def _long_sql(src, keep, feats):
    k = ", ".join(keep)
    return " UNION ALL ".join(f"SELECT {k}, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {src}" for f in feats)


_CONTRIB = _TAB + f""", sp AS ({split_sql('tab')}),
tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'),
coef AS (SELECT target, feature, coalesce(regr_slope(y, x), 0.0) AS coefficient
         FROM ({_pairs_sql('tr', TARGETS, FJ)}) p GROUP BY target, feature),
means AS (SELECT feature, avg(x) AS mean FROM ({_long_sql('tr', ['1 AS one'], FJ)}) l GROUP BY feature),
lf AS ({_long_sql('te', KY, FJ)}),
contrib AS (SELECT lf.model, lf.scenario, lf.region, lf.year, c.target, lf.feature,
  coalesce(lf.x, m.mean) AS x, c.coefficient * (coalesce(lf.x, m.mean) - m.mean) AS contribution
  FROM lf JOIN means m ON lf.feature = m.feature JOIN coef c ON lf.feature = c.feature),
imp AS (SELECT target, feature, mean_abs,
  CASE WHEN sum(mean_abs) OVER (PARTITION BY target) <> 0 THEN mean_abs / sum(mean_abs) OVER (PARTITION BY target) END
    AS importance,
  CAST(row_number() OVER (PARTITION BY target ORDER BY mean_abs DESC, feature) AS INT) AS rank
  FROM (SELECT target, feature, avg(abs(contribution)) AS mean_abs FROM contrib GROUP BY target, feature) a)"""

_LAG_RE = r"'^prev(\d*)_(.+)$'"
_MAP = f""",
cand AS (SELECT target, feature, regexp_extract(feature, {_LAG_RE}, 1) AS _n,
           regexp_extract(feature, {_LAG_RE}, 2) AS source_target FROM imp
         WHERE rank <= 20 AND regexp_matches(feature, {_LAG_RE})),
inputs AS (SELECT target AS source_target, arg_min(feature, rank) AS traced_feature FROM imp
           WHERE rank <= 10 AND NOT starts_with(feature, 'prev') GROUP BY target),
lagmap AS (SELECT c.target, c.feature, c.source_target, i.traced_feature,
  CASE WHEN c._n = '' THEN 'prev_' ELSE 'prev' || c._n || '_' END || i.traced_feature AS renamed
  FROM cand c JOIN inputs i ON c.source_target = i.source_target
  WHERE c.source_target <> c.target AND c.source_target IN ({', '.join(repr(t) for t in TARGETS)}))"""


@register("j1_linear_attribution", _CONTRIB + " SELECT * FROM contrib", doubles=["x", "contribution"])
def j1_linear_attribution(spark, sf_dir):
    return contributions(spark, sf_dir)


@register("j2_importance", _CONTRIB + " SELECT * FROM imp", doubles=["mean_abs", "importance"])
def j2_importance(spark, sf_dir):
    sp = _split_tab(spark, sf_dir)
    tr = sp.where(F.col("split") == "train")
    return J.linear_importance(sp.where(F.col("split") == "test"), FJ, J.univariate_slopes(tr, TARGETS, FJ), J.feature_means(tr, FJ))


@register("j3_trace_lag_map", _CONTRIB + _MAP + " SELECT * FROM lagmap")
def j3_trace_lag_map(spark, sf_dir):
    return J.trace_lag_map(J.importance(contributions(spark, sf_dir)), TARGETS)


@register("j3_trace_lag_contributions", _CONTRIB + _MAP + f""",
tot AS (SELECT target, sum(mean_abs) AS _tot FROM imp GROUP BY target),
norm AS (SELECT c.model, c.scenario, c.region, c.year, c.target, c.feature,
  CASE WHEN t._tot <> 0 THEN c.contribution / t._tot END AS _v FROM contrib c JOIN tot t ON c.target = t.target)
SELECT o.model, o.scenario, o.region, o.year, o.target, m.renamed AS feature, s._v * o._v AS contribution
FROM norm o JOIN lagmap m ON o.target = m.target AND o.feature = m.feature
JOIN norm s ON s.model = o.model AND s.scenario = o.scenario AND s.region = o.region AND s.year = o.year
  AND s.target = m.source_target AND s.feature = m.traced_feature""", doubles=["contribution"])
def j3_trace_lag_contributions(spark, sf_dir):
    c = contributions(spark, sf_dir)
    return J.trace_lag_contributions(c, J.importance(c), KY, TARGETS)


@register("j4_top_features", _CONTRIB + " SELECT * FROM imp WHERE rank <= 8", doubles=["mean_abs", "importance"])
def j4_top_features(spark, sf_dir):
    return J.top_features(J.importance(contributions(spark, sf_dir)), 8)


@register("j4_top_features_exclude_top", _CONTRIB + " SELECT * FROM imp WHERE rank > 1 AND rank <= 8",
          doubles=["mean_abs", "importance"])
def j4_top_features_exclude_top(spark, sf_dir):
    return J.top_features(J.importance(contributions(spark, sf_dir)), 8, exclude_top=True)


# ---------------------------------------------------------------- time cube from sequences

CF = ["promo", "small"] + TARGETS
ARRAYS = {"promo": "x_promo", "small": "x_small", **{t: f"hist_{t}" for t in TARGETS}}
_CUBE = _SEQ_SQL + ", " + ", ".join([
    f"coefc AS (SELECT target, feature, coalesce(regr_slope(y, x), 0.0) AS coefficient "
    f"FROM ({_pairs_sql('sq', TARGETS, CF)}) p GROUP BY target, feature)",
    f"meansc AS (SELECT feature, avg(x) AS mean FROM ({_long_sql('sq', ['1 AS one'], CF)}) l GROUP BY feature)",
    "cube AS (" + " UNION ALL ".join(
        f"SELECT {K}, start, CAST(len({a}) - 1 - p AS INT) AS timestep, '{f}' AS feature, CAST({a}[p + 1] AS DOUBLE) AS x "
        f"FROM (SELECT *, unnest(range(len({a}))) AS p FROM seqs) s{i}" for i, (f, a) in enumerate(ARRAYS.items())) + ")",
    f"cc AS (SELECT cube.model, cube.scenario, cube.region, cube.start, cube.timestep, cube.feature, c.target, "
    f"coalesce(cube.x, m.mean) AS x, c.coefficient * (coalesce(cube.x, m.mean) - m.mean) AS contribution "
    f"FROM cube JOIN meansc m ON cube.feature = m.feature JOIN coefc c ON cube.feature = c.feature)"])


def cube_contrib(spark, sf_dir):
    s = sq(spark, sf_dir)
    coefs = J.univariate_slopes(s, TARGETS, CF)
    means = J.feature_means(s, CF)
    return J.cube_attribution(J.sequence_cube(seqs(spark, sf_dir), KEYS, ARRAYS), coefs, means)


@register("j5_collapse_time", _CUBE + f""" SELECT {K}, start, target, feature, sum(contribution) AS contribution,
  avg(x) AS x FROM cc GROUP BY {K}, start, target, feature""", doubles=["contribution", "x"])
def j5_collapse_time(spark, sf_dir):
    return J.collapse_time(cube_contrib(spark, sf_dir), KEYS)


@register("j6_time_feature_heat", _CUBE + """,
ov AS (SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY avg(abs(contribution)) DESC, feature) AS _r
       FROM cc GROUP BY target, feature)
SELECT cc.target, cc.feature, cc.timestep, avg(abs(cc.contribution)) AS mean_abs FROM cc
JOIN ov ON cc.target = ov.target AND cc.feature = ov.feature WHERE ov._r <= 3
GROUP BY cc.target, cc.feature, cc.timestep""", doubles=["mean_abs"])
def j6_time_feature_heat(spark, sf_dir):
    return J.time_feature_heat(cube_contrib(spark, sf_dir), 3)


@register("j7_timestep_importance", _CUBE + """ SELECT target, timestep, avg(abs(contribution)) AS mean_abs
FROM cc GROUP BY target, timestep""", doubles=["mean_abs"])
def j7_timestep_importance(spark, sf_dir):
    return J.timestep_importance(cube_contrib(spark, sf_dir))


@register("j1_attribution_mllib_linear", None, notes="attribution of the MLlib multi-feature linear model")
def j1_attribution_mllib_linear(spark, sf_dir):
    from .q_models import FEATS, model_frame
    mf = model_frame(spark, sf_dir)
    tr = mf.where(F.col("split") != "test")
    models = G.fit_targets(tr, FEATS, TARGETS, "linear")
    coefs = G.coefficient_table(spark, models, FEATS)
    return J.importance(J.linear_attribution(mf.where(F.col("split") == "test"), KY, FEATS, coefs,
                                             J.feature_means(tr, FEATS)))
