"""Encoding / scaling (E1-E10) and splitting / sampling (S1-S5) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale
from ..operators import encode as E
from ..operators import quality as Q
from ..operators import split as S
from ..plans.base import KEYS, TARGETS, VARS, quarterly_wide, yearly_wide
from ..sources import dims
from ..sources.panels import with_panels
from . import register
from .sqlfrag import MODEL_FAMILY_SQL, REGION_SCALE_SQL, rank_sql, split_sql

FEATS = ["promo", "small", "standard"]
YW = with_panels("yearly_wide")
YP = YW + (f", yp AS (SELECT *, {MODEL_FAMILY_SQL} AS model_family, {REGION_SCALE_SQL} AS region_scale "
           "FROM yearly_wide)")
YP_SPLIT = YP + f", sp AS ({split_sql('yp')})"
SCALES = ("ISO3", "R10", "R5", "R6", "World")


def yp(spark, sf_dir):
    return yearly_wide(spark, sf_dir).select("*", model_family("model").alias("model_family"),
                                             region_scale("region").alias("region_scale"))


def yp_split(spark, sf_dir):
    return S.split_by_series(yp(spark, sf_dir), KEYS, 0.1, 0.1, seed=0)


# ---------------------------------------------------------------- E

@register("e1_encode_fixed", YW + f""" SELECT w.*, coalesce(v.code, -1) AS region_code
FROM yearly_wide w LEFT JOIN {dims.REGION_VOCAB_SQL} v ON w.region = v.region""", doubles=VARS)
def e1_encode_fixed(spark, sf_dir):
    return E.encode_fixed(yearly_wide(spark, sf_dir), "region", dims.region_vocab(spark), "region_code", broadcast_vocab=True)


_VOCAB_FAMILY = ("vocab AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code "
                 "FROM (SELECT DISTINCT model_family AS value FROM yp WHERE model_family IS NOT NULL) d)")


@register("e2_encode_learned", YP + f""", {_VOCAB_FAMILY}
SELECT yp.model, yp.scenario, yp.region, yp.year, yp.model_family, coalesce(v.code, -1) AS family_code
FROM yp LEFT JOIN vocab v ON yp.model_family = v.value""")
def e2_encode_learned(spark, sf_dir):
    df = yp(spark, sf_dir).select(*KEYS, "year", "model_family")
    return E.encode_learned(df, "model_family", E.learn_vocab(df, "model_family"), "family_code")


@register("e3_decode", YP + f""", {_VOCAB_FAMILY},
enc AS (SELECT yp.model, yp.scenario, yp.region, yp.year, coalesce(v.code, -1) AS family_code
        FROM yp LEFT JOIN vocab v ON yp.model_family = v.value)
SELECT enc.*, v.value AS family_label FROM enc LEFT JOIN vocab v ON enc.family_code = v.code""")
def e3_decode(spark, sf_dir):
    df = yp(spark, sf_dir).select(*KEYS, "year", "model_family")
    vocab = E.learn_vocab(df, "model_family")
    enc = E.encode_learned(df, "model_family", vocab, "family_code").drop("model_family")
    return E.decode(enc, "family_code", vocab, "family_label")


_CAT = YP + f""", ypc AS (SELECT yp.*, d.scenario_category FROM yp
  LEFT JOIN {dims.SCENARIO_CATEGORY_SQL} d ON yp.scenario = d.scenario), sp AS ({split_sql('ypc')})"""


@register("e4_union_vocab", _CAT + """
SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (
  SELECT DISTINCT coalesce(CAST(scenario_category AS VARCHAR), '__NA__') AS value FROM sp) d""")
def e4_union_vocab(spark, sf_dir):
    df = Q.join_scenario_category(yp(spark, sf_dir), dims.scenario_category(spark))
    sp = S.split_by_series(df, KEYS, 0.1, 0.1, seed=0)
    frames = [sp.where(F.col("split") == s) for s in ("train", "val", "test")]
    return E.union_vocab(frames, "scenario_category")


@register("e5_drop_unseen", YP_SPLIT + """
SELECT * FROM sp WHERE split = 'test' AND model IN (SELECT model FROM sp WHERE split = 'train')""",
          doubles=VARS)
def e5_drop_unseen(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    vocab = E.learn_vocab(sp.where(F.col("split") == "train"), "model")
    return E.drop_unseen(sp.where(F.col("split") == "test"), "model", vocab)[0]


@register("e5_unseen_values", YP_SPLIT + """
SELECT DISTINCT region FROM sp WHERE split = 'test'
  AND region NOT IN (SELECT region FROM sp WHERE split = 'val')""")
def e5_unseen_values(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    vocab = E.learn_vocab(sp.where(F.col("split") == "val"), "region")
    return E.drop_unseen(sp.where(F.col("split") == "test"), "region", vocab)[1]


_DUMMIES = ", ".join(f"coalesce(CAST(region_scale = '{s}' AS DOUBLE), 0.0) AS region_scale_{s}" for s in SCALES)


@register("e6_one_hot", YP_SPLIT + f"""
SELECT * EXCLUDE (region_scale), {_DUMMIES}, CAST(region_scale IS NULL AS DOUBLE) AS region_scale_nan
FROM sp WHERE split = 'test'""",
          doubles=VARS + [f"region_scale_{s}" for s in SCALES] + ["region_scale_nan"])
def e6_one_hot(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    _, others, _ = E.one_hot(sp.where(F.col("split") == "train"), [sp.where(F.col("split") == "test")],
                             ["region_scale"])
    return others[0]


_PLACE = lambda c: f"(SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT {c} AS value FROM sp WHERE split = 'train' AND {c} IS NOT NULL) d)"


@register("e6_one_hot_sparse", YP_SPLIT + f""", va AS {_PLACE('model')}, vb AS {_PLACE('region_scale')},
n AS (SELECT (SELECT count(*) FROM va) AS a, (SELECT count(*) FROM vb) AS b),
p AS (SELECT sp.scenario, sp.region, sp.year, CASE WHEN sp.model IS NULL THEN n.a ELSE va.code END AS x, n.a + 1 + CASE WHEN sp.region_scale IS NULL THEN n.b ELSE vb.code END AS y, n.a + n.b + 2 AS size
      FROM sp LEFT JOIN va ON sp.model = va.value LEFT JOIN vb ON sp.region_scale = vb.value CROSS JOIN n WHERE split = 'test')
SELECT scenario, region, year, CAST(size AS INT) AS size, array_to_string(list_filter([x, y], lambda z: z IS NOT NULL), ',') AS places FROM p""")
def e6_one_hot_sparse(spark, sf_dir):
    """Places of the ones of two columns, the first with as many categories as there are models."""
    sp = yp_split(spark, sf_dir)
    _, (test,), _ = E.one_hot_sparse(sp.where(F.col("split") == "train"), [sp.where(F.col("split") == "test")], ["model", "region_scale"])
    return test.select("scenario", "region", "year", F.col("indicators.size").alias("size"), F.array_join(F.col("indicators.indices").cast("array<string>"), ",").alias("places"))


def _scaler_sql(src: str) -> str:
    parts = []
    for f in FEATS:
        parts.append(f"avg({f}) AS {f}_mean")
        parts.append(f"CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS {f}_scale")
    return f"SELECT {', '.join(parts)} FROM {src}"


TRAIN_SQL = "(SELECT * FROM sp WHERE split = 'train') t"
_SCALER_DOUBLES = [f"{f}_{k}" for f in FEATS for k in ("mean", "scale")]


@register("e7_fit_scaler", YP_SPLIT + f" {_scaler_sql(TRAIN_SQL)}",
          doubles=_SCALER_DOUBLES)
def e7_fit_scaler(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    return E.fit_scaler(sp.where(F.col("split") == "train"), FEATS)


_SC = YP_SPLIT + f", st AS ({_scaler_sql(TRAIN_SQL)})"
_SCALED = ", ".join(f"(sp.{f} - st.{f}_mean) / st.{f}_scale AS {f}" for f in FEATS)


@register("e8_scale", _SC + f"""
SELECT sp.model, sp.scenario, sp.region, sp.year, sp.economy, sp.large, sp.medium, {_SCALED},
  sp.model_family, sp.region_scale, sp.split FROM sp CROSS JOIN st""", doubles=VARS)
def e8_scale(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    st = E.fit_scaler(sp.where(F.col("split") == "train"), FEATS)
    return E.scale(sp, st, FEATS)


_ROUND = ", ".join(f"((sp.{f} - st.{f}_mean) / st.{f}_scale) * st.{f}_scale + st.{f}_mean AS {f}"
                   for f in FEATS)


@register("e8_unscale", _SC + f"""
SELECT sp.model, sp.scenario, sp.region, sp.year, sp.economy, sp.large, sp.medium, {_ROUND},
  sp.model_family, sp.region_scale, sp.split FROM sp CROSS JOIN st""", doubles=VARS)
def e8_unscale(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    st = E.fit_scaler(sp.where(F.col("split") == "train"), FEATS)
    return E.unscale(E.scale(sp, st, FEATS), st, FEATS)


_ENC_W = "PARTITION BY model, scenario, region ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"


@register("e9_encoder_normalise", with_panels("quarterly_wide") + f""",
c AS (SELECT *, avg(economy) OVER ({_ENC_W}) AS economy_norm_center,
        CASE WHEN stddev_pop(economy) OVER ({_ENC_W}) = 0 THEN 1.0
             ELSE stddev_pop(economy) OVER ({_ENC_W}) END AS economy_norm_scale FROM quarterly_wide)
SELECT *, (economy - economy_norm_center) / economy_norm_scale AS economy_norm FROM c""",
          doubles=VARS + ["economy_norm_center", "economy_norm_scale", "economy_norm"])
def e9_encoder_normalise(spark, sf_dir):
    return E.encoder_normalise(quarterly_wide(spark, sf_dir), "economy", KEYS, "year", 3)


@register("e10_group_key", YW + " SELECT DISTINCT concat_ws('_', model, scenario, region) AS group_key "
          "FROM yearly_wide")
def e10_group_key(spark, sf_dir):
    return E.group_key(yearly_wide(spark, sf_dir), KEYS, "group_key").select("group_key").distinct()


# ---------------------------------------------------------------- S

@register("s1_split_by_series", YP_SPLIT + " SELECT * FROM sp", doubles=VARS)
def s1_split_by_series(spark, sf_dir):
    return yp_split(spark, sf_dir)


@register("s1_split_sizes", YP_SPLIT + """ SELECT split, count(DISTINCT (model, scenario, region)) AS series,
  count(*) AS rows FROM sp GROUP BY split""")
def s1_split_sizes(spark, sf_dir):
    return yp_split(spark, sf_dir).groupBy("split").agg(
        F.count_distinct(*KEYS).alias("series"), F.count("*").alias("rows"))


def _fold_sql(k: int) -> str:
    q = "floor(n / {k})".format(k=k)
    rem = f"(n - {q} * {k})"
    big = f"({rem} * ({q} + 1))"
    return (f"CAST(CASE WHEN rank < {big} THEN floor(rank / ({q} + 1)) "
            f"ELSE {rem} + floor((rank - {big}) / {q}) END AS INT)")


@register("s2_group_kfold", YW + f""", rk0 AS ({rank_sql('yearly_wide', seed=42)}),
rk AS (SELECT *, {_fold_sql(5)} AS fold FROM rk0)
SELECT w.*, rk.fold
FROM yearly_wide w JOIN rk ON w.model = rk.model AND w.scenario = rk.scenario AND w.region = rk.region""",
          doubles=VARS)
def s2_group_kfold(spark, sf_dir):
    return S.group_kfold(yearly_wide(spark, sf_dir), KEYS, 5, seed=42)


@register("s3_holdout_series", YP_SPLIT + f""", tv AS (SELECT * FROM sp WHERE split IN ('train', 'val')),
rk AS ({rank_sql('tv', seed=0)})
SELECT tv.*, rk.rank < round_even(rk.n * 0.1, 0) AS holdout
FROM tv JOIN rk ON tv.model = rk.model AND tv.scenario = rk.scenario AND tv.region = rk.region""",
          doubles=VARS)
def s3_holdout_series(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    tv = S.union_splits(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"))
    return S.holdout_series(tv, KEYS, 0.1, seed=0)


@register("s4_sample_groups", YW + f""", rk AS ({rank_sql('yearly_wide', keys=('model', 'scenario'), seed=0)})
SELECT model, scenario, n AS total_groups, CAST(least(n, 100) AS BIGINT) AS used_groups FROM rk WHERE rank < 100""")
def s4_sample_groups(spark, sf_dir):
    return S.sample_groups(yearly_wide(spark, sf_dir), ["model", "scenario"], 100, seed=0)


@register("s5_union_splits", YP_SPLIT + " SELECT * FROM sp WHERE split IN ('train', 'val')", doubles=VARS)
def s5_union_splits(spark, sf_dir):
    sp = yp_split(spark, sf_dir)
    return S.union_splits(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"))
