"""Counterfactual rows for one region (K1-K8).

Builds model input rows for every (representative model, scenario) pair of
one region: real rows where the model ran the scenario there, otherwise the
template model's rows relabelled with the model and its own typical
(median-by-year) technology features.  The fan-out is bounded by the number
of model families (one representative each).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import interpolate
from .stats import grouped_medians


def region_summary(df: DataFrame, region: str, families: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, families, models, scenarios, (model, scenario) combos of the region."""
    r = df.where(F.col("region") == region)
    if families is not None:
        r = r.where(F.col("model_family").isin(list(families)))
    return r.agg(F.count("*").alias("rows"),
                 F.count_distinct("model_family").alias("families"),
                 F.count_distinct("model").alias("models"),
                 F.count_distinct("scenario").alias("scenarios"),
                 F.count_distinct("model", "scenario").alias("combos"))


def region_models(df: DataFrame, region: str) -> DataFrame:
    """Models per family in the region (sorted list per family)."""
    return df.where(F.col("region") == region).groupBy("model_family") \
             .agg(F.array_sort(F.collect_set("model")).alias("models"))


def region_scenarios(df: DataFrame, region: str, families: Sequence[str] | None = None) -> DataFrame:
    """Scenarios of the region by category (NULL: without one): sorted names, distinct (model, scenario) pairs, rows."""
    r = df.where(F.col("region") == region)
    if families is not None:
        r = r.where(F.col("model_family").isin(list(families)))
    return r.groupBy("scenario_category").agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"),
                                              F.count_distinct("model", "scenario").alias("combos"), F.count("*").alias("rows"))


def resolve_scenarios(df: DataFrame, region: str, names: Sequence[str] = (),
                      categories: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(requested names union scenarios of the categories in the region, invalid names)."""
    spark = df.sparkSession
    req = spark.createDataFrame([(n,) for n in names], "scenario string")
    known = df.select("scenario").distinct()
    invalid = req.join(known, "scenario", "left_anti")
    valid = req.join(known, "scenario", "left_semi")
    by_cat = df.where((F.col("region") == region) & F.col("scenario_category").isin(list(categories))) \
               .select("scenario")
    return valid.unionByName(by_cat).distinct(), invalid


def template_model(df: DataFrame, region: str, scenarios: DataFrame) -> DataFrame:
    """The model with data for most requested scenarios in the region, else globally (ties: model)."""
    req = df.join(scenarios, "scenario", "left_semi")
    counts = req.groupBy("model").agg(
        F.count_distinct(F.when(F.col("region") == region, F.col("scenario"))).alias("n_region"),
        F.count_distinct("scenario").alias("n_global"))
    pick = counts.agg(
        F.max(F.col("n_region")).alias("_mr"),
        F.min(F.struct((-F.col("n_region")).alias("a"), F.col("model").alias("m")))["m"].alias("_best_r"),
        F.min(F.struct((-F.col("n_global")).alias("a"), F.col("model").alias("m")))["m"].alias("_best_g"))
    return pick.select(F.when(F.col("_mr") > 0, F.col("_best_r")).otherwise(F.col("_best_g")).alias("model"),
                       F.when(F.col("_mr") > 0, F.lit("region")).otherwise(F.lit("global")).alias("scope"))


def representatives(df: DataFrame, min_rows: int = 200,
                    known_families: Sequence[str] | None = None) -> DataFrame:
    """First model (by name) of every family with at least ``min_rows`` rows."""
    d = df.where(F.col("model_family").isNotNull())
    if known_families is not None:
        d = d.where(F.col("model_family").isin(list(known_families)))
    return d.groupBy("model_family").agg(F.count("*").alias("_n"), F.min("model").alias("model")) \
            .where(F.col("_n") >= min_rows).select("model_family", "model")


def dropped_families(df: DataFrame, min_rows: int = 200) -> DataFrame:
    """Families that ``representatives`` leaves out, with their rows."""
    return df.where(F.col("model_family").isNotNull()).groupBy("model_family").agg(F.count("*").alias("rows")) \
             .where(F.col("rows") < min_rows)


def feature_lookup(df: DataFrame, reps: DataFrame, cols: Sequence[str], region: str) -> DataFrame:
    """Per representative model and year: median of ``cols`` in the region when the model has
    any value there, else over all regions; then interpolated over years."""
    d = df.join(reps.select("model"), "model", "left_semi")
    any_val = None
    for c in cols:
        e = F.col(c).isNotNull()
        any_val = e if any_val is None else any_val | e
    flag = d.groupBy("model").agg(F.max((F.col("region") == region) & any_val).alias("_in_region"))
    src = d.join(flag, "model").where(~F.col("_in_region") | (F.col("region") == region))
    med = grouped_medians(src, ["model", "year"], cols)
    per = med.groupBy("model", "year").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in cols])
    # every (model, year) of the source, also those without any value
    wide = src.select("model", "year").distinct().join(per, ["model", "year"], "left")
    return interpolate(wide, cols, ["model"], "year")


def synthesise(df: DataFrame, region: str, scenarios: DataFrame, template: str,
               reps: DataFrame, lookup: DataFrame, model_cols: Sequence[str],
               targets: Sequence[str]) -> DataFrame:
    """Real rows where present, otherwise template rows rewritten for each representative."""
    cols = df.columns
    s = scenarios  # data-derived: AQE broadcasts it when its runtime size allows
    actual = df.where(F.col("region") == region).join(s, "scenario", "left_semi") \
               .join(reps.select("model"), "model", "left_semi")
    tpl = df.where((F.col("model") == template) & (F.col("region") == region)).join(s, "scenario", "left_semi")
    # fallback: the template's rows of its first region (by name), relabelled
    tpl_any = df.where(F.col("model") == template).join(s, "scenario", "left_semi")
    first_region = tpl_any.agg(F.min("region").alias("_fr"))
    tpl_fb = tpl_any.join(F.broadcast(first_region), F.col("region") == F.col("_fr"), "left_semi") \
                    .withColumn("region", F.lit(region))
    none = tpl.agg((F.count("*") == 0).alias("_none"))  # one row: whether the fallback counts
    tpl = tpl.unionByName(tpl_fb.crossJoin(F.broadcast(none)).where("_none").drop("_none"))
    # one row that lists the families' representatives (bounded by the families)
    fan = reps.groupBy().agg(F.collect_list(F.struct(F.col("model").alias("m"), F.col("model_family").alias("f"))).alias("_reps"))
    cand = tpl.crossJoin(F.broadcast(fan)).select(*[c for c in cols if c not in ("model", "model_family")],
                                                  F.explode("_reps").alias("_rep")) \
              .select("*", F.col("_rep.m").alias("model"), F.col("_rep.f").alias("model_family")).drop("_rep")
    existing = actual.select("model", "scenario").distinct()
    cand = cand.join(existing, ["model", "scenario"], "left_anti")
    lk = lookup.select("model", "year", *[F.col(c).alias(f"_lk_{c}") for c in model_cols],
                       F.lit(True).alias("_lk"))
    cand = cand.join(lk, ["model", "year"], "left")
    out = []
    for c in cols:
        if c in model_cols:
            out.append(F.when(F.col("_lk"), F.col(f"_lk_{c}")).otherwise(F.col(c)).alias(c))
        elif c in targets:
            out.append(F.lit(None).cast("double").alias(c))
        else:
            out.append(F.col(c))
    synth = cand.select(*out)
    return actual.select(*cols).unionByName(synth)


def fill_rate(df: DataFrame, model_cols: Sequence[str]) -> DataFrame:
    """Rows, (model, scenario) combos and percent of filled model-specific cells."""
    filled = sum(F.col(c).isNotNull().cast("double") for c in model_cols) / len(model_cols)
    return df.agg(F.count("*").alias("rows"), F.count_distinct("model", "scenario").alias("combos"),
                  (F.avg(filled) * 100.0).alias("pct_filled"))


def ground_truth_rows(df: DataFrame, first_target: str) -> DataFrame:
    return df.where(F.col(first_target).isNotNull())
