"""Rules that data can break silently: null keys, repeated dimension rows, ties, stage names, empty branches."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelstack.functions.columns import feature_label
from panelstack.operators import attribution as J
from panelstack.operators import counterfactual as Kf
from panelstack.operators import metrics as H
from panelstack.operators import model as G
from panelstack.operators import quality as Q
from panelstack.operators import split as S
from panelstack.session import shared_dir
from panelstack.sources import files


def test_splits_keep_series_with_null_keys(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "s", x) for i in range(12) for x in (1, 2)], "a int, b string, x int")
    for out in (S.split_by_series(df, ["a", "b"], 0.2, 0.2), S.group_kfold(df, ["a", "b"], 3), S.holdout_series(df, ["a", "b"], 0.5)):
        assert out.count() == df.count()
        assert out.columns[:3] == df.columns


def test_ledger_keeps_text_stages(spark):
    path = shared_dir(spark, "ledger")
    rows = spark.createDataFrame([(0.5, "stage1", 0), (0.25, "stage2", 1)], "val_loss double, stage string, trial_id long")
    files.append_trials(rows, path)
    got = files.read_trials(spark, path)
    assert sorted((r.stage, r.val_loss) for r in got.collect()) == [("stage1", 0.5), ("stage2", 0.25)]


def test_repeated_dimension_rows_do_not_repeat_facts(spark):
    facts = spark.createDataFrame([("v", "s", "m", 3)], "variable string, scenario string, model string, count long")
    kinds = spark.createDataFrame([("v", "late", 2), ("v", "first", 1)], "variable string, type string, file_order int")
    assert [r.type for r in Q.join_classification(facts, kinds).collect()] == ["first"]
    cats = spark.createDataFrame([("s", "C3"), ("s", "C1")], "scenario string, scenario_category string")
    assert [r.scenario_category for r in Q.join_scenario_category(facts, cats).collect()] == ["C1"]


def test_base_year_takes_the_first_declared(spark):
    panel = spark.createDataFrame([("m", y) for y in (2000, 2010, 2020)], "model string, year int")
    declared = spark.createDataFrame([("m", "2015", 3), ("m", " ", 1), ("m", "2005", 2)], "model string, base_year string, file_order int")
    r = Q.effective_base_year(panel, declared.repartition(3)).first()
    assert (r.candidate, r.effective_base_year) == (2005, 2010)


def test_metrics_count_complete_pairs_only(spark):
    rows = [("R10a", 1.0, 1.5), ("R10a", 2.0, 2.0), ("R10a", 9.0, None), ("R10a", None, 4.0)]
    df = spark.createDataFrame(rows, "region string, y0 double, p0 double")
    m = H.metrics(df, ["y0"], ["p0"]).first()
    assert m.sample_size == 2 and m.mse == pytest.approx(0.125) and m.r2 == pytest.approx(1 - 0.25 / 0.5)
    assert {r.sample_size for r in H.metrics_by_region_type(df, ["y0"], ["p0"]).collect()} == {2}


def test_missing_matrix_is_rectangular(spark):
    df = spark.createDataFrame([("s", "a", 1, 1.0), ("s", "a", 2, 1.0), ("s", "b", 1, None)], "series string, variable string, year int, value double")
    got = {(r.variable, r.year): (r.present, r.missing) for r in Q.missing_matrix(df, ["series"]).collect()}
    assert got == {("a", 1): (1, 0), ("a", 2): (1, 0), ("b", 1): (0, 1), ("b", 2): (0, 1)}


def test_zero_is_a_minimum_count(spark):
    df = spark.createDataFrame([("v", 5, "input")], "variable string, count long, type string")
    assert Q.select_variables(df, 0, []).count() == 1 and Q.select_variables(df, None, []).count() == 0


def test_best_per_settles_ties(spark):
    df = spark.createDataFrame([("s", 1.0, 7), ("s", 1.0, 3), ("s", float("nan"), 1)], "stage string, val_loss double, trial_id long").repartition(3)
    assert G.best_per(df, "stage").first().trial_id == 3


def test_dropped_families_are_reported(spark):
    df = spark.createDataFrame([("a", "m1")] * 3 + [("b", "m2")], "model_family string, model string")
    assert [r.model_family for r in Kf.representatives(df, 2).collect()] == ["a"]
    assert [tuple(r) for r in Kf.dropped_families(df, 2).collect()] == [("b", 1)]


def test_synthesis_without_families_gives_real_rows_only(spark):
    cols = "model string, scenario string, region string, year int, x double, t double, model_family string"
    df = spark.createDataFrame([("m", "s", "EU", 1, 1.0, 2.0, "m")], cols)
    none = df.select("model_family", "model").limit(0)
    lookup = spark.createDataFrame([], "model string, year int, x double")
    assert Kf.synthesise(df, "EU", df.select("scenario"), "m", none, lookup, ["x"], ["t"]).count() == 0


def test_linear_importance_equals_the_mean_of_contributions(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 7.0), (3, 4.0, 1.0)], "id int, a double, b double")
    coefs = spark.createDataFrame([("t", "a", -2.0), ("t", "b", 0.5), ("u", "a", 1.0), ("u", "b", 0.0), ("u", "(intercept)", 9.0)], "target string, feature string, coefficient double")
    means = J.feature_means(rows, ["a", "b"])
    long = J.importance(J.linear_attribution(rows, ["id"], ["a", "b"], coefs, means)).collect()
    wide = J.linear_importance(rows, ["a", "b"], coefs, means).collect()
    key = lambda rs: sorted((r.target, r.feature, round(r.mean_abs, 9), r["rank"]) for r in rs)
    assert key(long) == key(wide) and len(wide) == 4


def test_feature_label_forms(spark):
    names = {"gdp": "gdp (current)", "prev_gdp": "gdp (last 5y)", "prev3_gdp": "gdp (last 15y)", "timestep_0_gdp": "gdp (current)",
             "timestep_2_gdp": "gdp (last 10y)", "timestep_2_prev_gdp": "gdp (last 5y)", "prev_x_is_missing": "x (last 5y) N/A", "previous": "previous (current)"}
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert {r.f: r.label for r in df.select("f", feature_label("f").alias("label")).collect()} == names


@pytest.mark.parametrize("name,least", [("c8_unit_conflicts_mixed", 1), ("d14_check_scale_coverage_gap", 1), ("e5_unseen_models", 1), ("f13_first_dropped_gap", 1)])
def test_defining_branches_have_rows(spark, name, least):
    assert entry.queries()[name](spark, "/root/testdata/sf0.01").count() >= least


def test_counterfactual_rows_are_made(spark):
    rows = entry.queries()["k6_synthesise"](spark, "/root/testdata/sf0.01")
    made = rows.where(F.col("economy").isNull() & F.col("large").isNull() & F.col("medium").isNull())
    assert made.count() >= 20 and rows.count() > made.count()
