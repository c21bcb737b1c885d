"""Tiny hand-typed cases for the semantic traps (FIXTURES.md part 3)."""

import pytest
from pyspark.sql import functions as F

from panelstack.functions.columns import feature_label, model_family, short_number
from panelstack.operators import encode as E
from panelstack.operators import features as D
from panelstack.operators import rollout as R
from panelstack.operators import split as S
from panelstack.operators import windows as W
from panelstack.operators.reshape import pivot_variables
from panelstack.operators.stats import exact_median


def test_interpolate_inside_linear_edges_clamped(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in
                                [(2010, None), (2015, 1.0), (2020, None), (2030, 4.0), (2035, None)]]
                               + [("b", 2010, None), ("b", 2020, None)], "k string, year int, x double")
    out = {(r.k, r.year): r.x for r in D.interpolate(df, ["x"], ["k"]).collect()}
    assert [out[("a", y)] for y in (2010, 2015, 2020, 2030, 2035)] == [1.0, 1.0, 2.0, 4.0, 4.0]
    assert out[("b", 2010)] is None and out[("b", 2020)] is None


def test_pivot_drops_null_keys_and_empty_rows(spark):
    long = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("a", "x", 3.0), ("b", "x", None), ("b", "y", None), (None, "x", 9.0)],
        "k string, variable string, value double").withColumn("year", F.lit(2020))
    rows = pivot_variables(long, ["x", "y"], ["k"]).collect()
    assert [(r.k, r.x, r.y) for r in rows] == [("a", 2.0, None)]


def test_model_family(spark):
    df = spark.createDataFrame([("REMIND-MAgPIE 2.1",), ("AIM/CGE 2.0",), ("GCAM_5",)], "m string")
    assert [r[0] for r in df.select(model_family("m")).collect()] == ["REMIND", "AIM", "GCAM"]


def test_encode_fixed_unknown_is_minus_one(spark):
    vocab = spark.createDataFrame([("A", 0)], "value string, code int")
    df = spark.createDataFrame([("Z",), ("A",)], "r string")
    out = {r.r: r.r_code for r in E.encode_fixed(df, "r", vocab).collect()}
    assert out == {"Z": -1, "A": 0}


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    row = E.fit_scaler(df, ["x"]).collect()[0]
    assert row.x_mean == 5.0 and row.x_scale == 1.0


def test_median_even_count(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 10)], "g string, value double")
    assert exact_median(df, ["g"]).collect()[0].median == 2.5


def test_group_kfold_sizes(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(13)], "k string")
    sizes = sorted((r["count"] for r in S.group_kfold(df, ["k"], 5).groupBy("fold").count().collect()),
                   reverse=True)
    assert sizes == [3, 3, 3, 2, 2]
    with pytest.raises(ValueError):
        S.group_kfold(df.limit(3), ["k"], 5)


def test_rollout_fixture(spark):
    # y = 0.6 lag1 + 0.3 lag2 + x; seeds (oldest first) 10, 20
    rows = [("s", 0, 1.0, 20.0, 10.0), ("s", 1, 2.0, None, 20.0), ("s", 2, 3.0, None, None),
            ("s", 3, 4.0, None, None)]
    df = spark.createDataFrame(rows, "k string, step int, x double, prev_y double, prev2_y double")
    coefs = [("y", "x", 1.0), ("y", "prev_y", 0.6), ("y", "prev2_y", 0.3)]
    out = R.rollout_linear(df, ["k"], "step", ["y"], coefs, {"prev_y": ("y", 1), "prev2_y": ("y", 2)})
    got = [round(r.pred_y, 6) for r in out.orderBy("step").collect()]
    assert got == [16.0, 17.6, 18.36, 20.296]


def test_blend_linear_weights_and_single_overlap(spark):
    early = spark.createDataFrame([("s", i, 10.0) for i in range(4)] + [("t", 0, 10.0)],
                                  "k string, step int, p double")
    late = spark.createDataFrame([("s", i, 20.0) for i in range(2, 6)] + [("t", 0, 20.0)],
                                 "k string, step int, p double")
    out = {(r.k, r.step): r.p for r in W.blend_windows(early, late, ["k"], ["p"]).collect()}
    assert [out[("s", i)] for i in range(6)] == [10.0, 10.0, 10.0, 20.0, 20.0, 20.0]
    assert out[("t", 0)] == 15.0


def test_feature_labels(spark):
    names = ["prev_x", "prev2_x", "x", "x_is_missing", "timestep_2_x", "timestep_0_y"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in df.select(feature_label("f")).collect()]
    assert got == ["x (last 5y)", "x (last 10y)", "x (current)", "x (current) N/A", "x (last 10y)",
                   "y (current)"]


def test_short_numbers(spark):
    df = spark.createDataFrame([(1500000.0,), (2000.0,), (0.0,), (3.4,), (2500.0,)], "v double")
    got = [r[0] for r in df.select(short_number("v")).collect()]
    assert got == ["1.5M", "2k", "0", "3.4", "2.5k"]


def test_one_hot_unseen_is_all_zero_and_null_has_own_dummy(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    other = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    _, others, names = E.one_hot(train, [other], ["c"])
    assert names == ["c_a", "c_b", "c_nan"]
    rows = [tuple(r) for r in others[0].select(*names).collect()]
    assert sorted(rows) == sorted([(0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)])


def test_union_vocab_closed_and_sorted(spark):
    a = spark.createDataFrame([("x",), (None,)], "c string")
    b = spark.createDataFrame([("w",), ("x",)], "c string")
    got = [(r.value, r.code) for r in E.union_vocab([a, b], "c").orderBy("code").collect()]
    assert got == [("__NA__", 0), ("w", 1), ("x", 2)]
