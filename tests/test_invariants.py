"""Invariants and guards of the operators (splits, scaling, medians, windows)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators import encode as E
from panelstack.operators import features as D
from panelstack.operators import quality as Q
from panelstack.operators import rollout as R
from panelstack.operators import split as S
from panelstack.operators.reshape import unpivot_years
from panelstack.operators.stats import exact_median, grouped_medians
from panelstack.plans.base import KEYS, TARGETS, ragged_wide, yearly_wide
from panelstack.sources import files

SF_SMALL = "/root/testdata/sf0.001"


def test_split_disjoint_exhaustive_exact_counts(spark):
    w = yearly_wide(spark, SF_SMALL)
    sp = S.split_by_series(w, KEYS, 0.1, 0.1, seed=0)
    per = sp.select(*KEYS, "split").distinct()
    n = w.select(*KEYS).distinct().count()
    assert per.count() == n  # every series in exactly one split
    counts = {r.split: r["count"] for r in per.groupBy("split").count().collect()}
    assert counts.get("test", 0) == int(n * 0.1) and counts.get("val", 0) == int(n * 0.1)
    assert sp.count() == w.count()


def test_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "k string")
    r = S.rank_groups(df, ["k"], seed=7)
    ranks = sorted(x.rank for x in r.collect())
    assert ranks == list(range(5000))


def test_interpolate_idempotent(spark):
    w = ragged_wide(spark, SF_SMALL)
    once = D.interpolate(w, TARGETS, KEYS)
    twice = D.interpolate(once, TARGETS, KEYS)
    assert once.exceptAll(twice).count() == 0


def test_scale_unscale_round_trip(spark):
    w = yearly_wide(spark, SF_SMALL)
    st = E.fit_scaler(w, ["promo"])
    back = E.unscale(E.scale(w, st, ["promo"]), st, ["promo"])
    diff = w.join(back.withColumnRenamed("promo", "p2"), KEYS + ["year"]) \
            .select(F.max(F.abs(F.col("promo") - F.col("p2")))).collect()[0][0]
    assert diff is None or diff < 1e-9


def test_per_capita_round_trip(spark):
    w = yearly_wide(spark, SF_SMALL)
    back = D.from_per_capita(D.per_capita(w, TARGETS, "standard"), TARGETS, "standard")
    j = w.join(back.select(*KEYS, "year", F.col("economy").alias("e2")), KEYS + ["year"])
    bad = j.where((F.col("standard") > 0) & (F.abs(F.col("economy") - F.col("e2")) > 1e-9)).count()
    assert bad == 0


def test_exact_median_matches_numpy_with_hot_value(spark):
    rng = random.Random(3)
    rows = [("hot", 7.0)] * 3000 + [("hot", rng.random()) for _ in range(2001)] + \
           [("cold", float(i)) for i in range(11)] + [("cold", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r.median for r in exact_median(df, ["g"], buckets=16).collect()}
    for g in ("hot", "cold"):
        vals = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(float(np.median(vals)))


def test_rollout_zero_lag_is_plain_prediction(spark):
    rows = [("s", i, float(i), 100.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, step int, x double, prev_y double")
    coefs = [("y", "(intercept)", 1.0), ("y", "x", 2.0), ("y", "prev_y", 0.0)]
    out = R.rollout_linear(df, ["k"], "step", ["y"], coefs, {"prev_y": ("y", 1)})
    assert [r.pred_y for r in out.orderBy("step").collect()] == [1.0 + 2.0 * i for i in range(5)]


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_raw_wide(spark, [str(tmp_path / "missing.csv")])
    df = spark.createDataFrame([("a", "1")], "model string, note string")
    with pytest.raises(ValueError):
        unpivot_years(df)
    with pytest.raises(ValueError):
        Q.completeness_filter(df, ["note"], 0.0, 5)
    with pytest.raises(KeyError):
        Q.join_ssp_family(df, spark.createDataFrame([("a",)], "model string"))
    conflict = spark.createDataFrame([("m", "s", "r", "v", "EJ/yr"), ("m", "s", "r", "v", "PJ/yr")],
                                     "model string, scenario string, region string, variable string, unit string")
    with pytest.raises(ValueError):
        Q.unit_conflicts(conflict, strict=True)


def test_ledger_skips_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([(1, "completed", 0.5)], "trial_id long, status string, val_loss double") \
         .write.json(path)
    spark.createDataFrame([("{oops",)], "value string").write.mode("append").text(path)
    got = files.read_trials(spark, path).collect()
    assert len(got) == 1 and got[0].trial_id == 1


def test_attach_truth_keeps_horizon_row_count(spark):
    h = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("t", 0, 3.0)], "k string, step long, p double")
    test = spark.createDataFrame([("s", 0, 2020, 5.0), ("s", 0, 2019, 6.0), ("s", 1, 2021, 7.0)],
                                 "k string, step long, year int, y double")
    from panelstack.operators import windows as W
    out = W.attach_truth(h, test, ["k"], ["year", "y"])
    assert out.count() == h.count()
    assert {(r.k, r.step): r.year for r in out.collect()}[("s", 0)] == 2019


def test_exact_median_small_buckets_many_groups(spark):
    rng = random.Random(11)
    rows = []
    for g in range(6):
        n = rng.randint(1, 400)
        rows += [(f"g{g}", float(rng.randint(0, 50))) for _ in range(n)]  # many ties
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r.median for r in exact_median(df, ["g"], buckets=4, levels=3).collect()}
    for g in {k for k, _ in rows}:
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])))


def test_rank_trials_resume_bookkeeping(spark):
    from panelstack.operators import model as G
    keys = ("dropout", "hidden_size", "learning_rate", "lstm_layers")
    schema = ("dropout double, hidden_size long, learning_rate double, lstm_layers long, "
              "val_loss double, status string, stage string, trial_id long, signature string")
    ledger = spark.createDataFrame([
        (0.1, 16, 0.01, 1, 0.50, "completed", "stage1", 1, None),
        (0.2, 16, 0.01, 1, 0.40, "completed", "stage1", 2, None),
        (0.2, 16, 0.01, 1, 0.45, "completed", "stage1", 3, None),   # duplicate signature
        (0.3, 32, 0.01, 2, float("nan"), "completed", "stage1", 4, None),  # not finite
        (0.1, 16, 0.01, 1, 0.30, "completed", "stage2", 5, None),
        (0.4, 32, 0.01, 2, 0.10, "running", "stage1", 6, None),     # not completed
    ], schema)
    cand = spark.createDataFrame([(0.1, 16, 0.01, 1), (0.2, 16, 0.01, 1), (0.3, 32, 0.01, 2)],
                                 "dropout double, hidden_size long, learning_rate double, lstm_layers long")
    out = G.rank_trials(ledger, cand, top_k=2, keys=keys)
    assert sorted(r.dropout for r in out["stage1_remaining"].collect()) == [0.3]
    assert [r.val_loss for r in out["stage2_candidates"].collect()] == [0.40, 0.50]
    assert [r.dropout for r in out["stage2_remaining"].collect()] == [0.2]
    best = out["best"].collect()[0]
    assert best.stage == "stage2" and best.val_loss == 0.30


def test_grouped_medians_equal_numpy(spark):
    """Hot values and groups, null groups and values, empty columns, negative and infinite values, the total."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([3.0, 3.0, rng.gauss(0, 9), None]), rng.lognormvariate(0, 6) * rng.choice([-1, 1]), None) for _ in range(6000)]
    rows += [("c", 1.0, float("inf"), None), ("c", 2.0, 4.0, None), ("d", None, -0.0, None), ("e", 5.0, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    for accuracy in (10_000, 40):  # at 40 a tenth of the rows lies between the bounds, at 10,000 a few
        got = {(r.g, r["_all"], r.feature): r.median for r in grouped_medians(df, ["g"], ["x", "y", "z"], total=True, accuracy=accuracy).collect()}
        expected = {}
        for i, c in enumerate("xyz", 1):
            for g in ("a", "b", None, "c", "d", "e"):
                if v := [r[i] for r in rows if r[0] == g and r[i] is not None]:
                    expected[g, False, c] = float(np.median(v))
            if v := [r[i] for r in rows if r[i] is not None]:
                expected[None, True, c] = float(np.median(v))
        assert got == pytest.approx(expected)
    one = grouped_medians(df, [], ["x"]).collect()
    assert len(one) == 1 and one[0]["median"] == pytest.approx(float(np.median([r[1] for r in rows if r[1] is not None])))
    assert grouped_medians(df.limit(0), ["g"], ["x"], total=True).count() == 0


def test_medians_outside_the_bounds_are_still_exact(spark, monkeypatch):
    """If the percentiles did not bracket a median, all values of the column are ranked."""
    from pyspark.sql import functions as F

    from panelstack.operators import stats

    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, near, accuracy: F.array(F.max(c), F.max(c)))
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "g string, x double")
    assert [r["median"] for r in stats.grouped_medians(df, ["g"], ["x"], total=True).collect()] == [50.0, 50.0]
