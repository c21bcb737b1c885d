"""Runs stored as tables: what they hold, what is checked on load, forecasts; sparse indicators."""

import pytest
from pyspark.sql import functions as F

from panelstack.operators import encode as E
from panelstack.plans import infer as I

KEYS, TARGETS = ["model", "scenario", "region"], ["y", "z"]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"m{s % 3}", f"s{s % 4}", "EU" if s % 2 else "US", f"f{s % 3}" if s != 7 else None, 2000 + t, float(s + t + (s * t) % 5), float(2 * s - t * t % 7), None if (s + t) % 6 == 0 else float(t))
            for s in range(12) for t in range(8)]
    return spark.createDataFrame(rows, "model string, scenario string, region string, family string, year int, y double, z double, x double").repartition(3)


@pytest.fixture(scope="module")
def root(panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs"))
    for run in ("one", "two"):
        I.train_run(panel, path, run, KEYS, TARGETS, ["x"], ["family"], n_lags=2 if run == "two" else 1)
    return path


def test_runs_are_kept_apart(spark, root):
    one, two = I.load_run(spark, root, "one"), I.load_run(spark, root, "two")
    assert one.features == ("prev_y", "prev_z", "x", "family_code") and len(two.features) == 6
    assert one.lags == {"prev_y": ("y", 1), "prev_z": ("z", 1)} and two.lags["prev2_z"] == ("z", 2)
    assert [r.value for r in one.vocabulary("family").orderBy("code").collect()] == ["f0", "f1", "f2"]
    assert one.targets == ("y", "z") and one.categoricals == ("family",)


def test_forecast_by_hand(spark, root):
    run = I.load_run(spark, root, "one")
    rows = spark.createDataFrame([("m", "s", "EU", "f1", 2001, 3.0, 4.0, None), ("m", "s", "EU", "f9", 2002, 5.0, 6.0, 2.0)],
                                 "model string, scenario string, region string, family string, year int, prev_y double, prev_z double, x double")
    got = {r.year: (r.pred_y, r.pred_z) for r in I.forecast(rows, run, KEYS).collect()}
    coef = {(t, f): c for t, f, c in run.coefficients}

    def predict(values):
        out = []
        for t in TARGETS:
            at = lambda f: 0.0 if values[f] is None else (values[f] - run.scaler[f][0]) / run.scaler[f][1]
            v = coef[t, "(intercept)"] + sum(coef[t, f] * at(f) for f in run.features)
            out.append(v * run.scaler[t][1] + run.scaler[t][0])
        return out

    first = predict({"prev_y": 3.0, "prev_z": 4.0, "x": None, "family_code": 1})
    second = predict({"prev_y": first[0], "prev_z": first[1], "x": 2.0, "family_code": -1})
    assert got[2001] == pytest.approx(first) and got[2002] == pytest.approx(second)


@pytest.mark.parametrize("table,change,told", [
    ("scaler", lambda d: d.where("column <> 'x'"), "no scaler"),
    ("features", lambda d: d.where("position <> 1"), "numbered"),
    ("coefficients", lambda d: d.where("feature <> 'x'"), "coefficients of y"),
    ("vocabularies", lambda d: d.where("false"), "vocabularies"),
    ("features", lambda d: d.withColumn("target", F.when(F.col("target") == "y", "w").otherwise(F.col("target"))), "lags of targets"),
])
def test_artefacts_are_checked(spark, root, tmp_path, table, change, told):
    for name in I.TABLES:
        df = spark.read.parquet(f"{root}/{name}").where("run_id = 'one'")
        df = change(df.drop("run_id")).withColumn("run_id", F.lit("one")) if name == table else df
        df.write.partitionBy("run_id").parquet(str(tmp_path / name))
    with pytest.raises(ValueError, match=told):
        I.load_run(spark, str(tmp_path), "one")


def test_missing_runs(spark, root, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        I.load_run(spark, str(tmp_path), "one")
    with pytest.raises(ValueError):
        I.load_run(spark, root, "three")


def test_sparse_indicators_equal_dense(spark):
    rows = [(i, "abcdef"[i % 6] if i % 5 else None, i % 4 if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string, d int")
    train, test = df.where("id < 20 and c <> 'f'"), df.where("id >= 20")
    dense_train, (dense,), names = E.one_hot(train, [test], ["c", "d"])
    sparse_train, (sparse,), places = E.one_hot_sparse(train, [test], ["c", "d"])
    for a, b in ((dense_train, sparse_train), (dense, sparse)):
        wide = {r.id: [r[n] for n in names] for r in a.collect()}
        for r in b.collect():
            v = [0.0] * r.indicators["size"]
            for i, x in zip(r.indicators["indices"], r.indicators["values"]):
                v[i] = x
            assert v == wide[r.id]
    named = {r.place: f"{r['column']}_{'nan' if r.value is None else r.value}" for r in places.collect()}
    assert [named[i] for i in range(len(named))] == names
