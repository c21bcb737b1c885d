"""Closed-form fits against numpy, MLlib and fits of each fold by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators import linear as L
from panelstack.operators import model as G
from panelstack.operators import rollout as R

X, Y = ["a", "b", "c"], ["y", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(5)
    rows = []
    for s in range(12):
        for t in range(15):
            a, b, c = 1000 + 50 * g.normal(), g.normal(), 3 * g.normal() + 7
            rows.append((f"s{s}", t, s % 3, "train" if s < 8 else "val", a, b, c, 5.0, 2 * a - 1, 0.3 * a - 2 * b + 4 + g.normal(), b - c + 0.1 * g.normal()))
    rows.append(("s0", 99, 0, "train", None, 1.0, 1.0, 5.0, None, 1.0, 1.0))
    rows.append(("s0", 98, 0, "train", 1.0, 1.0, 1.0, 5.0, 1.0, None, 1.0))
    return spark.createDataFrame(rows, "k string, step long, fold int, split string, a double, b double, c double, flat double, twice double, y double, z double").repartition(3)


def arrays(df, features, where="true"):
    rows = df.where(where).dropna(subset=[*features, *Y]).select(*features, *Y).collect()
    m = np.array([tuple(r) for r in rows])
    return m[:, : len(features)], m[:, len(features) :]


def least_squares(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def table(df, features):
    got = {(r.target, r.feature): r.coefficient for r in df.collect()}
    return np.array([[got[t, f] for t in Y] for f in [L.INTERCEPT, *features]])


def test_fit_equals_numpy_and_mllib(frame):
    ours = table(L.fit_linear(frame, X, Y), X)
    x, y = arrays(frame, X)
    assert np.allclose(ours, least_squares(x, y), rtol=1e-8, atol=1e-8)
    models = G.fit_targets(frame.dropna(subset=[*X, *Y]), X, Y, "linear")
    theirs = np.array([[models[t].intercept, *models[t].coefficients] for t in Y]).T
    assert np.allclose(ours, theirs, rtol=1e-6, atol=1e-6)


def test_constant_and_dependent_columns_get_zero(frame):
    features = ["a", "flat", "b", "twice", "c"]
    ours = table(L.fit_linear(frame, features, Y), features)
    assert (ours[[2, 4]] == 0).all()
    x, y = arrays(frame, X)
    assert np.allclose(ours[[0, 1, 3, 5]], least_squares(x, y), rtol=1e-6, atol=1e-6)


def test_fit_by_group(frame):
    by = L.fit_linear(frame, X, Y, by=["fold"])
    for f in range(3):
        x, y = arrays(frame, X, f"fold = {f}")
        assert np.allclose(table(by.where(f"fold = {f}"), X), least_squares(x, y), rtol=1e-7, atol=1e-7)


def test_ridge_shrinks_correlations(frame):
    x, y = arrays(frame, X)
    xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    b = np.linalg.solve(xs.T @ xs / len(x) + 0.3 * np.eye(3), xs.T @ ys / len(x)) * y.std(0) / x.std(0)[:, None]
    assert np.allclose(table(L.fit_linear(frame, X, Y, ridge=0.3), X)[1:], b, rtol=1e-7)


def test_folds_equal_their_own_fits(frame):
    got = {(r.fold, r.ridge): r for r in L.cross_validate_linear(frame, X, Y, "fold", (0.0, 2.0)).collect()}
    assert len(got) == 6
    for f in range(3):
        b = least_squares(*arrays(frame, X, f"fold <> {f}"))
        x, y = arrays(frame, X, f"fold = {f}")
        rmse = np.sqrt(((np.column_stack([np.ones(len(x)), x]) @ b - y) ** 2).mean())
        assert abs(got[f, 0.0].rmse / rmse - 1) < 1e-7 and got[f, 0.0].rows == len(x) and got[f, 2.0].rmse > rmse
    plain = L.cross_validate_linear(frame, X, Y, "fold", (0.0, 2.0))
    assert {r.ridge: r.folds for r in L.mean_rmse(plain).collect()} == {0.0: 3, 2.0: 3}


def test_given_split(frame):
    row, = L.cross_validate_linear(frame, X, Y, "split", train="train").collect()
    b = least_squares(*arrays(frame, X, "split = 'train'"))
    x, y = arrays(frame, X, "split = 'val'")
    assert row.split == "val" and abs(row.rmse / np.sqrt(((np.column_stack([np.ones(len(x)), x]) @ b - y) ** 2).mean()) - 1) < 1e-7


def test_recursive_scores_equal_rollouts_of_each_fold(frame):
    df = frame.dropna(subset=[*X, *Y])
    lags = {"b": ("z", 1)}
    got = {r.fold: r.rmse for r in L.cross_validate_linear(df, X, Y, "fold", recursive=True, keys=["k"], lag_cols=lags).collect()}
    for f in range(3):
        fit = [tuple(r) for r in L.fit_linear(df.where(F.col("fold") != f), X, Y).collect()]
        held = df.where(F.col("fold") == f)
        preds = R.rollout_linear(held, ["k"], "step", Y, fit, lags)
        err = held.join(preds, ["k", "step"]).select(sum((F.col(t) - F.col(f"pred_{t}")) ** 2 for t in Y).alias("e")).agg(F.avg("e") / len(Y)).first()[0]
        assert abs(got[f] / np.sqrt(err) - 1) < 1e-7


def test_one_scan(frame, spark, tmp_path):
    frame.write.parquet(str(tmp_path / "t"))
    df = L.cross_validate_linear(spark.read.parquet(str(tmp_path / "t")), X, Y, "fold", (0.0, 1.0))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_no_rows(frame):
    assert L.fit_linear(frame.limit(0), X, Y).count() == 0
    assert L.cross_validate_linear(frame.limit(0), X, Y, "fold").count() == 0
    assert L.cross_validate_linear(frame.where("fold = 1"), X, Y, "fold").count() == 0  # nothing to fit on
