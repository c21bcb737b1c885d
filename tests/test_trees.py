"""Ensembles as node tables: predictions, forecasts and contributions against MLlib and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators import model as G
from panelstack.operators import rollout as R
from panelstack.operators import trees as TR

X, Y = ["a", "b", "c", "prev_y"], ["y", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(4)
    rows = []
    for s in range(14):
        last = float(g.normal())
        for t in range(9):
            a, b, c = (float(v) for v in g.normal(size=3))
            y = 0.5 * last + a * b + (c > 0)
            rows.append((f"s{s}", t, a, b, c, last, y, a - c * b))
            last = y
    return spark.createDataFrame(rows, "k string, step long, a double, b double, c double, prev_y double, y double, z double").repartition(3)


@pytest.fixture(scope="module")
def models(frame):
    return G.fit_targets(frame, X, Y, "gbt", maxIter=4, maxDepth=3)


@pytest.fixture(scope="module")
def nodes(spark, models):
    return TR.node_table(spark, models)


def test_predictions_equal_mllib(frame, models, nodes):
    key = ["k", "step"]
    ours = {tuple(r[c] for c in key): (r.pred_y, r.pred_z) for r in TR.predict_trees(frame, nodes, X, Y).collect()}
    theirs = {tuple(r[c] for c in key): (r.pred_y, r.pred_z) for r in G.predict(models, frame, X).collect()}
    assert ours.keys() == theirs.keys() and all(np.allclose(ours[k], theirs[k], rtol=1e-12, atol=1e-12) for k in ours)


def test_rollout_equals_stepwise_with_one_exchange(frame, models, nodes):
    lags = {"prev_y": ("y", 1)}
    folded = TR.rollout_trees(frame, ["k"], "step", Y, nodes, X, lags)
    steps = R.rollout_stepwise(frame, ["k"], "step", Y, lambda rows: G.predict(models, rows, X), lags)
    ours = {(r.k, r.step): (r.pred_y, r.pred_z) for r in folded.collect()}
    theirs = {(r.k, r.step): (r.pred_y, r.pred_z) for r in steps.collect()}
    assert ours.keys() == theirs.keys() and all(np.allclose(ours[k], theirs[k], rtol=1e-12, atol=1e-12) for k in ours)
    stored = frame.sparkSession.createDataFrame(frame.collect(), frame.schema)
    plan = TR.rollout_trees(stored, ["k"], "step", Y, nodes, X, lags)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def value_of(tree, at, x, known):
    """The mean of the leaves reached with the known features, other splits followed both ways by training rows."""
    r = tree[at]
    if r.left < 0:
        return r.value
    if r.feature in known:
        return value_of(tree, r.left if x[r.feature] <= r.threshold else r.right, x, known)
    return sum(tree[c].cover / r.cover * value_of(tree, c, x, known) for c in (r.left, r.right))


def test_contributions_equal_all_subsets(frame, nodes):
    leaves = TR.leaf_table(nodes)
    base = {r.target: r.base for r in leaves.collect()}
    rows = {(r.k, r.step): [r[c] for c in X] for r in frame.where("k < 's11'").collect()}
    got = {}
    for r in TR.tree_attribution(frame.where("k < 's11'"), ["k", "step"], X, leaves).collect():
        got.setdefault((r.k, r.step, r.target), {})[r.feature] = r.contribution
    trees = TR._trees(nodes)
    p = len(X)
    for (k, step, target), shares in got.items():
        x = rows[k, step]
        value = {known: sum(value_of(t, 0, x, known) for t in trees[target]) for n in range(p + 1) for known in itertools.combinations(range(p), n)}
        assert base[target] + sum(shares.values()) == pytest.approx(value[tuple(range(p))], abs=1e-9)
        assert base[target] == pytest.approx(value[()], abs=1e-9)
        for j, f in enumerate(X):
            brute = sum(math.factorial(len(s)) * math.factorial(p - 1 - len(s)) / math.factorial(p) * (value[tuple(sorted((*s, j)))] - value[s]) for s in value if j not in s)
            assert shares[f] == pytest.approx(brute, abs=1e-9)
    assert len(got) == 2 * len(rows)


def test_single_leaf_and_nulls(spark, nodes):
    lone = spark.createDataFrame([("y", 0, 0, -1, None, -1, -1, 2.5, 7)], nodes.schema)
    one = spark.createDataFrame([("k", 0, None, 1.0, None, 2.0)], "k string, step long, a double, b double, c double, prev_y double")
    assert TR.predict_trees(one, lone, X, ["y"]).first().pred_y == 2.5
    leaves = TR.leaf_table(lone)
    assert leaves.first().base == 2.5 and {r.contribution for r in TR.tree_attribution(one, ["k"], X, leaves).collect()} == {0.0}
    assert TR.predict_trees(one, nodes, X, Y).first().pred_y is not None
    got = TR.tree_attribution(one, ["k"], X, TR.leaf_table(nodes)).groupBy("target").agg(F.sum("contribution").alias("s")).collect()
    made = TR.predict_trees(one, nodes, X, Y).first()
    base = {r.target: r.base for r in TR.leaf_table(nodes).collect()}
    assert all(base[r.target] + r.s == pytest.approx(made[f"pred_{r.target}"]) for r in got)
