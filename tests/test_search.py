"""The staged search: its trials, its best points, and going on after it was ended."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators import search as S

STAGES = [{"maxDepth": [1, 2], "minInstancesPerNode": [1, 4]}, {"stepSize": [0.1, 0.5], "maxIter": [1, 2]}, {"featureSubsetStrategy": ["all", "sqrt"]}]


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(1)
    rows = [(int(i % 3), float(a), float(b), float(3 * a - b), float(a * b)) for i, (a, b) in enumerate(g.normal(size=(90, 2)))]
    return spark.createDataFrame(rows, "fold int, a double, b double, y double, z double")


class Ended(Exception):
    pass


def test_ended_search_goes_on(spark, frame, tmp_path):
    calls, lock = [], threading.Lock()

    def fit(data, algo, params, target, fold_col, fold, after=None):
        with lock:
            calls.append((tuple(sorted(params.items())), target, fold))
            if after is not None and len(calls) > after:
                raise Ended
        # a made loss: deeper, slower and "sqrt" are better
        return 10.0 - params["maxDepth"] - params.get("maxIter", 0) + params.get("stepSize", 0) - (params.get("featureSubsetStrategy") == "sqrt"), 1

    whole = S.search(frame, ["a", "b"], ["y", "z"], "fold", STAGES, str(tmp_path / "whole"), fit=fit)
    losses = sorted((r.stage, r.trial_id, round(r.val_loss, 9)) for r in whole.collect())
    assert [s for s, _, _ in losses] == ["stage1"] * 4 + ["stage2"] * 4 + ["stage3"] * 2
    assert len(calls) == len(set(calls)) == 10 * 3 * 2
    last = whole.where("stage = 'stage3'").orderBy("val_loss").first()
    assert (last.maxDepth, last.stepSize, last.maxIter, last.featureSubsetStrategy) == (2.0, 0.1, 2.0, "sqrt")

    path = str(tmp_path / "ended")
    for after in (15, 17, 40):
        calls.clear()
        with pytest.raises(Ended):
            S.search(frame, ["a", "b"], ["y", "z"], "fold", STAGES, path, parallelism=2, fit=lambda *a, after=after: fit(*a, after=after))
    kept = S.read_trials(spark, path, S.ledger_schema(STAGES)).count()
    assert 4 <= kept < 10
    calls.clear()
    again = S.search(frame, ["a", "b"], ["y", "z"], "fold", STAGES, path, fit=fit)
    assert sorted((r.stage, r.trial_id, round(r.val_loss, 9)) for r in again.collect()) == losses
    assert len(calls) == (10 - kept) * 6  # nothing of the ledger was run again
    calls.clear()
    S.search(frame, ["a", "b"], ["y", "z"], "fold", STAGES, path, fit=fit)
    assert not calls


def test_losses_are_the_folds_errors(spark, frame, tmp_path):
    stages = [{"regParam": [0.0, 5.0]}]
    got = {r.regParam: r.val_loss for r in S.search(frame, ["a", "b"], ["y", "z"], "fold", stages, str(tmp_path / "l"), algo="linear").collect()}
    rows = np.array([tuple(r) for r in frame.collect()])
    errors = []
    for f in range(3):
        held = rows[:, 0] == f
        x = np.column_stack([np.ones(len(rows)), rows[:, 1:3]])
        b = np.linalg.lstsq(x[~held], rows[~held, 3:], rcond=None)[0]
        errors.append(np.sqrt(((x[held] @ b - rows[held, 3:]) ** 2).mean()))
    assert got[0.0] == pytest.approx(np.mean(errors), rel=1e-6) and got[5.0] > got[0.0]


def test_points_of_fewer_trees_share_a_fit(frame, tmp_path, monkeypatch):
    stages = [{"maxDepth": [2], "stepSize": [0.3], "maxIter": [2]}, {"stepSize": [0.1, 0.3], "maxIter": [1, 2, 3]}, {"subsamplingRate": [0.6]}]
    made, make = [], S.make_estimator
    monkeypatch.setattr(S, "make_estimator", lambda *a, **p: made.append(p) or make(*a, **p))
    one = frame.coalesce(1)  # samples go by the order of rows
    alone = S.search(one, ["a", "b"], ["y"], "fold", stages, str(tmp_path / "alone"), fit=S.fold_error)
    assert len(made) == (1 + 6 + 1) * 3
    made.clear()
    shared = S.search(one, ["a", "b"], ["y"], "fold", stages, str(tmp_path / "shared"))
    assert len(made) == (1 + 2 + 1) * 3  # the six points of stage 2 are two ensembles of three trees
    ours, theirs = ({(r.stage, r.trial_id): r for r in s.collect()} for s in (shared, alone))
    assert ours.keys() == theirs.keys()
    for k, r in ours.items():
        assert r.val_loss == pytest.approx(theirs[k].val_loss, rel=1e-12)
        assert [r[c] for c in r.__fields__ if c != "val_loss"] == [theirs[k][c] for c in r.__fields__ if c != "val_loss"]


def test_small_table_is_few_parts(frame, tmp_path):
    seen = []

    def fit(data, algo, params, target, fold_col, fold):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return 1.0, 1

    S.search(frame.repartition(40), ["a", "b"], ["y"], "fold", [{"maxDepth": [1]}], str(tmp_path / "p"), fit=fit)
    assert set(seen) == {(1, 90)}
