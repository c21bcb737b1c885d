"""Staged search over a table of parameters, resumable from its ledger (G3 on G4's bookkeeping).

Every trial is one point of a stage's grid: a fit for each fold and target, from a pool of a bounded number of
threads over one stored table of assembled features (Spark runs the jobs of several fits side by side). A fit is
some jobs for every level of every tree, so the table has as few files as its rows need, whatever made it, and
points that differ only in their number of trees share one fit: boosting adds trees to those it has. A trial is
appended to the JSON-lines ledger (A8) as soon as its last fit ends, by the one thread that writes. A search that
was ended begins again by reading the ledger: trials whose signature is there are not run again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from ..sources.files import append_trials, read_trials
from .model import FEATURES_COL, assemble, completed_trials, make_estimator, signature


#: Rows for which a task of a fit is worth its start.
TASK_ROWS = 1 << 17


def ledger_schema(stages: Sequence[dict[str, list]]) -> T.StructType:
    """One column a parameter (text or double), val_loss, stage, status, trial_id."""
    values = {k: v for grid in stages for k, vs in grid.items() for v in vs}
    return T.StructType([*(T.StructField(k, T.StringType() if isinstance(v, str) else T.DoubleType()) for k, v in sorted(values.items())),
                         T.StructField("val_loss", T.DoubleType()), T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("trial_id", T.LongType())])


def _row(point: dict, schema: T.StructType, **rest):
    out = []
    for f in schema.fields:
        v = rest.get(f.name, point.get(f.name))
        out.append(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v)
    return tuple(out)


def remaining(spark: SparkSession, points: list[dict], ledger: DataFrame, stage: str, schema: T.StructType) -> list[dict]:
    """The points without a completed trial of this stage (a grid is as long as its parameters say)."""
    keys = [k for k in sorted(points[0])]
    done = completed_trials(ledger.where(F.col("stage") == stage), keys)
    fields = T.StructType([*(f for f in schema.fields if f.name in keys), T.StructField("trial_id", T.LongType())])
    todo = spark.createDataFrame([_row(p, fields, trial_id=i) for i, p in enumerate(points)], fields)
    todo = todo.withColumn("signature", signature(todo, keys)).join(done.select(signature(done, keys).alias("signature")), "signature", "left_anti")
    return [points[i] for i in sorted(r.trial_id for r in todo.select("trial_id").collect())]


def fold_error(data: DataFrame, algo: str, params: dict, target: str, fold_col: str, fold) -> tuple[float, int]:
    """(squared error, rows) of one target's fit on all folds but this one."""
    model = make_estimator(algo, target, **params).fit(data.where(F.col(fold_col) != fold))
    miss = F.col(target) - F.col(f"pred_{target}")
    row = model.transform(data.where(F.col(fold_col) == fold)).agg(F.sum(miss * miss), F.count("*")).first()
    return float(row[0] or 0.0), int(row[1])


def fold_errors(data: DataFrame, algo: str, points: Sequence[dict], target: str, fold_col: str, fold, n: int) -> list[tuple[float, int]]:
    """``fold_error`` of points of one ``shared_fits`` group; ``n`` is the fold's number of rows."""
    if algo != "gbt" or "maxIter" not in points[0]:
        return [fold_error(data, algo, p, target, fold_col, fold) for p in points]
    most = max(points, key=lambda p: p["maxIter"])
    model = make_estimator(algo, target, **most).fit(data.where(F.col(fold_col) != fold))
    means = model.evaluateEachIteration(data.where(F.col(fold_col) == fold), "squared")
    return [(means[p["maxIter"] - 1] * n, n) for p in points]


def shared_fits(points: dict[int, dict], algo: str) -> list[list[int]]:
    """The points by fit: an ensemble of fewer trees is the beginning of one that differs only in ``maxIter``."""
    groups: dict[tuple, list[int]] = {}
    for i, p in points.items():
        groups.setdefault(tuple((k, v) for k, v in sorted(p.items()) if algo != "gbt" or k != "maxIter"), []).append(i)
    return list(groups.values())


def fit_table(df: DataFrame, features: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The assembled features and ``columns``, stored in no more files than their rows need."""
    data = stored(assemble(df, features).select(FEATURES_COL, *columns), "search")
    files = max(1, math.ceil(data.count() / TASK_ROWS))
    return stored(data.coalesce(files), "search") if len(data.inputFiles()) > files else data


def search(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold_col: str, stages: Sequence[dict[str, list]],
           ledger_path: str, algo: str = "gbt", parallelism: int | None = None, fit=None) -> DataFrame:
    """The ledger of a search in which each stage keeps the best point of the one before it.

    ``val_loss`` is the mean over folds of the root mean squared error of all targets together. The best point of
    a stage has the least loss, then the least signature. ``parallelism`` is the number of fits side by side, else
    as many as their tasks fill cores (8 to 32). ``fit`` may replace the fit of each point (tests).
    """
    spark = df.sparkSession
    schema = ledger_schema(stages)
    data = fit_table(df, features, [*targets, fold_col])
    rows = {r[0]: r[1] for r in data.groupBy(fold_col).count().collect()}
    folds = sorted(rows)
    parallelism = parallelism or min(32, max(8, spark.sparkContext.defaultParallelism // data.rdd.getNumPartitions()))

    def errors_of(group: list[dict], target: str, fold) -> list[tuple[float, int]]:
        if fit:
            return [fit(data, algo, p, target, fold_col, fold) for p in group]
        return fold_errors(data, algo, group, target, fold_col, fold, rows[fold])

    best: dict = {}
    for number, grid in enumerate(stages, start=1):
        stage = f"stage{number}"
        points = [{**best, **dict(zip(grid, values))} for values in itertools.product(*grid.values())]
        ledger = read_trials(spark, ledger_path, schema)
        todo = remaining(spark, points, ledger, stage, schema)
        errors: dict[int, dict] = {points.index(p): {} for p in todo}
        groups = [[i] for i in errors] if fit else shared_fits({i: points[i] for i in errors}, algo)
        with ThreadPoolExecutor(parallelism) as pool:
            jobs = {pool.submit(inheritable_thread_target(spark)(errors_of), [points[i] for i in g], t, f): (g, t, f)
                    for g in groups for f in folds for t in targets}
            try:
                for job in as_completed(jobs):
                    g, t, f = jobs[job]
                    for i, error in zip(g, job.result()):
                        errors[i][t, f] = error
                        if len(errors[i]) == len(folds) * len(targets):
                            parts = [[errors[i][t, f] for t in targets] for f in folds]
                            loss = sum(math.sqrt(sum(e for e, _ in p) / max(sum(n for _, n in p), 1)) for p in parts) / len(folds)
                            append_trials(spark.createDataFrame([_row(points[i], schema, val_loss=loss, stage=stage, status="completed", trial_id=100 * number + i)], schema), ledger_path)
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise
        keys = sorted(points[0])
        done = completed_trials(read_trials(spark, ledger_path, schema).where(F.col("stage") == stage), keys)
        first = done.withColumn("signature", signature(done, keys)).orderBy("val_loss", "signature").first()
        best = min((p for p in points if all(first[k] == (v if isinstance(v, str) else float(v)) for k, v in p.items())), key=str)
    return read_trials(spark, ledger_path, schema)
