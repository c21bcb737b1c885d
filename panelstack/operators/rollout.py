"""Recursive forecasts.

A rollout predicts a series step by step; from the second step on, the lag
features are the model's own earlier predictions (when that earlier step is
inside the forecast window), otherwise the given lag values.

* Linear models: the whole recursion is one higher-order ``aggregate`` over
  the time-ordered rows of a series (bounded by the time axis, not by the
  data size) - one shuffle by series, no Python.
* Any MLlib model: a step-synchronous loop - one batch ``transform`` per step
  for all series at once, lags joined from the previous steps' predictions,
  each step's predictions checkpointed (reliable) before the next step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _lag_spec(lag_cols: dict[str, tuple[str, int]]):
    return {c: (t, k) for c, (t, k) in lag_cols.items()}


def rollout_linear(df: DataFrame, keys: Sequence[str], step: str, targets: Sequence[str],
                   coefficients: Sequence[tuple[str, str, float]],
                   lag_cols: dict[str, tuple[str, int]],
                   rescale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Recursive forecast of a linear model per target.

    ``coefficients``: (target, feature, coefficient) rows, feature
    '(intercept)' for the constant.  ``lag_cols`` maps a lag column to
    (target, k): the column holds target's value k steps back.  ``rescale`` maps a lag
    column to (factor, shift): a prediction p, in the target's space, enters the lag
    as p * factor + shift, in the lag's own space.  Returns keys, step and
    ``pred_<target>`` in the target's space.
    """
    feats = sorted({f for _, f, _ in coefficients if f != "(intercept)"})
    grouped = df.groupBy(*keys).agg(_ordered(step, feats).alias("_rows"))
    coef = {(t, f): c for t, f, c in coefficients}
    folded = _recursion(list(targets), _lag_spec(lag_cols), rescale or {}, _linear(feats, lambda t, f: coef.get((t, f))))
    return _points(grouped, keys, step, targets, folded)


def rollout_linear_by(df: DataFrame, keys: Sequence[str], step: str, targets: Sequence[str], features: Sequence[str],
                      fits: DataFrame, by: str, lag_cols: dict[str, tuple[str, int]], carry: Sequence[str] = ()) -> DataFrame:
    """``rollout_linear`` with a model for each value of ``by``, one of ``keys``.

    ``fits`` holds ``by``, the ``carry`` columns and ``_b``: for each target an array of the intercept and the
    coefficients of ``features`` in order. Every series is rolled out with all fits of its value (a table as long
    as the folds and parameters, so it is broadcast). Returns keys, ``carry``, step and ``pred_<target>``.
    """
    targets, features = list(targets), list(features)
    grouped = df.groupBy(*keys).agg(_ordered(step, features).alias("_rows"))
    grouped = grouped.join(F.broadcast(fits.select(by, *carry, "_b")), by)
    place = {f: i for i, f in enumerate(["(intercept)", *features])}
    number = lambda t, f: F.get(F.get("_b", F.lit(targets.index(t))), F.lit(place[f]))
    folded = _recursion(targets, _lag_spec(lag_cols), {}, _linear(features, number))
    return _points(grouped, [*keys, *carry], step, targets, folded)


def _ordered(step: str, feats: Sequence[str]):
    """The rows of a series in time order."""
    return F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), *[F.col(f).cast("double").alias(f) for f in feats])))


def _points(grouped: DataFrame, keys: Sequence[str], step: str, targets: Sequence[str], folded) -> DataFrame:
    out = grouped.select(*keys, F.explode(folded).alias("_p"))
    return out.select(*keys, F.col("_p.s").alias(step), *[F.col(f"_p.{t}").alias(f"pred_{t}") for t in targets])


def _linear(feats: Sequence[str], number):
    """The predictor of a linear model; ``number(target, feature)`` is a coefficient, a number or a column."""

    def predict(t, feature):
        first = number(t, "(intercept)")
        e = F.lit(0.0 if first is None else first)
        for f in feats:
            c = number(t, f)
            if not isinstance(c, (int, float, type(None))) or c:
                e = e + F.lit(c) * feature(f)
        return e

    return predict


def _recursion(targets: list[str], lag_cols: dict, rescale: dict, predict):
    """The predictions of ``_rows`` as one fold; ``predict(target, feature)`` is a column of ``feature(name)``."""
    max_k = max([k for _, k in lag_cols.values()] + [1])
    hist_type = "array<double>"
    init = F.struct(F.lit(0).alias("k"),
                    *[F.array().cast(hist_type).alias(f"h_{t}") for t in targets],
                    F.array().cast("array<struct<s:bigint," + ",".join(f"{t}:double" for t in targets) + ">>")
                    .alias("out"))

    def merge(acc, r):
        k = acc["k"]

        def feature(f):
            if f in lag_cols:
                t, lag = lag_cols[f]
                # own prediction from `lag` steps back when inside the window
                own = F.element_at(acc[f"h_{t}"], lag)
                if f in rescale:
                    factor, shift = rescale[f]
                    own = own * F.lit(factor) + F.lit(shift)
                return F.when(k >= lag, own).otherwise(r[f])
            return r[f]

        preds = {t: predict(t, feature) for t in targets}
        hist = [F.slice(F.concat(F.array(preds[t]), acc[f"h_{t}"]), 1, max_k).alias(f"h_{t}")
                for t in targets]
        point = F.struct(r["s"].cast("long").alias("s"), *[preds[t].alias(t) for t in targets])
        return F.struct((k + 1).alias("k"), *hist, F.concat(acc["out"], F.array(point)).alias("out"))

    return F.aggregate("_rows", init, merge)["out"]


def rollout_stepwise(df: DataFrame, keys: Sequence[str], step: str, targets: Sequence[str],
                     predict_fn, lag_cols: dict[str, tuple[str, int]]) -> DataFrame:
    """Recursive forecast with any batch predictor, one step of all series at a time.

    ``predict_fn(rows)`` returns rows with ``pred_<target>`` added.  The loop
    length is the longest series (bounded by the time axis); every step's
    predictions are checkpointed, so no step recomputes earlier ones.
    """
    lag_cols = _lag_spec(lag_cols)
    w = Window.partitionBy(*keys).orderBy(step)
    base = df.withColumn("_k", F.row_number().over(w) - 1)
    base = materialize(base)
    n_steps = base.agg(F.max("_k")).collect()[0][0]
    if n_steps is None:
        return df.sparkSession.createDataFrame([], df.select(*keys, step).schema)
    per_step: list[DataFrame] = []
    for k in range(n_steps + 1):
        rows = base.where(F.col("_k") == k)
        by_lag: dict[int, list] = {}
        for col, (t, lag) in lag_cols.items():
            if lag <= k:
                by_lag.setdefault(lag, []).append((col, t))
        # one join per lag distance brings that step's predictions of every target
        for lag, cols in by_lag.items():
            prev = per_step[k - lag].select(*keys, *[F.col(f"pred_{t}").alias(f"_lag_{c}") for c, t in cols])
            rows = rows.join(prev, list(keys), "left")
            rows = rows.select(*[F.coalesce(F.col(f"_lag_{c}"), F.col(c)).alias(c) if c in dict(cols)
                                 else F.col(c) for c in rows.columns if not c.startswith("_lag_")])
        pred = predict_fn(rows).select(*keys, step, *[f"pred_{t}" for t in targets])
        # each step's predictions feed the next steps: write them once
        per_step.append(materialize(pred))
    done = per_step[0]
    for p in per_step[1:]:
        done = done.unionByName(p)
    return done


def result_table(rows: DataFrame, preds: DataFrame, keys: Sequence[str], step: str,
                 targets: Sequence[str], carry: Sequence[str] = ("year",)) -> DataFrame:
    """Keys + carried columns + ``pred_<target>`` by (series, step)."""
    r = rows.select(*keys, step, *carry)
    return r.join(preds.select(*keys, step, *[f"pred_{t}" for t in targets]), list(keys) + [step], "inner")
