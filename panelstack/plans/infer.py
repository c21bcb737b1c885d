"""K9: training a run, storing its artefacts as tables, and counterfactual forecasts of one region from them.

A run is kept as four tables partitioned by run id: vocabularies (column, value, code), scaler (column, mean,
scale), features (position, feature, lag of which target, how far back) and coefficients (target, feature,
coefficient). ``load_run`` checks that they belong together before anything is computed with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counterfactual as Kf
from ..operators import encode as E
from ..operators import features as D
from ..operators import linear as L
from ..operators import model as G
from ..operators import rollout as R

TABLES = ("vocabularies", "scaler", "features", "coefficients")


@dataclass(frozen=True)
class Run:
    """A run's artefacts. The scaler and the coefficients are as long as the features are many."""

    vocabularies: DataFrame                          # column, value, code
    categoricals: tuple                              # columns with a vocabulary
    scaler: dict                                     # column -> (mean, scale)
    features: tuple                                  # in the order of the fit
    lags: dict                                       # lag feature -> (target, steps back)
    coefficients: tuple                              # (target, feature, coefficient), in scaled space

    @property
    def targets(self) -> tuple:
        return tuple(dict.fromkeys(t for t, _, _ in self.coefficients))

    def vocabulary(self, column: str) -> DataFrame:
        return self.vocabularies.where(F.col("column") == column).select("value", "code")


def encoded(df: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """``<column>_code`` of every categorical, -1 for values the run did not see."""
    for c, vocabulary in vocabularies.items():
        df = E.encode_learned(df, c, vocabulary, f"{c}_code")
    return df


def scaled(df: DataFrame, scaler: dict, features: Sequence[str], targets: Sequence[str] = ()) -> DataFrame:
    """Columns in scaled space; a missing feature counts as its mean."""
    at = lambda c: (F.col(c).cast("double") - F.lit(scaler[c][0])) / F.lit(scaler[c][1])
    return df.withColumns({**{c: F.coalesce(at(c), F.lit(0.0)) for c in features}, **{c: at(c) for c in targets}})


def train_run(panel: DataFrame, root: str, run_id: str, keys: Sequence[str], targets: Sequence[str], inputs: Sequence[str],
              categoricals: Sequence[str], n_lags: int = 1, time: str = "year") -> None:
    """Lags, vocabularies, scaler and a closed-form fit of all targets, stored as the tables of a run."""
    spark = panel.sparkSession
    rows = D.require_history(D.add_lags(panel, targets, n_lags, keys, time), n_lags, keys, time)
    vocabularies = {c: E.learn_vocab(rows, c) for c in categoricals}
    rows = encoded(rows, vocabularies)
    lags = [(D.lag_name(t, k), t, k) for k in range(1, n_lags + 1) for t in targets]
    features = [n for n, _, _ in lags] + list(inputs) + [f"{c}_code" for c in categoricals]
    stats = E.fit_scaler(rows, [*features, *targets]).first()  # one row
    scaler = {c: (float(stats[f"{c}_mean"] or 0.0), float(stats[f"{c}_scale"] or 1.0)) for c in [*features, *targets]}
    fit = L.fit_linear(scaled(rows, scaler, features, targets), features, targets)
    words = None
    for c, v in vocabularies.items():
        v = v.select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), F.col("code").cast("int").alias("code"))
        words = v if words is None else words.unionByName(v)
    tables = {"vocabularies": words if words is not None else spark.createDataFrame([], "column string, value string, code int"),
              "scaler": spark.createDataFrame([(c, *x) for c, x in scaler.items()], "column string, mean double, scale double"),
              "features": spark.createDataFrame([(i, f, *next(((t, k) for n, t, k in lags if n == f), (None, None))) for i, f in enumerate(features)], "position int, feature string, target string, back int"),
              "coefficients": fit}
    for name in TABLES:
        tables[name].withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/{name}")


def load_run(spark: SparkSession, root: str, run_id: str) -> Run:
    """The artefacts of one run; ValueError if a table is missing or they do not belong together."""
    tables = {}
    for name in TABLES:
        try:
            tables[name] = spark.read.parquet(f"{root}/{name}").where(F.col("run_id") == run_id).drop("run_id")
        except AnalysisException as e:
            raise ValueError(f"run {run_id!r}: no table {name} under {root}") from e
    named = tables["features"].orderBy("position").collect()
    features = tuple(r.feature for r in named)
    scaler = {r["column"]: (r["mean"], r["scale"]) for r in tables["scaler"].collect()}
    coefficients = tuple((r.target, r.feature, r.coefficient) for r in tables["coefficients"].orderBy("target", "feature").collect())
    categoricals = tuple(sorted(r["column"] for r in tables["vocabularies"].select("column").distinct().collect()))
    targets = {t for t, _, _ in coefficients}
    problems = []
    if not features or [r.position for r in named] != list(range(len(named))):
        problems.append("features are missing or not numbered in order")
    if missing := ({*features, *targets} - set(scaler)):
        problems.append(f"no scaler for {sorted(missing)}")
    for t in sorted(targets) or [None]:
        if {f for u, f, _ in coefficients if u == t} != {L.INTERCEPT, *features} or len([1 for u, _, _ in coefficients if u == t]) != len(features) + 1:
            problems.append(f"coefficients of {t} do not match the features")
    if unknown := {f[: -len("_code")] for f in features if f.endswith("_code")} ^ set(categoricals):
        problems.append(f"vocabularies and features disagree on {sorted(unknown)}")
    if wrong := {r.target for r in named if r.target is not None} - targets:
        problems.append(f"lags of targets without a model: {sorted(wrong)}")
    if problems:
        raise ValueError(f"run {run_id!r}: " + "; ".join(problems))
    return Run(tables["vocabularies"], categoricals, scaler, features, {r.feature: (r.target, r.back) for r in named if r.target is not None}, coefficients)


def forecast(rows: DataFrame, run: Run, keys: Sequence[str], step: str = "year") -> DataFrame:
    """keys, step and ``pred_<target>`` in raw units of rows that have the run's lags, inputs and categoricals.

    Encoded by the run's vocabularies, scaled, rolled out with the predictions entering the lags' own spaces,
    and scaled back.
    """
    made = scaled(encoded(rows, {c: run.vocabulary(c) for c in run.categoricals}), run.scaler, run.features)
    s = run.scaler
    enter = {p: (s[t][1] / s[p][1], (s[t][0] - s[p][0]) / s[p][1]) for p, (t, _) in run.lags.items()}
    preds = R.rollout_linear(made, list(keys), step, list(run.targets), run.coefficients, run.lags, enter)
    return preds.select(*keys, step, *[(F.col(f"pred_{t}") * s[t][1] + s[t][0]).alias(f"pred_{t}") for t in run.targets])


def infer_region(panel: DataFrame, run: Run, region: str, keys: Sequence[str], model_cols: Sequence[str], names: Sequence[str] = (),
                 categories: Sequence[str] = (), min_rows: int = 200, time: str = "year") -> DataFrame:
    """Forecasts for every representative model and requested scenario of one region, seen there or not."""
    scenarios = Kf.resolve_scenarios(panel, region, names, categories)[0]
    template = Kf.template_model(panel, region, scenarios).first()["model"]  # one row
    reps = Kf.representatives(panel, min_rows)
    lookup = Kf.feature_lookup(panel, reps, model_cols, region)
    made = Kf.synthesise(panel, region, scenarios, template, reps, lookup, model_cols, run.targets)
    n = max([k for _, k in run.lags.values()] + [0])
    rows = D.require_history(D.add_lags(made, run.targets, n, keys, time), n, keys, time)
    return forecast(rows, run, keys, time)


def scaled_rollout(train: DataFrame, rows: DataFrame, step: str, lags: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Scale targets and lags by their own training means and deviations, fit, roll out and scale back.

    A prediction leaves the target's scaled space and enters the lag's at every step. Returns keys, step and
    ``pred_<target>`` in raw units.
    """
    cols = [*lags.values(), *lags]
    stats = train.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    m = {c: stats[f"{c}_m"] for c in cols}
    s = {c: stats[f"{c}_s"] or 1.0 for c in cols}
    scale = {c: ((F.col(c) - m[c]) / s[c]) for c in cols}
    fit = G.fit_one_feature(train.withColumns(scale), {t: p for p, t in lags.items()})
    coefs = []
    for r in fit.collect():  # one row per target
        coefs += [(r["target"], "(intercept)", r["intercept"]), (r["target"], r["feature"], r["slope"])]
    enter = {p: (s[t] / s[p], (m[t] - m[p]) / s[p]) for p, t in lags.items()}
    preds = R.rollout_linear(rows.withColumns(scale), list(keys), step, list(lags.values()), coefs, {p: (t, 1) for p, t in lags.items()}, enter)
    return preds.select(*keys, step, *[(F.col(f"pred_{t}") * s[t] + m[t]).alias(f"pred_{t}") for t in lags.values()])
