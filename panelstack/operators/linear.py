"""Least squares of several targets on several features in closed form.

One aggregate sums the products of all pairs of columns (constant, features, targets): the Gram matrix, whose
size follows from the number of columns alone. The normal equations are then solved by expressions on that row,
in the space of correlations, for all targets at once. Sums of disjoint row sets add up, so the fits of k folds
(all rows but the fold's own) and their one-step errors come from the k sums of a single scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollout import rollout_linear_by

#: A column whose variance, or whose rest after the columns before it, is smaller relative to its own counts as
#: constant or dependent and gets the coefficient 0.
TOLERANCE = 1e-9
INTERCEPT = "(intercept)"


def _at(size: int, i: int, j: int) -> int:
    i, j = min(i, j), max(i, j)
    return i * size - i * (i - 1) // 2 + j - i


def gram(df: DataFrame, features: Sequence[str], targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``_g``: the upper triangle of sums of products of (1, features, targets), over rows without nulls."""
    cols = [*features, *targets]
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in cols)]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.dropna(subset=cols).groupBy(*by).agg(F.array(*sums).alias("_g")).where(F.get("_g", F.lit(0)) > 0)


def solve(sums: DataFrame, features: Sequence[str], targets: Sequence[str], ridge: Column | float = 0.0) -> DataFrame:
    """``sums`` with ``_b``, the coefficients of each target as an array (intercept, features...).

    ``ridge`` is added to the diagonal of the features' correlation matrix. Gauss-Jordan elimination runs over the
    columns in order; a constant or dependent column is left out with the coefficient 0.
    """
    p, t = len(features), len(targets)
    size = 1 + p + t
    g = lambda i, j: F.get("_g", F.lit(_at(size, i, j)))
    n = g(0, 0)
    every = range(1, size)
    keep = sums.columns
    around = sums.select(*keep, F.array(*[g(0, i) / n for i in every]).alias("_m"),
                         F.array(*[g(i, j) - g(0, i) * g(0, j) / n for i in every for j in range(i, size)]).alias("_s"))
    s = lambda i, j: F.get("_s", F.lit(_at(size - 1, i - 1, j - 1)))
    widths = around.withColumn("_d", F.array(*[F.when(s(i, i) > TOLERANCE * 1e-3 * g(i, i), F.sqrt(s(i, i))).otherwise(0.0) for i in every]))
    d = lambda i: F.get("_d", F.lit(i - 1))
    r = lambda i, j: F.when((d(i) > 0) & (d(j) > 0), s(i, j) / (d(i) * d(j))).otherwise(0.0)
    penalty = ridge if isinstance(ridge, Column) else F.lit(float(ridge))
    cell = lambda i, j: F.when(d(i) > 0, 1.0 + penalty).otherwise(0.0) if i == j else r(i, j)
    system = widths.withColumn("_a", F.array(*[F.array(*[cell(i, j) for j in every]) for i in range(1, p + 1)]))

    def step(a: Column, k: Column) -> Column:
        row = F.get(a, k)
        pivot = F.get(row, k)
        cleared = lambda other: F.zip_with(other, row, lambda x, y: x - F.get(other, k) * (y / pivot))
        done = F.transform(a, lambda other, i: F.when(i == k, F.transform(row, lambda x: x / pivot)).otherwise(cleared(other)))
        skipped = F.transform(a, lambda other, i: F.when(i == k, F.transform(row, lambda x: F.lit(0.0))).otherwise(other))
        return F.when(pivot > TOLERANCE, done).otherwise(skipped)

    done = system.withColumn("_r", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.col("_a"), step))
    slope = lambda i, k: F.when(d(i) > 0, F.get(F.get("_r", F.lit(i - 1)), F.lit(p + k)) * d(1 + p + k) / d(i)).otherwise(0.0)
    slopes = done.withColumn("_w", F.array(*[F.array(*[slope(i, k) for i in range(1, p + 1)]) for k in range(t)]))

    def whole(k: int) -> Column:
        w = F.get("_w", F.lit(k))
        share = F.aggregate(F.zip_with(w, F.slice("_m", 1, p), lambda b, m: b * m), F.lit(0.0), lambda x, y: x + y)
        return F.concat(F.array(F.get("_m", F.lit(p + k)) - share), w)

    return slopes.select(*keep, F.array(*[whole(k) for k in range(t)]).alias("_b"))


def coefficients(solved: DataFrame, features: Sequence[str], targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, target, feature, coefficient in rows; the constant is feature '(intercept)'."""
    cells = [F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.get(F.get("_b", F.lit(k)), F.lit(i)).alias("coefficient"))
             for k, t in enumerate(targets) for i, f in enumerate([INTERCEPT, *features])]
    return solved.select(*by, F.inline(F.array(*cells)))


def fit_linear(train: DataFrame, features: Sequence[str], targets: Sequence[str], by: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Least squares of every target on all features, for each value of ``by``: one aggregate, one solve."""
    return coefficients(solve(gram(train, features, targets, by), features, targets, ridge), features, targets, by)


def _squared_errors(features: Sequence[str], targets: Sequence[str]) -> Column:
    """Sum of the squared one-step errors of ``_b`` over the rows of ``_held`` and all targets: w' G w."""
    p, size = len(features), 1 + len(features) + len(targets)
    total = F.lit(0.0)
    for k in range(len(targets)):
        w = [-F.get(F.get("_b", F.lit(k)), F.lit(i)) for i in range(p + 1)] + [F.lit(1.0)]
        at = [*range(p + 1), 1 + p + k]
        for x in range(p + 2):
            for y in range(x, p + 2):
                term = w[x] * w[y] * F.get("_held", F.lit(_at(size, at[x], at[y])))
                total = total + (term if x == y else 2.0 * term)
    return total


def held_out(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str, train: str | None = None) -> DataFrame:
    """(fold, _g of the rows to fit on, _held of the rows to score) from one scan.

    Without ``train`` every fold is held out in turn and fitted on all others. With it, ``fold`` names the split:
    rows of that value are fitted on and each other value is held out.
    """
    sums = gram(df, features, targets, [fold])
    all_ = sums.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(fold).alias("fold"), "_g"))).alias("_all"))  # a row a fold
    if train is not None:
        used = F.get(F.filter("_all", lambda x: x["fold"] == train), F.lit(0))["_g"]
        return all_.select(used.alias("_g"), F.explode(F.filter("_all", lambda x: x["fold"] != train)).alias("_x")).select(F.col("_x.fold").alias(fold), "_g", F.col("_x._g").alias("_held"))
    none = F.transform(F.get("_all", F.lit(0))["_g"], lambda x: F.lit(0.0))
    total = F.aggregate("_all", none, lambda a, x: F.zip_with(a, x["_g"], lambda u, v: u + v))
    each = all_.select(total.alias("_total"), F.explode("_all").alias("_x"))
    return each.select(F.col("_x.fold").alias(fold), F.zip_with("_total", "_x._g", lambda u, v: u - v).alias("_g"), F.col("_x._g").alias("_held")).where(F.get("_g", F.lit(0)) > 0)


def cross_validate_linear(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str, ridges: Sequence[float] = (0.0,), train: str | None = None,
                          recursive: bool = False, keys: Sequence[str] = (), step: str = "step", lag_cols: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(ridge, fold, rows, rmse): the error of each fold's fit on its held-out rows, all targets together.

    One scan fits and scores all folds and ridges one step ahead. With ``recursive`` every held-out series is
    rolled out with its own fold's coefficients, which join the series as data, and those predictions are scored.
    ``train`` takes a given split in place of folds (see ``held_out``). Rows with a null feature or target are not
    fitted on; scored are complete pairs.
    """
    parts = held_out(df, features, targets, fold, train).withColumn("ridge", F.explode(F.array(*[F.lit(float(r)) for r in ridges])))
    fits = solve(parts, features, targets, F.col("ridge"))
    if not recursive:
        rows = F.get("_held", F.lit(0))
        return fits.select("ridge", fold, rows.cast("long").alias("rows"), F.sqrt(F.greatest(_squared_errors(features, targets), F.lit(0.0)) / (rows * len(targets))).alias("rmse"))
    series = df if train is None else df.where(F.col(fold) != train)
    preds = rollout_linear_by(series, [*keys, fold], step, targets, features, fits.select(fold, "ridge", "_b"), fold, lag_cols or {}, carry=["ridge"])
    pairs = series.select(*keys, step, *[F.col(t).cast("double").alias(t) for t in targets]).join(preds, [*keys, step])
    both = pairs.select("ridge", fold, F.inline(F.array(*[F.struct(F.col(t).alias("y"), F.col(f"pred_{t}").alias("p")) for t in targets]))).where("y is not null and p is not null")
    return both.groupBy("ridge", fold).agg(F.floor(F.count("*") / len(targets)).cast("long").alias("rows"), F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("rmse"))


def mean_rmse(scores: DataFrame) -> DataFrame:
    """(ridge, folds, mean_rmse): the mean over folds of their errors."""
    return scores.groupBy("ridge").agg(F.count("*").alias("folds"), F.avg("rmse").alias("mean_rmse"))
