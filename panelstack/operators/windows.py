"""Sequence samples, encoder/decoder windows and horizon tables.

Every operator here is a bounded window over one series (partitioned by the
series key, ordered by time) or an equi-join on (series, step).  A sample
never holds more than ``L`` or ``enc + max_dec`` rows, so no step collects
an unbounded group, and nothing pairs all rows of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, time):
    return Window.partitionBy(*keys).orderBy(time)


def _frame_list(c: str, frame) -> Column:
    # collect_list drops NULLs; wrapping each value in an array keeps positions
    return F.flatten(F.collect_list(F.array(F.col(c))).over(frame))


def sequences(df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str],
              time: str, length: int, offset: int = 0, mask_value: float = -1.0) -> DataFrame:
    """Sliding samples of ``length`` rows per series, target ``offset`` rows after the end.

    One output row per sample: keys, ``start`` (0-based row of the first
    element), ``x_<f>`` arrays, ``hist_<t>`` arrays (previous targets for
    teacher forcing), ``mask`` (row has no feature equal to ``mask_value``)
    and the target values ``y_<t>``.  Series too short are skipped.
    """
    w = _w(keys, time)
    frame = w.rowsBetween(-(length - 1), 0)
    rn = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    valid = None
    for f in features:
        e = F.coalesce(F.col(f) != F.lit(mask_value), F.lit(True))
        valid = e if valid is None else valid & e
    base = df.select("*", rn.alias("_rn"), n.alias("_n"),
                     (valid if valid is not None else F.lit(True)).alias("_valid"))
    cols = [*[F.col(k) for k in keys],
            (F.col("_rn") - length).cast("long").alias("start"),
            *[_frame_list(f, frame).alias(f"x_{f}") for f in features],
            *[_frame_list(t, frame).alias(f"hist_{t}") for t in targets],
            F.flatten(F.collect_list(F.array("_valid")).over(frame)).alias("mask"),
            *[F.lead(t, offset).over(w).alias(f"y_{t}") if offset else F.col(t).alias(f"y_{t}")
              for t in targets],
            F.col("_rn"), F.col("_n")]
    out = base.select(*cols)
    return out.where((F.col("_rn") >= length) & (F.col("_rn") + offset <= F.col("_n"))) \
              .drop("_rn", "_n")


def align_sequence_preds(rows: DataFrame, preds: DataFrame, keys: Sequence[str], time: str,
                         length: int, offset: int, pred_cols: Sequence[str]) -> DataFrame:
    """Put each sample's prediction on its target row (start + length - 1 + offset); NULL elsewhere."""
    w = _w(keys, time)
    r = rows.withColumn("_pos", (F.row_number().over(w) - 1).cast("long"))
    p = preds.select(*keys, (F.col("start") + (length - 1 + offset)).alias("_pos"), *pred_cols)
    return r.join(p, list(keys) + ["_pos"], "left").drop("_pos")


def encoder_decoder_windows(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                            enc: int = 3, max_dec: int = 12, min_dec: int = 1,
                            mode: str = "all") -> DataFrame:
    """Samples of ``enc`` history rows plus up to ``max_dec`` future rows, as long rows.

    Output: keys, ``sample`` (0-based row of the first decoder step),
    ``rel`` (row offset from it: negative = encoder), time and ``cols``.
    ``mode='all'`` keeps every start with a full encoder, ``'last'`` keeps
    the one whose decoder ends at the series' last row.  Each row lands in at
    most ``enc + max_dec`` samples (a bounded explode, no shuffle).
    """
    w = _w(keys, time)
    base = df.select(*keys, time, *cols, (F.row_number().over(w) - 1).alias("_j"),
                     F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    j, n = F.col("_j"), F.col("_n")
    if mode == "last":
        first = n - F.least(F.lit(max_dec), n - enc)
        out = base.where((n - enc >= min_dec) & (j >= first - enc)) \
                  .select("*", first.alias("_i"))
    else:
        cand = F.explode(F.sequence(j - (max_dec - 1), j + enc)).alias("_i")
        out = base.select("*", cand)
        i = F.col("_i")
        dec = F.least(F.lit(max_dec), n - i)
        out = out.where((i >= enc) & (i < n) & (dec >= min_dec) & (j <= i + dec - 1))
    return out.select(*keys, F.col("_i").cast("long").alias("sample"),
                      (F.col("_j") - F.col("_i")).cast("int").alias("rel"), time, *cols)


def early_window(df: DataFrame, keys: Sequence[str], width: int, step: str = "step") -> DataFrame:
    """First ``width`` distinct steps of series that have at least ``width`` steps."""
    dr = F.dense_rank().over(Window.partitionBy(*keys).orderBy(step))
    tmp = df.withColumn("_dr", dr)
    tmp = tmp.withColumn("_nd", F.max("_dr").over(Window.partitionBy(*keys)))
    return tmp.where((F.col("_dr") <= width) & (F.col("_nd") >= width)).drop("_dr", "_nd")


def late_window(df: DataFrame, keys: Sequence[str], width: int, step: str = "step") -> DataFrame:
    """Last ``width`` steps ending at the series' last step, only when contiguous."""
    part = Window.partitionBy(*keys)
    tmp = df.withColumn("_m", F.max(step).over(part)).where(F.col(step) > F.col("_m") - width)
    tmp = tmp.withColumn("_c", F.count(F.lit(1)).over(part))
    return tmp.where(F.col("_c") == width).drop("_m", "_c")


def min_length(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Series with at least ``width`` rows."""
    return df.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys))) \
             .where(F.col("_c") >= width).drop("_c")


def expand_horizon(samples: DataFrame, keys: Sequence[str], base: str,
                   arrays: dict[str, str]) -> DataFrame:
    """One row per horizon step from array predictions: step = base + position."""
    names = list(arrays)
    zipped = F.arrays_zip(*[F.col(arrays[n]).alias(n) for n in names])
    out = samples.select(*keys, base, F.posexplode(zipped).alias("_pos", "_z"))
    return out.select(*keys, (F.col(base) + F.col("_pos")).cast("long").alias("step"),
                      *[F.col(f"_z.{n}").alias(n) for n in names])


def attach_truth(horizon: DataFrame, test: DataFrame, keys: Sequence[str],
                 cols: Sequence[str], step: str = "step") -> DataFrame:
    """Left join horizon rows to test rows deduplicated on (series, step) (first by time)."""
    k = list(keys) + [step]
    first = F.min(F.struct(*[F.col(c) for c in cols])).alias("_t")
    dedup = test.groupBy(*k).agg(first).select(*k, *[F.col(f"_t.{c}").alias(c) for c in cols])
    return horizon.join(dedup, k, "left")


def warm_start_filter(horizon: DataFrame, offset: int, step: str = "step") -> DataFrame:
    """Drop horizon rows whose step is below the warm-start offset."""
    return horizon.where(F.col(step) >= offset)


def warm_start_report(horizon: DataFrame, offset: int, step: str = "step") -> DataFrame:
    """One row: horizon rows and how many the warm-start filter drops."""
    return horizon.agg(F.count("*").alias("horizon_rows"),
                       F.sum((F.col(step) < offset).cast("long")).alias("dropped_rows"))


def blend_windows(early: DataFrame, late: DataFrame, keys: Sequence[str], preds: Sequence[str],
                  step: str = "step", carry: Sequence[str] = ()) -> DataFrame:
    """Combine early- and late-window predictions per (series, step).

    Where both exist, the early weight falls linearly from 1 at the first
    overlapping step to 0 at the last (0.5 each for a single overlapping
    step); elsewhere whichever exists is kept.  One full outer join plus
    per-series min/max over the overlapping steps only.
    """
    k = list(keys) + [step]
    e = early.select(*k, *carry, *[F.col(p).alias(f"_e_{p}") for p in preds], F.lit(True).alias("_in_e"))
    l_ = late.select(*k, *[F.col(c).alias(f"_l_{c}") for c in carry],
                     *[F.col(p).alias(f"_l_{p}") for p in preds], F.lit(True).alias("_in_l"))
    j = e.join(l_, k, "full")
    both = F.coalesce(F.col("_in_e"), F.lit(False)) & F.coalesce(F.col("_in_l"), F.lit(False))
    part = Window.partitionBy(*keys)
    j = j.select("*", F.min(F.when(both, F.col(step))).over(part).alias("_omin"),
                 F.max(F.when(both, F.col(step))).over(part).alias("_omax"),
                 F.count(F.when(both, 1)).over(part).alias("_on"), both.alias("_both"))
    we = F.when(F.col("_on") > 1, F.lit(1.0) - (F.col(step) - F.col("_omin"))
                / (F.col("_omax") - F.col("_omin"))).otherwise(F.lit(0.5))
    out = [*[F.col(c) for c in k],
           *[F.coalesce(F.col(c), F.col(f"_l_{c}")).alias(c) for c in carry]]
    for p in preds:
        out.append(F.when(F.col("_both"), we * F.col(f"_e_{p}") + (F.lit(1.0) - we) * F.col(f"_l_{p}"))
                    .when(F.col("_in_e"), F.col(f"_e_{p}"))
                    .otherwise(F.col(f"_l_{p}")).alias(p))
    return j.select(*out)


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows plus fallback rows of series absent from the primary (left-anti + union)."""
    missing = fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(missing.select(*primary.columns))


def coverage_report(horizon: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: horizon rows, covered series, all series, dropped series."""
    covered = horizon.select(*keys).distinct()
    all_s = test.select(*keys).distinct()
    dropped = all_s.exceptAll(covered)
    rows = horizon.agg(F.count("*").alias("horizon_rows"))
    c = covered.agg(F.count("*").alias("covered_series"))
    a = all_s.agg(F.count("*").alias("all_series"))
    d = dropped.agg(F.count("*").alias("dropped_series"))
    # four single-row aggregates side by side
    return rows.crossJoin(c).crossJoin(a).crossJoin(d)


def first_dropped(horizon: DataFrame, test: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The first ``k`` dropped series in key order (a top-k, not a full sort)."""
    dropped = test.select(*keys).distinct().exceptAll(horizon.select(*keys).distinct())
    return dropped.orderBy(*keys).limit(k)
