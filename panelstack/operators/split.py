"""Seeded, exact splits by whole series, without a single-partition sort.

Series are ordered by ``md5(seed | keys)`` (then keys).  The exact global
rank is computed in a distributed way: the first three hex digits of the
hash form 4096 ordered buckets; bucket sizes (4096 rows at most) give each
bucket's offset, and a ``row_number`` inside each bucket adds the local
rank.  md5 spreads distinct keys evenly, so no bucket is hot.  Only the
distinct series keys are ranked, then joined back to the rows; NULL keys
are series like others and match in that join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .stats import null_safe_join


def seeded_hash(keys: Sequence[str], seed) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def rank_groups(df: DataFrame, keys: Sequence[str], seed=0) -> DataFrame:
    """Distinct ``keys`` with ``rank`` (0-based, by seeded hash then keys) and ``n`` (group count)."""
    keys = list(keys)
    g = df.select(*keys).distinct().withColumn("_h", seeded_hash(keys, seed)) \
          .withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = g.groupBy("_b").agg(F.count("*").alias("_c"))
    # 4096 rows at most: the running sum over buckets is tiny
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"),
                           F.sum("_c").over(Window.partitionBy()).alias("n"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys))
    return g.join(F.broadcast(offsets), "_b") \
            .select(*keys, (F.col("_off") + local - 1).cast("long").alias("rank"), "n")


def split_by_series(df: DataFrame, keys: Sequence[str], test_size: float = 0.1,
                    val_size: float = 0.1, seed=0, out: str = "split") -> DataFrame:
    """Whole series to train / val / test; ``int(n * size)`` series for val and test.

    Order after the seeded shuffle: train first, then val, then test.
    """
    df = stored(df, "series")  # read twice: keys, then rows
    r = rank_groups(df, keys, seed)
    n = F.col("n")
    n_test = F.floor(n * F.lit(test_size))
    n_val = F.floor(n * F.lit(val_size))
    n_train = n - n_test - n_val
    label = (F.when(F.col("rank") < n_train, F.lit("train"))
              .when(F.col("rank") < n_train + n_val, F.lit("val"))
              .otherwise(F.lit("test")))
    return null_safe_join(df, r.select(*keys, label.alias(out)), list(keys))


def group_kfold(df: DataFrame, keys: Sequence[str], k: int, seed=42, out: str = "fold") -> DataFrame:
    """Every series in exactly one fold; the first ``n % k`` folds get one extra series."""
    df = stored(df, "series")  # read twice: keys, then rows
    r = rank_groups(df, keys, seed)
    n_groups = r.select("n").limit(1).collect()
    if not n_groups or n_groups[0][0] < k:
        raise ValueError(f"number of unique groups must be at least {k}")
    n, rank = F.col("n"), F.col("rank")
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(rank < big, F.floor(rank / (q + 1))) \
            .otherwise(rem + F.floor((rank - big) / q))
    return null_safe_join(df, r.select(*keys, fold.cast("int").alias(out)), list(keys))


def holdout_series(df: DataFrame, keys: Sequence[str], frac: float = 0.1, seed=0,
                   out: str = "holdout") -> DataFrame:
    """Flag ``round(frac * n)`` series (half to even) as the monitoring subset."""
    df = stored(df, "series")  # read twice: keys, then rows
    r = rank_groups(df, keys, seed)
    m = F.bround(F.col("n") * F.lit(frac), 0)
    return null_safe_join(df, r.select(*keys, (F.col("rank") < m).alias(out)), list(keys))


def sample_groups(df: DataFrame, keys: Sequence[str], max_groups: int, seed=0) -> DataFrame:
    """At most ``max_groups`` whole groups: the distinct keys kept, with totals."""
    r = rank_groups(df, keys, seed)
    return r.where(F.col("rank") < max_groups).select(
        *keys, F.col("n").alias("total_groups"),
        F.least(F.col("n"), F.lit(max_groups)).cast("long").alias("used_groups"))


def union_splits(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
