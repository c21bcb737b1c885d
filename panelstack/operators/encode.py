"""Categorical encoding and numeric scaling.

Vocabularies are tables of distinct category values (bounded by the
category's cardinality, not by the row count), built with ``distinct`` and
applied with a join.  Scaler statistics are one row (two numbers per
column) and are attached with a one-row broadcast, never a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

NA_TOKEN = "__NA__"


def ordered_codes(values: DataFrame, col: str = "value", out: str = "code") -> DataFrame:
    """0-based position of each distinct value in sorted order, without one partition.

    Range partitioning sorts the values across partitions; per-partition
    sizes (one row per partition) give offsets and a ``row_number`` inside
    each partition adds the local position.  The partitioned values are
    checkpointed first so both passes see the same partitions.
    """
    r = materialize(values.select(col).repartitionByRange(col)
                          .withColumn("_pid", F.spark_partition_id()))
    sizes = r.groupBy("_pid").agg(F.count("*").alias("_c"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_c").over(w_off), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(col))
    return r.join(F.broadcast(offsets), "_pid") \
            .select(col, (F.col("_off") + local - 1).cast("int").alias(out))


def encode_fixed(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None,
                 broadcast_vocab: bool = False) -> DataFrame:
    """Ordered vocabulary (value, code) -> code; unknown -> -1.

    Only a literal list is to be hinted (``broadcast_vocab``); any other is left
    to Spark, which broadcasts it if its size allows.
    """
    out = out or f"{col}_code"
    v = vocab.select(F.col(vocab.columns[0]).alias("_val"), F.col(vocab.columns[1]).cast("int").alias("_code"))
    v = F.broadcast(v) if broadcast_vocab else v
    return df.join(v, df[col] == F.col("_val"), "left") \
             .select(*df.columns, F.coalesce(F.col("_code"), F.lit(-1)).alias(out))


def learn_vocab(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values -> 0-based code (value, code).

    The ranking is distributed (``ordered_codes``).
    """
    d = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return ordered_codes(d)


def encode_learned(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Apply a learned vocabulary (unknown values -> -1)."""
    return encode_fixed(df, col, vocab, out, broadcast_vocab=False)


def decode(df: DataFrame, code_col: str, vocab: DataFrame, out: str,
           broadcast_vocab: bool = False) -> DataFrame:
    """code -> label (NULL for unknown codes)."""
    v = vocab.select(F.col(vocab.columns[0]).alias(out), F.col(vocab.columns[1]).cast("int").alias("_code"))
    v = F.broadcast(v) if broadcast_vocab else v
    return df.join(v, df[code_col] == F.col("_code"), "left").drop("_code")


def union_vocab(frames: Sequence[DataFrame], col: str) -> DataFrame:
    """Closed vocabulary over several splits; NULL -> '__NA__'; sorted (value, code)."""
    vals = None
    for f in frames:
        v = f.select(F.coalesce(F.col(col).cast("string"), F.lit(NA_TOKEN)).alias("value"))
        vals = v if vals is None else vals.unionByName(v)
    return ordered_codes(vals.distinct())


def drop_unseen(df: DataFrame, col: str, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose value is in the vocabulary, distinct unseen values)."""
    v = vocab.select(F.col(vocab.columns[0]).alias(col))
    kept = df.join(v, col, "left_semi")
    unseen = df.select(col).distinct().join(v, col, "left_anti")
    return kept, unseen


def one_hot(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
            categories: dict[str, list] | None = None) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """Dummy columns from the training values plus a NULL dummy (``<col>_nan``).

    Other splits get the same columns; unseen values are all zeros.  The
    category lists become column names, so they are read on the driver
    (bounded by the category cardinality) unless given.
    """
    categories = dict(categories or {})
    for c in cols:
        if c not in categories:
            categories[c] = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull())
                                   .distinct().collect())

    def enc(df):
        extra = []
        for c in cols:
            for v in categories[c]:
                # equality is NULL for a NULL input: coalesce to 0
                extra.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
                             .alias(f"{c}_{v}"))
            extra.append(F.col(c).isNull().cast("double").alias(f"{c}_nan"))
        return df.select(*[x for x in df.columns if x not in cols], *extra)

    names = []
    for c in cols:
        names += [f"{c}_{v}" for v in categories[c]] + [f"{c}_nan"]
    tr = enc(train)
    return tr, [enc(o) for o in others], names


def one_hot_sparse(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], out: str = "indicators") -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Indicators of ``one_hot`` as a sparse vector column, for any number of categories.

    ``out`` is a struct (size, indices, values) in place of ``cols``: ascending places of the ones. The training
    values of a column take the places after those of the columns before it, in order, and its NULL dummy the
    next; unseen values have no place. Vocabularies stay tables (joined, broadcast by Spark if small enough) and
    only their sizes, one row, go along. Returns train, the others and the places as a table (place, column,
    value; value NULL for the NULL dummy).
    """
    cols = list(cols)
    vocabularies = {c: materialize(learn_vocab(train, c)) for c in cols}
    sizes, places = None, None
    for c, v in vocabularies.items():
        one = v.agg(F.count("*").cast("int").alias(f"_n_{c}"))
        sizes = one if sizes is None else sizes.crossJoin(F.broadcast(one))
    before = {c: sum((F.col(f"_n_{d}") + 1 for d in cols[:i]), F.lit(0)) for i, c in enumerate(cols)}
    total = sum((F.col(f"_n_{c}") + 1 for c in cols), F.lit(0))

    def enc(df):
        kept = [c for c in df.columns if c not in cols]
        for c in cols:
            df = encode_learned(df, c, vocabularies[c], f"_code_{c}")
        df = df.crossJoin(F.broadcast(sizes))
        place = [F.when(F.col(c).isNull(), before[c] + F.col(f"_n_{c}")).when(F.col(f"_code_{c}") >= 0, before[c] + F.col(f"_code_{c}")) for c in cols]
        at = F.array_compact(F.array(*[p.cast("int") for p in place]))
        return df.select(*kept, F.struct(total.cast("int").alias("size"), at.alias("indices"), F.transform(at, lambda _: F.lit(1.0)).alias("values")).alias(out))

    for c, v in vocabularies.items():
        named = v.crossJoin(F.broadcast(sizes)).select((before[c] + F.col("code")).cast("int").alias("place"), F.lit(c).alias("column"), F.col("value").cast("string").alias("value"))
        named = named.unionByName(sizes.select((before[c] + F.col(f"_n_{c}")).cast("int").alias("place"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("value")))
        places = named if places is None else places.unionByName(named)
    return enc(train), [enc(o) for o in others], places


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_scale`` (population std, NULLs ignored, 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}_scale"))
    return df.agg(*aggs)


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    # ``stats`` is the single row of fit_scaler: a one-row broadcast
    return df.crossJoin(F.broadcast(stats))


def scale(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / scale; NULL stays NULL."""
    j = _with_stats(df, stats)
    return j.select(*[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def unscale(df: DataFrame, stats: DataFrame, cols: Sequence[str],
            stat_cols: Sequence[str] | None = None) -> DataFrame:
    """x * scale + mean (``stat_cols`` names the fitted column for each of ``cols``)."""
    stat_cols = list(stat_cols) if stat_cols is not None else list(cols)
    m = dict(zip(cols, stat_cols))
    j = _with_stats(df, stats)
    return j.select(*[(F.col(c) * F.col(f"{m[c]}_scale") + F.col(f"{m[c]}_mean")).alias(c) if c in m
                      else F.col(c) for c in df.columns])


def encoder_normalise(df: DataFrame, target: str, keys: Sequence[str], time: str,
                      encoder_length: int, out: str | None = None) -> DataFrame:
    """Per-row centre/scale from the ``encoder_length`` rows before it in its series."""
    out = out or f"{target}_norm"
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-encoder_length, -1)
    centre = F.avg(target).over(w)
    sd = F.stddev_pop(target).over(w)
    scl = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.select("*", centre.alias(f"{out}_center"), scl.alias(f"{out}_scale")) \
             .withColumn(out, (F.col(target) - F.col(f"{out}_center")) / F.col(f"{out}_scale"))


def normalise_samples(samples: DataFrame, target: str, keys: Sequence[str], sample: str = "sample", rel: str = "rel",
                      out: str | None = None) -> DataFrame:
    """Centre and scale of each sample's encoder rows (``rel`` < 0), applied to all rows of the sample.

    A scale of 0 counts as 1; a sample is a few rows, so its window never outgrows a task.
    """
    out = out or f"{target}_norm"
    w = Window.partitionBy(*keys, sample)
    seen = F.when(F.col(rel) < 0, F.col(target))
    sd = F.stddev_pop(seen).over(w)
    return samples.select("*", F.avg(seen).over(w).alias(f"{out}_center"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{out}_scale")) \
                  .withColumn(out, (F.col(target) - F.col(f"{out}_center")) / F.col(f"{out}_scale"))


def group_key(df: DataFrame, keys: Sequence[str], out: str = "group") -> DataFrame:
    return df.withColumn(out, F.concat_ws("_", *keys))
