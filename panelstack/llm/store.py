"""Shared storage and sorted-group streams for the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelstack.session import shared_dir

#: A table is broadcast only when counted and found to have at most this many rows of a few bytes.
BROADCAST_ROWS = 1_000_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a session, so that tasks can import them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="panelstack-code-")), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in [root / "__init__.py", root / "session.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and outlives lost executors.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", codec).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal integer ``keys`` in a stream sorted by them; nulls are not allowed in keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        part = pa.Table.from_batches([batch])
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(part.slice(start, cut - start))
            if cut < batch.num_rows or (cut == 0 and held):
                if held:
                    yield pa.concat_tables(held)
                held = []
            start = cut
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of each key, sorted by ``order``; groups must be small enough for a task."""

    def run(batches):
        for group in sorted_groups(batches, keys):
            out = work(group)
            if out is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
