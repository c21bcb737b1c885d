"""Spark session and shared-storage helpers.

Everything in the library is lazy DataFrame code; the session only carries
the knobs that matter at scale (AQE, skew handling, UTC, no UI).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "panelstack") -> SparkSession:
    """Return the active session, or build one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:  # else Spark's own setting, which AQE coalesces
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # e.g. a Spark Connect session has no local context
        return None


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local-mode
    session without that setting (tests, a laptop) gets a private folder,
    and it is registered as the checkpoint folder so later calls agree.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="panelstack-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # core confs may be read-only at runtime; the context keeps it
            pass
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable (reuses ``shared_dir`` policy)."""
    sc = _context(spark)
    if sc is None or sc.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        sc.setCheckpointDir(root)
    else:
        shared_dir(spark, "init")


#: Rows up to which a counted table of small rows is broadcast.
BROADCAST_ROWS = 10_000


def checked_broadcast(df):
    """Write the table once, count it, and hint a broadcast only if it has few rows; AQE decides beyond that."""
    from pyspark.sql import functions as F

    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def materialize(df):
    """Cut the lineage of a DataFrame that several later passes read.

    ``checkpoint`` writes it to the shared checkpoint folder (reliable: it
    survives the loss of executors, unlike a local checkpoint or a cache).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, purpose: str = "stored"):
    """Write the table once as Parquet in the shared folder and read it back.

    Like ``materialize`` it cuts the lineage and outlives lost executors; later passes read only their columns
    and counts come from the footers, but partitioning and order are not kept. The files go when the session ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
