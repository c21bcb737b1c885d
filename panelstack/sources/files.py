"""File sources and sinks: raw wide CSVs, dimensions, versioned data sets,
cached panels, prediction tables, the trials ledger and metric tables.

All readers go through ``spark.read`` (so they work on any Hadoop-compatible
shared file system) and all writers through ``DataFrame.write``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    # all columns as text: numbers are coerced later with try_cast
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_raw_wide(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Load N wide CSV tables and concatenate them (columns may differ).

    Fails with FileNotFoundError when one of them is missing.
    """
    frames = []
    for p in paths:
        try:
            frames.append(_read_csv(spark, p))
        except AnalysisException as e:
            raise FileNotFoundError(f"raw file not found: {p}") from e
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_raw_wide(df: DataFrame, root: str, split_col: str, parts: Sequence[str]) -> list[str]:
    """Write one CSV table per value of ``split_col`` (like one file per region set); ``df`` is built once."""
    df = stored(df, "raw-wide")
    paths = []
    for v in parts:
        p = f"{root}/{v}"
        df.where(F.col(split_col) == v).drop(split_col).write.mode("overwrite") \
          .option("header", True).csv(p)
        paths.append(p)
    return paths


def read_dimension(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All-text lookup CSV with trimmed header names; error when missing, empty or incomplete."""
    try:
        df = _read_csv(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(f"metadata file not found: {path}") from e
    df = df.toDF(*[c.strip() for c in df.columns])
    missing = set(required) - set(df.columns)
    if missing:
        raise KeyError(f"metadata {path} missing columns: {sorted(missing)}")
    if df.limit(1).count() == 0:
        raise ValueError(f"metadata file is empty: {path}")
    return df


def version_label(prefix: str, min_count: int, ratio: float, tags: Sequence[str] = (),
                  include_date: bool = True, today: date | None = None) -> str:
    parts = [prefix, f"min{min_count}", f"comp{ratio:.1f}", *tags]
    if include_date:
        parts.append((today or date.today()).strftime("%Y-%m-%d"))
    return "-".join(parts)


_VERSIONS_SCHEMA = "name string, at timestamp, id string"


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """(name, seq): every registered name once, numbered from 1 by its first registration.

    The numbers follow from the list when it is read, so two names never share one, however many writers there
    were. The list has a row a version, so one window ranks it.
    """
    try:
        listed = spark.read.schema(_VERSIONS_SCHEMA).json(f"{root}/_versions")
    except AnalysisException:
        listed = spark.createDataFrame([], _VERSIONS_SCHEMA)
    first = listed.groupBy("name").agg(F.min(F.struct("at", "id")).alias("_f"))
    return first.select("name", F.row_number().over(Window.orderBy("_f", "name")).cast("long").alias("seq"))


def register_version(spark: SparkSession, root: str, name: str) -> bool:
    """Append ``name`` to the version list unless present; keeps creation order.

    Writers only append: of two that register one name at once the earlier row counts.
    """
    if read_versions(spark, root).where(F.col("name") == name).limit(1).count():
        return False
    row = spark.createDataFrame([(name, datetime.now(timezone.utc), uuid.uuid4().hex)], _VERSIONS_SCHEMA)
    row.coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/_versions")
    return True


def write_dataset(spark: SparkSession, root: str, label: str, data: DataFrame,
                  analysis: dict[str, DataFrame] | None = None,
                  manifest: dict | None = None) -> str:
    """Write a versioned data set: data, analysis tables, a JSON manifest; register it."""
    vdir = f"{root}/{label}"
    data.write.mode("overwrite").parquet(f"{vdir}/processed_series")
    for name, df in (analysis or {}).items():
        df.write.mode("overwrite").parquet(f"{vdir}/{name}")
    if manifest is not None:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string") \
             .write.mode("overwrite").text(f"{vdir}/manifest")
    register_version(spark, root, label)
    return vdir


def read_processed(spark: SparkSession, root: str, version: str | None,
                   default: str | None = None) -> DataFrame:
    """Resolve a versioned data set (or the default); list the last 10 versions on error."""
    name = version or default
    try:
        return spark.read.parquet(f"{root}/{name}/processed_series")
    except AnalysisException as e:
        last = [r["name"] for r in read_versions(spark, root).orderBy(F.desc("seq")).limit(10).collect()]
        raise FileNotFoundError(f"processed data set {name!r} not found under {root}; "
                                f"available versions (last 10): {last[::-1]}") from e


def cache_panel(df: DataFrame, path: str) -> None:
    """Persist the expensive reshaped panel for later phases (a shared parquet table)."""
    df.write.mode("overwrite").parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, run_id: str,
                      keys: Sequence[str] = ("model", "scenario", "region", "year")) -> None:
    """One parquet table of truth and predictions keyed by (run, series, time)."""
    df.select(F.lit(run_id).alias("run_id"), *df.columns).repartition("run_id", *keys) \
      .write.mode("append").partitionBy("run_id").parquet(path)


def load_predictions(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    # partition pruning on run_id
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


TRIALS_SCHEMA = T.StructType([
    T.StructField("hidden_size", T.LongType()),
    T.StructField("lstm_layers", T.LongType()),
    T.StructField("dropout", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("best_epoch", T.LongType()),
    T.StructField("trial_id", T.LongType()),
    T.StructField("signature", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()),
])


def append_trials(df: DataFrame, path: str) -> None:
    """Append rows to the JSON-lines ledger (never rewrites earlier rows)."""
    df.write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str, schema: T.StructType = TRIALS_SCHEMA) -> DataFrame:
    """Read the ledger with a fixed schema; malformed lines are skipped."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_metrics(df: DataFrame, path: str) -> None:
    """Per-run metric table as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
