"""One registered query for each operator of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hard_negatives, license_scan, line_templates
from .conversation_repair import damaged, repair
from .jaccard_join import jaccard_components
from .paragraph_dedup import repeated_passages
from .phrase_index import contamination, digests
from .piece_codec import round_trip
from .quality_rules import quality
from .store import table
from .token_files import document_tokens
from .toxicity import toxicity
from .url_rules import judge

#: The vocabulary of operator 4, a file name of the public_tokenizers package.
PIECE_MODEL = "piece_bpe_32k.model"

#: Different texts, and neighbourhoods, in which a line template must stand to be dropped.
LINE_TEXTS = 20

#: The vocabulary of operator 2 and its free id that ends documents.
RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_DOCUMENT)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digests(line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"), min_texts=LINE_TEXTS))


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


SQL["op9_license_scans"] = license_scan.sql()


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", hard_negatives.relabelled())
    return hard_negatives.mine(rows, asks=F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = hard_negatives.SQL


@query
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")).drop("kept")


SQL["op13_document_fingerprints"] = fingerprints.sql()
