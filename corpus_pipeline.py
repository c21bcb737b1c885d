"""The corpus pipeline: five stages from ``documents`` to token ids, each built on one operator of panelstack.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again for the next one. All stages but the last return the columns of
``docs``. Rows are told apart by ``row_key`` where ids may be missing or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstack.llm import line_templates, phrase_index, piece_codec, toxicity
from panelstack.llm.jaccard_join import jaccard_components
from panelstack.llm.queries import LINE_TEXTS, PIECE_MODEL
from panelstack.llm.store import BROADCAST_ROWS, saved, ship, table

KEY = "__row_key"


def row_key():
    """A hash of id and text: rows alike in both are treated alike."""
    return F.xxhash64("doc_id", "text")


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of these keys; the keys are broadcast if counted and few."""
    gone = _fresh(docs, "__gone")
    keys = saved(keys.select(F.col(KEY).alias(gone)).distinct(), "pipeline-removed")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return docs.join(small, row_key() == F.col(gone), "left_anti")


def _one_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one row, the first by its other columns (nulls first), of those with each of these keys."""
    again, nth = _fresh(docs, "__again"), _fresh(docs, "__nth")
    keys = saved(keys.select(F.col(KEY).alias(again)).distinct(), "pipeline-repeated")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    several = docs.join(small, row_key() == F.col(again))
    order = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    first = several.withColumn(nth, F.row_number().over(Window.partitionBy(again).orderBy(*order))).where(F.col(nth) == 1)
    return docs.join(small, row_key() == F.col(again), "left_anti").unionByName(first.select(*(f"`{c}`" for c in docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches 0.7 go; the model learns from the labels of rows that aren't held out.
    Texts without words score the base rate and stay."""
    ship(spark)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.train(toxicity.sample(labelled, table(spark, sf_dir, "labels"), toxicity.Training(), ~toxicity.held_out()), toxicity.Training())
    scored = toxicity.score(docs.withColumn(KEY, row_key()), model, id_col=KEY)
    return _without(docs, scored.where("predicted = 1").select(F.col("doc_id").alias(KEY)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates leave the texts, and n_chars follows; every document stays."""
    ship(spark)
    edited = line_templates.drop_recurring_lines(docs, min_texts=LINE_TEXTS)
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return edited.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles one stays: the
    smallest id (nulls last), of several rows of that id the one of least key. Texts without words (null, empty,
    white space) link with nothing and all stay. Rows that repeat an id and a worded text give one row, the first
    by its other columns."""
    ship(spark)
    keyed = docs.withColumn(KEY, row_key())
    linked = saved(jaccard_components(keyed, words=5, percent=80, carry=KEY, root="component").where("n_shingles > 0"), "pipeline-near")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("stays"))
    others = linked.join(first, "component").where(F.col(KEY) != F.col("stays"))
    repeated = linked.groupBy(KEY).agg(F.count("*").alias("many")).where("many > 1")
    return _one_each(_without(docs, others), repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (all its words, if it has fewer) go."""
    ship(spark)
    found = phrase_index.contamination(docs.withColumn(KEY, row_key()), table(spark, sf_dir, "benchmark"), window=10, id_col=KEY)
    return _without(docs, found.where(F.size("spans") > 0).select(F.col("doc_id").alias(KEY)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with begin and end), n_tokens and decodes: whether the ids decode to the whole text again."""
    import public_tokenizers

    ship(spark)
    return piece_codec.encode_checked(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The stages have no SQL form; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
