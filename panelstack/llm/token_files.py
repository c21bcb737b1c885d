"""Token counts of flat token files by a separator scan (operator 2).

A flat file is one stream of 16-bit token ids in which every document ends with the end-of-document id; nothing
else tells where documents lie. The stream is stored in blocks of fixed size that cut documents anywhere. Every
block is searched for the id with one vector comparison; a prefix scan over the blocks of a file (a sum of
tokens and ends, the place of the last end so far) then gives each block what is open at its beginning, which
stitches the documents that cross blocks.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

BLOCK_TOKENS = 1 << 16
FILE = "file int, block long, data binary, ordinal long, doc_id long"
_encodings: dict = {}


def _encoding(shared):
    """One encoder a worker."""
    import tiktoken

    if shared.id not in _encodings:
        _encodings[shared.id] = tiktoken.Encoding("flat", **shared.value)
    return _encodings[shared.id]


class _Shared:
    """A broadcast with an id that lasts over tasks."""

    def __init__(self, broadcast, key):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def write_files(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(files, contents): the flat files' blocks (file, block, data), and (file, ordinal, doc_id) of their documents.

    A partition becomes a file. Every row is a document, null and empty texts documents without tokens. The
    vocabulary is read on the driver and broadcast; its size bounds it.
    """
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(max(ranks.values()), end_id) >= 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    shared = _Shared(docs.sparkSession.sparkContext.broadcast({"pat_str": pattern, "mergeable_ranks": ranks, "special_tokens": {}}), ranks_path)

    def run(batches):
        encoding, file = _encoding(shared), TaskContext.get().partitionId()
        open_, size, block, ordinal = [], 0, 0, 0

        def rows(blocks):
            k = len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([file] * k, pa.int32()), pa.array(range(block, block + k), pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["file", "block", "data", "ordinal", "doc_id"])

        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], names=["file", "block", "data", "ordinal", "doc_id"])
            ordinal += n
            for text in batch.column(1):
                open_.append(np.array([*encoding.encode_ordinary(text.as_py() or ""), end_id], "<u2"))
                size += len(open_[-1])
                if size >= block_tokens:
                    stream = np.concatenate(open_)
                    whole = size // block_tokens * block_tokens
                    yield rows(stream[:whole].reshape(-1, block_tokens))
                    block += whole // block_tokens
                    open_, size = [stream[whole:]], size - whole
        if size:
            yield rows([np.concatenate(open_)])

    stored = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FILE), "token-files")
    return stored.where("block is not null").select("file", "block", "data"), stored.where("block is null").select("file", "ordinal", "doc_id")


def count_tokens(files: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the blocks of flat files.

    start is the document's first place in its file; the end id is not counted. Tokens after a file's last end
    id are a last, unended document. Documents without tokens count. Blocks may have any sizes; empty ones,
    empty files and a null block change nothing, and a block given twice is a fault of the input.
    """

    def run(batches):
        for batch in batches:
            tokens, ends = [], []
            for data in batch.column("data"):
                stream = np.frombuffer(data.as_py() or b"", "<u2")
                tokens.append(len(stream))
                ends.append(np.flatnonzero(stream == end_id))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"])

    blocks = files.mapInArrow(run, "file int, block long, tokens long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    placed = blocks.select("file", "block", "tokens", base.alias("base"), F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("ordinal"), "ends")
    placed = placed.withColumn("last", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    placed = placed.withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))  # start of the document open here
    at = placed.select("file", "ordinal", "base", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    ended = at.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"))
    whole = placed.groupBy("file").agg(F.sum("tokens").alias("size"), F.sum(F.size("ends")).alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = whole.where("size > start").select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"))
    return ended.unionByName(rest)


def document_tokens(docs: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, counted in the flat files written from them."""
    files, contents = write_files(docs, ranks_path, pattern, end_id)
    return contents.join(count_tokens(files, end_id), ["file", "ordinal"]).select("doc_id", "n_tokens")
