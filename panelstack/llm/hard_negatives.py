"""Hard negatives by an inverted multi-index (operator 12).

The vectors' two halves have a codebook each, fitted by k-means on a bounded sample; a row's cell is the pair of
its halves' nearest codewords. All rows are indexed, dealt evenly into blocks of about BLOCK_ROWS whatever their
values are, each sorted by cell and with its own radii: the greatest distance of a row from its codeword. For an
anchor a and a codeword c of radius r no row scores above a.c + |a| r in that half, so a cell is bounded by the
sum of two half scores. A heap over the two descending lists of half scores visits cells by that bound and stops
when no unseen cell can hold a better row: below the fifth positive, or below what every window still needs.

All anchors meet every block, streamed past it in one task; first for the nearest rows of their label, then,
with the windows these set, for rows of other labels. Results are exact: the bounds only save work.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, ship, sorted_groups

BLOCK_ROWS = 8192
CODEWORDS = 16
SAMPLE_ROWS = 16_384
ROUNDS = 12
#: Rows scored at once; cells are gathered until they have as many.
BATCH_ROWS = 512
#: Components are cut there, so that scores fit 64 bits.
LARGEST = (1 << 26) - 1
NO_ID = np.iinfo(np.int64).max


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """At most k codewords of the rows by k-means from evenly spaced distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        for c in range(len(centres)):
            if (mine := near == c).any():
                centres[c] = x[mine].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


class Block:
    """One block of the index: rows by cell."""

    def __init__(self, ids, labels, vectors, centres):
        dim = vectors.shape[1]
        self.half = len(centres[0][0])
        exact = np.abs(vectors).max(initial=0).astype(float) ** 2 * max(dim, 1) < 2.0**52
        x = vectors.astype(np.float64)
        halves = x[:, : self.half], x[:, self.half :]
        words = [nearest(h, c) if h.shape[1] else np.zeros(len(h), int) for h, c in zip(halves, centres)]
        far = [np.sqrt(((h - c[w]) ** 2).sum(1)) for h, c, w in zip(halves, centres, words)]
        self.centres = centres
        self.radii = []
        for c, w, d in zip(centres, words, far):
            r = np.full(len(c), -1.0)  # no rows
            np.maximum.at(r, w, d)
            self.radii.append(r)
        n = len(centres[1])
        cell = words[0] * n + words[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.vectors = ids[order], labels[order], (x if exact else vectors.astype(np.int64))[order]
        self.first = np.searchsorted(cell[order], np.arange(len(centres[0]) * n + 1)).tolist()

    def visits(self, anchor: np.ndarray):
        """(bound, first row, end) of every cell with rows, by descending bound of its scores."""
        anchor = anchor.astype(float)
        lists = []
        for c, r, a in zip(self.centres, self.radii, (anchor[: self.half], anchor[self.half :])):
            score = c @ a + math.sqrt(a @ a) * r
            score += 1e-9 * (np.abs(c) @ np.abs(a) + np.abs(score)) + 1e-6  # above any error of rounding
            held = np.flatnonzero(r >= 0)
            held = held[np.argsort(-score[held], kind="stable")]
            lists.append((held.tolist(), score[held].tolist()))
        (one, up), (two, down) = lists
        if not one:
            return
        n, first = len(self.centres[1]), self.first
        heap = [(-(up[0] + down[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(up[i] + down[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(up[i + 1] + down[0]), i + 1, 0))
            cell = one[i] * n + two[j]
            if first[cell] < first[cell + 1]:
                yield -bound, first[cell], first[cell + 1]

    def batches(self, anchor: np.ndarray, needed):
        """(rows, scores) in cells by descending bound until no bound reaches ``needed()``."""
        rows, count, most = [], 0, BATCH_ROWS // 4
        vector = anchor.astype(self.vectors.dtype)

        def scored():
            at = np.concatenate(rows)
            return at, (self.vectors[at] @ vector).astype(np.int64)

        for bound, begin, end in self.visits(anchor):
            if bound < needed():
                break
            rows.append(np.arange(begin, end))
            count += end - begin
            if count >= most:
                yield scored()
                rows, count, most = [], 0, BATCH_ROWS
        if rows:
            yield scored()


def best(scores: np.ndarray, ids: np.ndarray, many: int):
    """The first ``many`` by descending score, then id."""
    if len(scores) > 8 * many:
        keep = scores >= -np.partition(-scores, many - 1)[many - 1]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:many]
    return scores[order], ids[order]


def positives(block: Block, anchor: np.ndarray, name: int, label: int, many: int):
    """The block's first ``many`` other rows of the anchor's label."""
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, s in block.batches(anchor, lambda: scores[-1] if len(scores) == many else -math.inf):
        fits = (block.labels[at] == label) & (block.ids[at] != name)
        if len(scores) == many:
            fits &= s >= scores[-1]
        if fits.any():
            scores, ids = best(np.append(scores, s[fits]), np.append(ids, block.ids[at[fits]]), many)
    return scores, ids


def negatives(block: Block, anchor: np.ndarray, name: int, label: int, tops: list[int], low: int, high: int, many: int):
    """For every window the block's first ``many`` rows of other labels: low * top <= 100 * score <= high * top."""
    floors, ceilings = [-(-low * t // 100) for t in tops], [high * t // 100 for t in tops]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
    need = [f if f <= c else math.inf for f, c in zip(floors, ceilings)]
    for at, s in block.batches(anchor, lambda: min(need)):
        fits = (block.labels[at] != label) & (block.ids[at] != name) & (s >= min(need))
        if not fits.any():
            continue
        s, ids = s[fits], block.ids[at[fits]]
        for i, (f, c) in enumerate(zip(floors, ceilings)):
            mine = (s >= need[i]) & (s <= c)
            if mine.any():
                found[i] = best(np.append(found[i][0], s[mine]), np.append(found[i][1], ids[mine]), many)
                if len(found[i][0]) == many:
                    need[i] = found[i][0][-1]
    return found


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim)


def _packed(dim: int):
    """vec_id, label and the components, filled up with zeros to ``dim``, as bytes."""

    def run(batches):
        for b in batches:
            lists = b.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(lists), dim), "<i4")
            x[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(lists), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("vec_id", "label", "asks", "block")] + [data], names=["vec_id", "label", "asks", "block", "data"])

    return run


def _blocks(batches):
    """One row a block: its ids, labels and vectors as bytes."""
    for group in sorted_groups(batches, ["block"]):
        group = group.combine_chunks()
        ids = group.column("vec_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes()
        labels = group.column("label").to_numpy().astype("<i8").tobytes()
        data = b"".join(group.column("data").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([ids], pa.binary()), pa.array([labels], pa.binary()), pa.array([data], pa.binary())], names=["block", "ids", "labels", "data"])


def _search(centres, dim: int, work, names: list[str], types: list[pa.DataType]):
    """``work`` on every anchor against the block that comes before it in the stream."""

    def run(batches):
        block = None
        for b in batches:
            out = [[] for _ in names]
            columns = [b.column(c).to_pylist() for c in ("ids", "labels", "data", "nth", "vec_id", "label", "tops")]
            for ids, labels, data, nth, name, label, tops in zip(*columns):
                if ids is not None:
                    block = Block(np.frombuffer(ids, "<i8").astype(np.int64), np.frombuffer(labels, "<i8").astype(np.int64), np.frombuffer(data, "<i4").reshape(-1, dim), centres)
                    continue
                for row in work(block, np.frombuffer(data, "<i4"), nth, name, label, tops):
                    for o, x in zip(out, row):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)

    return run


def mine(rows: DataFrame, asks: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which ``asks`` holds.

    Rows with a null label or vector, or a null or non-finite component, take no part. A component x counts as
    floor(256 x), cut at 2^26 - 1 either way; a shorter vector as filled up with zeros. Scores are inner products,
    higher ones first, ties by id, nulls last. An anchor's positives are its first ``n_positives`` rows of its label
    and another id; for each, the first ``n_negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score are ranked from 1. Repeated rows count each, as anchors too; a row of
    the anchor's id is never its own positive or negative. Anchors without an id or partners give no rows, other
    columns are not read. Codebooks are fitted on the SAMPLE_ROWS rows of least id hash; every row is indexed.
    """
    spark = rows.sparkSession
    ship(spark)
    floats = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), floats.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    valid = valid.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    valid = valid.select("vec_id", "label", "asks", F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(float(LARGEST))), F.lit(float(-LARGEST))))).alias("vector"))
    total, dim = valid.agg(F.count("*"), F.max(F.size("vector"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim = max(dim or 0, 1)
    if not total:
        return spark.createDataFrame([], result)
    sample = [r.vector for r in valid.select("vector", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vector").collect()]
    x = np.array([np.pad(np.array(v, np.float64), (0, dim - len(v))) for v in sample])
    half = (dim + 1) // 2
    centres = codebook(x[:, :half], CODEWORDS), codebook(x[:, half:], CODEWORDS) if dim > half else np.zeros((1, 0))

    n_blocks = -(-total // BLOCK_ROWS)
    dealt = valid.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    index = saved(dealt.mapInArrow(_packed(dim), "vec_id long, label long, asks boolean, block int, data binary"), "vectors")
    blocks = saved(index.drop("asks").repartition(2 * n_blocks, "block").sortWithinPartitions("block").mapInArrow(_blocks, "block int, ids binary, labels binary, data binary"), "vector-blocks")
    anchors = saved(index.where("asks and vec_id is not null").select(F.monotonically_increasing_id().alias("nth"), "vec_id", "label", "data"), "anchors")

    def against_all(asked: DataFrame, work, schema: str, types: list[pa.DataType]) -> DataFrame:
        lone = blocks.select("block", "ids", "labels", "data", *(F.lit(None).cast(t).alias(c) for c, t in (("nth", "long"), ("vec_id", "long"), ("label", "long"), ("tops", "array<long>"))))
        everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("labels"), "data", "nth", "vec_id", "label", "tops")
        met = lone.unionByName(everywhere).repartition(2 * n_blocks, "block").sortWithinPartitions("block", F.col("nth").asc_nulls_first())
        return met.mapInArrow(_search(centres, dim, work, [c.split()[0] for c in schema.split(", ")], types), schema)

    def first_positives(block, anchor, nth, name, label, tops):
        scores, ids = positives(block, anchor, name, label, n_positives)
        return ((nth, s, i) for s, i in zip(scores.tolist(), ids.tolist()))

    near = against_all(anchors.withColumn("tops", F.lit(None).cast("array<long>")), first_positives, "nth long, score long, id long", [pa.int64()] * 3)
    order = Window.partitionBy("nth").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    chosen = saved(near.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("tops")), "positives")  # n_positives each

    def window_negatives(block, anchor, nth, name, label, tops):
        found = negatives(block, anchor, name, label, tops, low, high, n_negatives)
        return ((nth, place, s, i) for place, (scores, ids) in enumerate(found) for s, i in zip(scores.tolist(), ids.tolist()))

    asked = anchors.join(chosen.select("nth", F.col("tops.score").alias("tops")), "nth")
    hard = against_all(asked, window_negatives, "nth long, place int, score long, id long", [pa.int64(), pa.int32(), pa.int64(), pa.int64()])
    order = Window.partitionBy("nth", "place").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    known = lambda c: F.when(c != int(NO_ID), c)
    named = anchors.select("nth", F.col("vec_id").alias("anchor_id")).join(chosen, "nth")
    top = F.get("tops", F.col("place"))
    return hard.join(named, "nth").select("anchor_id", known(top["id"]).alias("positive_id"), F.col("rank").cast("int").alias("rank"), known(F.col("id")).alias("negative_id"),
                                          top["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled() -> Column:
    """The label of ``embeddings``; of rows whose vec_id is divisible by 7, (label + 1) % 10."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


#: DuckDB text of ``mine`` over embeddings: all scores.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
      FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5"""
