"""Positional inverted index over documents, with exact phrase and proximity search (operator 1).

The index is cut by documents into segments, rows of a stored table: the sorted distinct terms (64-bit hashes)
of the segment's documents, and for each the increasing positions at which it stands. A phrase is found in a
segment by taking the positions of its rarest term, less that term's offset, as possible starts, and keeping
those that the offset-adjusted lists of the next rarest terms hold too. All phrases of a block are intersected
together, as arrays. A document lies in one segment, so nothing is shuffled and no list outgrows a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import saved

#: Words of a segment; one longer document is a segment of its own.
SEGMENT_WORDS = 1_000_000
#: Test words searched at once; a larger test set is searched block by block.
BLOCK_WORDS = 2_000_000
SEGMENT = "doc_ids binary, has_id binary, starts binary, terms binary, lists binary, positions binary"
_PLACES = ["doc_ids", "has_id", "starts", "terms", "lists", "positions"]


def words_of(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words of each row): A-Z lower-cased, words of digits, a-z and non-ASCII."""
    raw, starts, ends, rows = T.find_words(data, at, T.LOWER, T.ALNUM)
    return T.word_hashes(raw, starts, ends), T.row_counts(rows, len(at) - 1)


def _segment(ids: list[np.ndarray], valid: list[np.ndarray], words: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
    hashes = np.concatenate(words)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
    positions = np.argsort(hashes, kind="stable").astype(np.uint32)
    terms, first = np.unique(hashes[positions], return_index=True)
    lists = np.append(first, len(hashes)).astype(np.uint32)
    return [np.concatenate(ids).tobytes(), np.concatenate(valid).tobytes(), starts.tobytes(), terms.tobytes(), lists.tobytes(), positions.tobytes()]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the postings of every word of every row; one row per segment. Null texts have no words."""

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _segment(*held)], names=_PLACES)

        for batch in batches:
            ids = batch.column(0)
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for first, n, data, at in T.chunks(batch.column(1)):
                words, counts = words_of(data, at)
                if held[0] and size + len(words) > SEGMENT_WORDS:
                    yield batch_of()
                    held, size = [[], [], [], []], 0
                for h, x in zip(held, (ids[first : first + n], valid[first : first + n], words, counts)):
                    h.append(x)
                size += len(words)
        if held[0]:
            yield batch_of()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return saved(docs.mapInArrow(run, SEGMENT).withColumn("segment", F.monotonically_increasing_id()), "phrase-index")


class Segment:
    def __init__(self, row: dict):
        self.ids, self.valid = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["has_id"], bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.terms, self.lists = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["lists"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index of each word's term, or -1."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1) if len(self.terms) else np.full(len(words), -1)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def postings_of(self, terms: np.ndarray):
        """(owner, position) of all postings of the given terms, owner being the place in ``terms``."""
        sizes = self.lists[terms + 1] - self.lists[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        first = np.cumsum(sizes) - sizes
        return owner, self.positions[np.repeat(self.lists[terms] - first, sizes) + np.arange(len(owner))].astype(np.int64)

    def lookup(self, terms: np.ndarray):
        """A sorted array of (rank of the term, position) keys, and the ranks by term."""
        own = np.unique(terms)
        owner, position = self.postings_of(own)
        return own, (owner << 32) | position


def phrases(segment: Segment, words: np.ndarray, first: np.ndarray, size: np.ndarray):
    """(phrase, start) of every exact occurrence; phrase i is words[first[i] : first[i] + size[i]]."""
    term = segment.find(words)
    least = np.minimum.reduceat(np.append(term, 0), np.column_stack([first, first + size]).ravel())[::2] if len(first) else first
    alive = np.flatnonzero((least >= 0) & (size > 0))
    none = np.zeros(0, np.int64)
    if not len(alive):
        return none, none
    longest = int(size[alive].max())
    place = np.arange(longest)
    inside = place[None, :] < size[alive, None]
    terms = np.where(inside, term[np.minimum(first[alive, None] + place, len(term) - 1)], 0)
    frequency = np.where(inside, segment.lists[terms + 1] - segment.lists[terms], np.iinfo(np.int64).max)
    by_rarity = np.argsort(frequency, axis=1, kind="stable")
    own, keys = segment.lookup(terms[inside])
    rarest = terms[np.arange(len(alive)), by_rarity[:, 0]]
    owner, position = segment.postings_of(rarest)
    start = position - by_rarity[owner, 0]
    doc = segment.doc_of(position)
    ok = (start >= segment.starts[doc]) & (start + size[alive[owner]] <= segment.starts[doc + 1])
    owner, start = owner[ok], start[ok]
    for step in range(1, longest):
        if not len(owner):
            break
        offset = by_rarity[owner, step]
        more = step < size[alive[owner]]
        want = (np.searchsorted(own, terms[owner, offset]) << 32) | (start + offset)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        keep = ~more | (keys[at] == want)
        owner, start = owner[keep], start[keep]
    return alive[owner], start


def near(segment: Segment, words: np.ndarray, first: np.ndarray, size: np.ndarray, within: int):
    """(phrase, position of its rarest word) where every word of the phrase stands at most ``within`` words away,
    in any order and in the same document."""
    term = segment.find(words)
    out_phrase, out_at = [], []
    for i in range(len(first)):
        terms = np.unique(term[first[i] : first[i] + size[i]])
        if not len(terms) or terms[0] < 0:
            continue
        terms = terms[np.argsort(segment.lists[terms + 1] - segment.lists[terms], kind="stable")]
        _, at = segment.postings_of(terms[:1])
        low, high = segment.starts[segment.doc_of(at)], segment.starts[segment.doc_of(at) + 1] - 1
        for t in terms[1:]:
            _, other = segment.postings_of(np.array([t]))
            j = np.searchsorted(other, np.maximum(at - within, low))
            keep = (j < len(other)) & (other[np.minimum(j, len(other) - 1)] <= np.minimum(at + within, high))
            at, low, high = at[keep], low[keep], high[keep]
        out_phrase.append(np.full(len(at), i))
        out_at.append(at)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_phrase), join(out_at)


class Items:
    """A block of test items cut into windows of ``window`` consecutive words; a shorter item is one window."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.ids = ids
        data = [(t or "").encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        self.words, counts = words_of(b"".join(data), at)
        base = np.concatenate([[0], np.cumsum(counts)])[:-1]
        windows = np.where(counts == 0, 0, np.maximum(counts - window + 1, 1))
        self.item = np.repeat(np.arange(len(ids)), windows)
        self.first = np.repeat(base, windows) + np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.size = np.minimum(counts, window)[self.item].astype(np.int64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Items]:
    """The test items in blocks of bounded size, streamed through the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if row[0] is None:
            continue
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") // 2
        if size > BLOCK_WORDS:
            yield Items(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, window)


def _hits(shared):
    """Per document of a segment: its words, merged hit spans relative to its start, and the items hit."""

    def run(batches):
        block = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                which, start = phrases(s, block.words, block.first, block.size)
                doc, stop = s.doc_of(start), start + block.size[which]
                n = len(s.ids)
                spans = [[] for _ in range(n)]
                items = [[] for _ in range(n)]
                order = np.lexsort((start, doc))
                for d, a, b in zip(doc[order].tolist(), start[order].tolist(), stop[order].tolist()):
                    a, b = a - int(s.starts[d]), b - int(s.starts[d])
                    if spans[d] and a <= spans[d][-1][1]:
                        spans[d][-1][1] = max(b, spans[d][-1][1])
                    else:
                        spans[d].append([a, b])
                pairs = np.unique(np.column_stack([doc, block.item[which]]), axis=0) if len(doc) else []
                for d, i in pairs:
                    if block.ids[i] not in items[d]:
                        items[d].append(block.ids[i])
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(s.ids, mask=~s.valid), pa.array(np.diff(s.starts)), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["segment", "row", "doc_id", "n_words", "spans", "items"])

    return run


SPANS = pa.list_(pa.list_(pa.int64()))
HITS = "segment long, row long, doc_id long, n_words long, spans array<array<bigint>>, items array<string>"


def _merge_spans(batches):
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for a, b in sorted(spans):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
            merged.append(out)
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(merged, SPANS))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs``.

    spans are the merged [from, to) word ranges inside exact occurrences of any window of any item; items the
    ids (as strings) of the items with such a window. Null and empty texts have no words and no hits, items
    without words or id match nothing, an empty item table hits nothing, repeated rows each get their row.
    """
    index = build_index(docs, id_col, text_col)
    share = docs.sparkSession.sparkContext.broadcast
    parts = [index.mapInArrow(_hits(share(b)), HITS) for b in item_blocks(items, item_id_col, item_text_col, window)]
    if not parts:
        parts = [index.mapInArrow(_hits(share(Items([], [], window))), HITS)]
    if len(parts) > 1:  # every block gives every row, with its own hits
        rows = reduce(DataFrame.unionByName, parts).groupBy("segment", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        parts = [rows.mapInArrow(_merge_spans, HITS)]
    return parts[0].drop("segment", "row")


def proximity(docs: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, position): places of an item's rarest word with all its other words within reach."""
    index = build_index(docs, id_col, text_col)
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, 1 << 30):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    s = Segment(row)
                    which, at = near(s, b.words, b.first, b.size, within)
                    doc = s.doc_of(at)
                    yield pa.RecordBatch.from_arrays([pa.array(s.ids[doc], mask=~s.valid[doc]), pa.array([b.ids[b.item[i]] for i in which], pa.string()), pa.array(at - s.starts[doc])], names=["doc_id", "item_id", "position"])

        part = index.mapInArrow(run, "doc_id long, item_id string, position long")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id string, position long") if out is None else out


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of ``contamination``."""
    spans = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select("doc_id", "n_words", spans.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
