"""Repeated paragraphs by MinHash banding, exact verification and components (operator 3).

Paragraphs are the lines of a text with enough words. Equal word sequences form a class at once. Each class
has a MinHash signature of its word shingles, cut into bands; classes that share a band are candidates, and
chains of candidates form groups. In a group the exact Jaccard similarity of every two classes is computed from
the shingle sets; those at or above the threshold are joined, and components of joined classes keep their first
occurrence only. A group beyond a token limit is cut into blocks and every pair of blocks verified by itself.

A passage may also stand inside a line or run over several. For those, word windows over the whole text, line
feeds or not, are paragraphs too. A window begins where the hash of a shingle is the least among WINDOW_AMONG
places in a row, so the same passage has the same windows wherever it stands, and any run of
WINDOW_WORDS + WINDOW_AMONG - 1 words has one. So few words leave 0.8 only to windows that differ at their ends
(a changed word takes five of 16 shingles), and those have neighbours: windows count as alike if equal. Repeated
lines and windows of a text are merged to spans of words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .store import BROADCAST_ROWS, by_group, saved, ship

BLOCK_TOKENS = 2_000_000
WINDOW_WORDS = 20
WINDOW_AMONG = 30
#: Band values tied at once in a task, windows looked at together in one, and how many of a class leave it as they are.
BAND_ROWS = 1 << 20
WINDOW_ROWS = 1 << 19
WINDOW_FEW = 8
_SEEDS = np.random.default_rng(99).integers(1, 2**64, (2, 512), dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: float, recall: float, most: int = 16) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence fewest false candidates, for which a pair at the threshold
    shares a band with probability ``recall`` using at most ``most`` bands."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def lines_of(data: bytes, at: np.ndarray, k: int, least: int):
    """The lines of at least ``least`` words of a chunk: row, line number, words, class, and their shingles' hashes
    one line after another with where each line's begin."""
    raw, starts, ends, rows = T.find_words(data, at, T.LOWER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    words = T.word_hashes(raw, starts, ends)
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    number = feeds[starts] - feeds[at[rows]]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    up, down = T.powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=total[1:])
    body = T.mix((total[first + size] - total[first]) * down[first] + size.astype(np.uint64)).view(np.int64)
    enough = size >= least
    inside = np.repeat(enough, size)
    first, size, body = first[enough], size[enough], body[enough]
    hashes, owner = T.shingle_hashes(words[inside], np.repeat(np.arange(len(first)), size), len(first), k)
    begin = np.concatenate([[0], np.cumsum(T.row_counts(owner, len(first)))])
    return rows[first], number[first], size, body, hashes, begin


def paragraphs(data: bytes, at: np.ndarray, k: int, least: int):
    """Paragraphs of at least ``least`` words of a chunk: row, line number, words, class, hashes of shingles."""
    rows, number, size, body, hashes, begin = lines_of(data, at, k, least)
    for p in range(len(rows)):
        yield int(rows[p]), int(number[p]), int(size[p]), int(body[p]), hashes[begin[p] : begin[p + 1]]


def window_starts(marks: np.ndarray, rows: np.ndarray, among: int) -> np.ndarray:
    """Of the places of each row (ascending) those with the least mark, the first of equals, among some ``among``
    in a row, or among all of the row if it has fewer."""
    n = len(marks)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n, dtype=np.uint64)
    low = np.uint64(0xFFFF)
    key = (marks & ~low) | (at & low)
    least, span = key, 1
    while span < min(among, n):  # minima of ``span`` places from each on
        more = min(span, among - span)
        if len(least) <= more:
            break
        least, span = np.minimum(least[:-more], least[more:]), span + more
    found = [np.zeros(0, np.int64)]
    if span == among:
        whole = np.flatnonzero(rows[: n - among + 1] == rows[among - 1 :])
        found.append(whole + ((least[whole] - whole.astype(np.uint64)) & low).astype(np.int64))
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    few = np.diff(np.append(first, n)) < among
    if few.any():
        best = np.minimum.reduceat(key, first)[few]
        found.append(first[few] + ((best - first[few].astype(np.uint64)) & low).astype(np.int64))
    return np.unique(np.concatenate(found))


def passages(data: bytes, at: np.ndarray, k: int, least: int, size: int, among: int):
    """Rows, first words, word counts, classes and kinds (0 lines of at least ``least`` words, 1 windows) of a chunk."""
    raw, starts, ends, rows = T.find_words(data, at, T.LOWER)
    words = T.word_hashes(raw, starts, ends)
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    number = feeds[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(starts)))
    first, many = first[many >= least], many[many >= least]
    within = np.zeros(len(starts), bool)
    if len(starts) >= size:
        within[: len(starts) - size + 1] = rows[: len(starts) - size + 1] == rows[size - 1 :]
    places = np.flatnonzero(within)
    mark = np.zeros(len(places), np.uint64)
    for i in range(min(k, size)):
        mark += words[places + i] * T._PLACE[i]
    begin = places[window_starts(T.mix(mark), rows[places], among)]
    kind = np.append(np.zeros(len(first), np.int32), np.ones(len(begin), np.int32))
    first, many = np.append(first, begin), np.append(many, np.full(len(begin), size))
    up, down = T.powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], dtype=np.uint64, out=total[1:])
    cls = T.mix((total[first + many] - total[first]) * down[first] + many.astype(np.uint64)).view(np.int64)
    text_first = np.searchsorted(rows, np.arange(len(at) - 1))
    owner = rows[first]
    order = np.argsort(owner, kind="stable")
    return owner[order], (first - text_first[owner])[order], many[order], cls[order], kind[order]


def _apart(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


_PLACE_SCHEMA = "class long, doc_key long, doc_id long, first_word long, n_words long, kind int, extra boolean, hot boolean"


def _passages(k: int, least: int, size: int, among: int):
    """Lines and windows. Of a class of windows only the first WINDOW_FEW in WINDOW_ROWS are to be dealt out by
    class; the others are ``extra``, and those that have such are ``hot``."""
    names = [x.split()[0] for x in _PLACE_SCHEMA.split(", ")]

    def batch_of(cls, key, doc, null, first, many, kind, extra, hot):
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(key), pa.array(doc, mask=null), pa.array(first), pa.array(many), pa.array(kind), pa.array(extra), pa.array(hot)], names=names)

    def windows(parts):
        cls, key, doc, null, first, many = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((first, key, doc, null, cls))
        cls, key, doc, null, first, many = (x[order] for x in (cls, key, doc, null, first, many))
        once = _apart(cls, key, first)
        cls, key, doc, null, first, many = (x[once] for x in (cls, key, doc, null, first, many))
        new = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        length = np.diff(np.append(new, len(cls)))
        at = np.arange(len(cls))
        other = np.minimum.reduceat(np.where(key != np.repeat(key[new], length), at, len(cls)), new)  # the first of another text
        extra = (at - np.repeat(new, length) >= WINDOW_FEW) & (at != np.repeat(other, length))
        return batch_of(cls, key, doc, null, first, many, np.ones(len(cls), np.int32), extra, np.repeat(np.logical_or.reduceat(extra, new), length))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            keys, ids = batch.column("doc_key").to_numpy(), batch.column("doc_id")
            docs, nulls = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for first, n, data, at in T.chunks(batch.column("text")):
                rows, begin, many, cls, kind = passages(data, at, k, least, size, among)
                where = first + rows
                line = kind == 0
                no = np.zeros(int(line.sum()), bool)
                yield batch_of(cls[line], keys[where[line]], docs[where[line]], nulls[where[line]], begin[line], many[line], kind[line], no, no)
                where, begin, many, cls = (x[~line] for x in (where, begin, many, cls))
                if len(where):
                    held.append((cls, keys[where], docs[where], nulls[where], begin, many))
                    count += len(where)
                if count >= WINDOW_ROWS:
                    yield windows(held)
                    held, count = [], 0
        if held:
            yield windows(held)

    return run


_HIT_SCHEMA = "class long, doc_key long, doc_id long, first_word long, n_words long, keep_doc_id long, keep_first_word long, is_first boolean, hot boolean"


def _same_windows(batches):
    """From windows sorted by (class, null id, id, key, word): those of classes in different texts, with the first one.

    Equal rows count once. Rows of a class wait only until a second text shows up; then they stream."""
    names = [x.split()[0] for x in _HIT_SCHEMA.split(", ")]
    now = None  # class, its first row's key, id and word, the last row, whether two texts have it, rows that wait
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, key, first, many = (batch.column(c).to_numpy() for c in ("class", "doc_key", "first_word", "n_words"))
        ids = batch.column("doc_id")
        doc, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        rows = [cls, key, doc, null, first, many, hot]
        once = _apart(cls, key, first)
        once[0] = now is None or (cls[0], key[0], first[0]) != now[2]
        rows = [x[once] for x in rows]
        if now is not None and not now[3]:  # held rows of one text come first
            rows = [np.concatenate([h, r]) for h, r in zip(now[4], rows)]
            fresh = True
        else:
            fresh = now is None or now[0] != cls[0]
        cls, key, doc, null, first, many, hot = rows
        if not len(cls):
            continue
        new = np.append(fresh, cls[1:] != cls[:-1])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lead = [x[begin] for x in (key, doc, null, first)]
        if not fresh:  # the rows before the first new class go on with the class before
            group = group + 1
            lead = [np.append(np.array([y], x.dtype), x) for x, y in zip(lead, now[1])]
        lead_key, lead_doc, lead_null, lead_first = (x[group] for x in lead)
        several = np.zeros(group[-1] + 1, bool)
        several[group[key != lead_key]] = True
        if not fresh:
            several[0] = True
        last = group == group[-1]
        wait = last & ~several[group]
        out = several[group] & ~wait
        at = np.flatnonzero(out)
        is_first = (doc[at] == lead_doc[at]) & (null[at] == lead_null[at]) & (first[at] == lead_first[at])
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(key[at]), pa.array(doc[at], mask=null[at]), pa.array(first[at]), pa.array(many[at]),
                                          pa.array(lead_doc[at], mask=lead_null[at]), pa.array(lead_first[at]), pa.array(is_first), pa.array(hot[at])], names=names)
        held = [x[wait] for x in (cls, key, doc, null, first, many, hot)]
        now = (cls[-1], tuple(x[-1] for x in lead), (cls[-1], key[-1], first[-1]), bool(several[-1]), held)


def _list(k: int, least: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            out = [(first + r, line, n, c) for first, _, data, at in T.chunks(batch.column("text")) for r, line, n, c, _ in paragraphs(data, at, k, least)]
            r, line, n, c = (np.array([x[i] for x in out], np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(line), pa.array(n), pa.array(c)], names=["doc_id", "line", "n_words", "class"])

    return run


def signatures(hashes: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band values of each line, from the least of every seeded hash of its shingles."""
    mixed = np.zeros((len(begin) - 1, bands), np.uint64)
    for band in range(bands):
        for j in range(band * rows, (band + 1) * rows):
            low = np.minimum.reduceat(hashes * _SEEDS[0, j] + _SEEDS[1, j], begin[:-1])
            mixed[:, band] = T.mix(mixed[:, band] * np.uint64(3) + low)
    return T.mix(mixed + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _bands(k: int, least: int, bands: int, rows: int):
    """(value, class) of the bands of each class. Classes of one value are tied within the task, BAND_ROWS at a time:
    the first stands for it, the others are edges to that one (``other``), under values of their own."""

    def combined(value, cls):
        order = np.lexsort((cls, value))
        value, cls = value[order], cls[order]
        fresh = np.append(True, (value[1:] != value[:-1]) | (cls[1:] != cls[:-1]))
        value, cls = value[fresh], cls[fresh]
        first = np.append(True, value[1:] != value[:-1])
        hub = cls[np.flatnonzero(first)][np.cumsum(first) - 1]
        value = np.where(first, value, T.mix(cls.view(np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array(cls), pa.array(hub, mask=first)], names=["value", "class", "other"])

    def run(batches):
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for _, _, data, at in T.chunks(batch.column("text")):
                _, _, _, body, hashes, begin = lines_of(data, at, k, least)
                new = np.zeros(len(body), bool)
                for i, c in enumerate(body.tolist()):
                    if c not in seen:
                        new[i] = True
                        seen.add(c)
                if len(seen) >= 500_000:
                    seen.clear()
                if not new.any():
                    continue
                length = np.diff(begin)
                hashes, begin = hashes[np.repeat(new, length)], np.concatenate([[0], np.cumsum(length[new])])
                held.append((signatures(hashes, begin, bands, rows).ravel(), np.repeat(body[new], bands)))
                count += len(held[-1][0])
                if count >= BAND_ROWS:
                    yield combined(*(np.concatenate(x) for x in zip(*held)))
                    held, count = [], 0
        if held:
            yield combined(*(np.concatenate(x) for x in zip(*held)))

    return run


def _edges(batches):
    """From rows sorted by (value, class): each class and the first one of its value, and the edges given."""
    value, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        v, c = batch.column("value").to_numpy(), batch.column("class").to_numpy()
        given = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
        other = batch.column("other").fill_null(0).to_numpy()
        a, b = [c[given]], [other[given]]
        v, c = v[~given], c[~given]
        if len(v):
            first = np.append(v[0] != value if value is not None else True, v[1:] != v[:-1])
            hubs = np.append(c[first], 0)[np.cumsum(first) - 1]  # rows before the first belong to the value before
            hubs[np.cumsum(first) == 0] = hub if hub is not None else 0
            a.append(c[c != hubs])
            b.append(hubs[c != hubs])
            value, hub = v[-1], int(hubs[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _sets(k: int, least: int):
    def run(batches):
        for batch in batches:
            seen, tokens = {}, []
            for _, _, data, at in T.chunks(batch.column("text")):
                for _, _, _, c, hashes in paragraphs(data, at, k, least):
                    if c not in seen:
                        seen[c] = len(tokens)
                        tokens.append(np.unique(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(tokens, pa.binary())], names=["class", "tokens"])

    return run


def verified(sets: list[np.ndarray], percent: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component labels of sets after joining every two, one of ``left`` and one of ``right``, whose Jaccard
    similarity is at least ``percent`` / 100."""
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    _, flat = np.unique(np.concatenate([sets[i] for i in right] + [sets[i] for i in left]), return_inverse=True)
    cut = int(size[right].sum())
    holder = np.repeat(right, size[right])
    order = np.argsort(flat[:cut], kind="stable")
    holder, begin = holder[order], np.searchsorted(flat[:cut][order], np.arange(flat.max() + 2))
    at = cut
    for i in left:
        mine = flat[at : at + size[i]]
        at += size[i]
        spans = begin[mine + 1] - begin[mine]
        hits = holder[np.repeat(begin[mine] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
        shared = np.bincount(hits, minlength=len(sets))
        linked = np.flatnonzero((100 * shared >= percent * (size + size[i] - shared)) & (shared > 0))
        names = np.unique(label[np.append(linked, i)])
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]
    return label


def _group(percent: int):
    def work(group: pa.Table):
        group = group.combine_chunks()
        _, once = np.unique(group.column("class").to_numpy(), return_index=True)  # from several partitions
        cls, block = group.column("class").to_numpy()[once], group.column("block").to_numpy()[once]
        tokens = group.column("tokens").to_pylist()
        sets = [np.frombuffer(tokens[i], np.uint64) for i in once]
        left, right = np.flatnonzero(block == group.column("first")[0].as_py()), np.flatnonzero(block == group.column("second")[0].as_py())
        if not len(left) or not len(right):
            return None
        label = verified(sets, percent, left, right)
        least = np.full(len(cls), np.iinfo(np.int64).max)
        np.minimum.at(least, label, cls)
        root = least[label]
        other = root != cls
        return pa.RecordBatch.from_arrays([pa.array(cls[other]), pa.array(root[other])], names=["a", "b"]) if other.any() else None

    return work


def alike_lines(text: DataFrame, listed: DataFrame, words: int, percent: int, least_words: int, recall: float) -> DataFrame:
    """(node, root) of the classes of lines in components of alike ones; ``listed`` has their class and n_words."""
    bands, rows = bands_for(percent / 100, recall)
    banded = text.mapInArrow(_bands(words, least_words, bands, rows), "value long, class long, other long")
    groups = components(banded.repartition("value").sortWithinPartitions("value", "class").mapInArrow(_edges, "a long, b long"))

    sizes = listed.groupBy("class").agg(F.first("n_words").alias("n"))
    members = groups.select(F.col("node").alias("class"), F.col("root").alias("grp")).join(sizes, "class")
    weight = members.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    needed = saved(members.join(weight, "grp").select("class", "grp", "blocks"), "paragraph-groups")
    small = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = text.mapInArrow(_sets(words, least_words), "class long, tokens binary").join(small, "class")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("grp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "class", "block", "tokens")
    found = saved(by_group(sets, ["grp", "first", "second"], ["class"], _group(percent), "a long, b long"), "paragraph-links")
    if needed.where("blocks > 1").limit(1).count():
        joined = components(found)
    else:  # every class is in one block, so its label is its component's
        joined = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return joined


def repeated_paragraphs(docs: DataFrame, words: int = 5, percent: int = 80, least_words: int = 20, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that repeats: doc_id, line, n_words, keep_doc_id, keep_line, removed.

    Paragraphs are lines (cut at line feeds, numbered from 0) of at least ``least_words`` words; words are runs
    of non-white-space after lower-casing A-Z. Two paragraphs are alike if the Jaccard similarity of their
    distinct ``words``-word shingles is at least ``percent`` / 100; of each component of alike paragraphs the
    first by (doc_id, line) is kept and the others are removed. Null, empty and short texts give no rows; rows
    with a null id count as last; repeated rows count as repeated paragraphs. The banding finds a pair at the
    threshold with probability ``recall`` and a closer one with more; equal paragraphs always.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = saved(docs.mapInArrow(_list(words, least_words), "doc_id long, line long, n_words long, class long"), "paragraphs")
    joined = alike_lines(docs.select("text"), listed, words, percent, least_words, recall)
    named = listed.join(joined.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")).alias("kept"), F.count("*").alias("many")).where("many > 1")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("line") == F.col("kept.line"))
    return named.join(kept, "root").select("doc_id", "line", "n_words", F.col("kept.doc_id").alias("keep_doc_id"), F.col("kept.line").alias("keep_line"), (~same).alias("removed"))


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs of ``repeats`` taken out of their texts (ids must be unique)."""
    gone = repeats.where("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_gone"))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<long>")), i.cast("long")))
    return docs.join(gone, F.col(id_col) == F.col("_id"), "left").withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))).drop("_id", "_gone")


def _cover(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Merged [first, end) of overlapping or adjoining stretches of words."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate((first + many)[order])
    new = np.append(True, first[1:] > end[:-1])
    return np.column_stack([first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]])


def _less(spans: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``spans`` without the words of ``kept``, both merged."""
    out = []
    for a, b in spans.tolist():
        for c, d in kept[np.searchsorted(kept[:, 1], a, "right") : np.searchsorted(kept[:, 0], b)].tolist():
            if a < c:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _spans(group: pa.Table):
    """One row per merged span of a text; words of a first occurrence are never removed."""
    group = group.combine_chunks()
    first, many, kept, keep_first = (group.column(c).to_numpy() for c in ("first_word", "n_words", "is_first", "keep_first_word"))
    held = _cover(first[kept], many[kept]) if kept.any() else np.zeros((0, 2), np.int64)
    gone = _less(_cover(first[~kept], many[~kept]), held) if not kept.all() else np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    spans = np.concatenate([held, gone])
    # the paragraph that begins a span, or the last one to begin before it, names the occurrence that stays
    source = np.empty(len(spans), np.int64)
    for mine, at in ((kept, slice(0, len(held))), (~kept, slice(len(held), None))):
        places = order[mine[order]]
        if len(places):
            source[at] = places[np.searchsorted(first[places], spans[at, 0], "right") - 1]
    names = ["doc_id", "first_word", "n_words", "keep_doc_id", "keep_first_word", "removed"]
    removed = np.arange(len(spans)) >= len(held)
    at_first = keep_first[source] + np.where(removed, spans[:, 0] - first[source], 0)
    where = pa.array(source)
    return pa.RecordBatch.from_arrays([group.column("doc_id").take(where).combine_chunks(), pa.array(spans[:, 0]), pa.array(spans[:, 1] - spans[:, 0]), group.column("keep_doc_id").take(where).combine_chunks(),
                                       pa.array(at_first), pa.array(removed)], names=names)


def repeated_passages(docs: DataFrame, words: int = 5, percent: int = 80, least_words: int = 20, recall: float = 0.999, window: int = WINDOW_WORDS, among: int = WINDOW_AMONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span of words that repeats: doc_id, first_word, n_words, keep_doc_id, keep_first_word, removed.

    Paragraphs are lines of at least ``least_words`` words, alike as in ``repeated_paragraphs``, and windows of
    ``window`` words over the whole text (see above), alike if equal; a window must stand in two rows that differ
    in id or text. Of alike paragraphs the first by (doc_id, word) is kept, rows with a null id count as last.
    In each text the kept paragraphs are merged to spans with removed = false, and the words of the others, less
    those of kept ones, to spans with removed = true; keep_doc_id and keep_first_word say where such a span's
    first paragraph stays. Words are runs of non-white-space, numbered from 0. Null, empty and short texts give
    no rows, rows alike in id and text are one, other columns are not read. Any passage of
    ``window`` + ``among`` - 1 equal words in different texts is found, wherever it stands.
    """
    docs = docs.select(F.xxhash64(id_col, text_col).alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = saved(docs.mapInArrow(_passages(words, least_words, window, among), _PLACE_SCHEMA), "passages")
    columns = ["doc_key", "doc_id", "first_word", "n_words", "keep_doc_id", "keep_first_word", "is_first"]

    lines = listed.where("kind = 0").select("class", "doc_key", "doc_id", "first_word", "n_words")
    joined = alike_lines(docs.select("text"), lines, words, percent, least_words, recall)
    roots = saved(joined.select(F.col("node").alias("class"), "root"), "passage-roots")  # lines alike but not equal
    named = lines.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    place = F.struct("doc_key", "first_word")
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "first_word")).alias("kept"), F.min(place).alias("a"), F.max(place).alias("b"))
    kept = kept.where("a <> b").select("root", F.col("kept.doc_id").alias("keep_doc_id"), F.col("kept.first_word").alias("keep_first_word"))
    is_first = (F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("first_word") == F.col("keep_first_word"))).alias("is_first")
    line_hits = named.join(kept, "root").select(*columns[:-1], is_first).distinct()

    order = ["class", F.col("doc_id").isNull(), "doc_id", "doc_key", "first_word"]
    windows = listed.where("kind = 1 and not extra").select("class", "doc_key", "doc_id", "first_word", "n_words", "hot")
    same = saved(windows.repartition("class").sortWithinPartitions(*order).mapInArrow(_same_windows, _HIT_SCHEMA), "passage-windows")
    hubs = same.where("hot").select("class", "keep_doc_id", "keep_first_word").distinct()
    more = listed.where("extra").join(hubs, "class").select(*columns[:-1], is_first).distinct()
    hits = line_hits.unionByName(same.select(*columns)).unionByName(more)
    return by_group(hits, ["doc_key"], ["first_word"], _spans, "doc_id long, first_word long, n_words long, keep_doc_id long, keep_first_word long, removed boolean")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str | None, first, many) -> str | None:
    """The text without the words first[i] .. first[i] + many[i] - 1, from the first one's begin to the last one's end."""
    if text is None or first is None or not len(first):
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for a, n in sorted(zip(first, many)):
        out.append(data[at : places[a][0]])
        at = places[a + n - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def without_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans of ``repeated_passages`` cut out of their texts; the white space around a span
    and all else stays. Rows of one id must be alike in their text; rows without spans, null texts and other columns
    stay as they are."""
    ship(docs.sparkSession)
    gone = spans.where("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_gone"))  # a text's spans
    cut = F.pandas_udf(lambda texts, first, many: texts.combine(pd.Series(list(zip(first, many)), index=texts.index), lambda t, s: _cut(t, *s)), "string")
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left")
    edited = cut(F.col(text_col), F.col("_gone.first_word"), F.col("_gone.n_words"))
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(edited).alias(c) if c == text_col else F.col(c) for c in docs.columns))
