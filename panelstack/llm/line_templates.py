"""Line dedup through a fixed-depth template tree (operator 6).

A line goes down the tree by its number of tokens and then by its leading tokens; tokens with a digit count as
variable. In a leaf, lines join the template with which they agree on enough positions, and positions where
they differ become variable. Templates that recur across documents are dropped from the texts. Recurring
means: in many different texts, and between many different pairs of neighbouring lines, so a passage that
stands in the copies of one document, always at the same place, is left to the near-duplicate operators.
Inside a passage the neighbours are always the same: there the nearest lines around it that aren't common count,
in texts of which most words stand in such lines; near copies of one document share most of theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import BROADCAST_ROWS, saved

#: Leading tokens that choose a leaf: the first depth. Only with a limit of ``LEAF_TOKENS`` a leaf with more tokens
#: in its lines uses the next depth, and past the last one its lines are templates as they stand; as that makes
#: results depend on the size of the table, there is none.
DEPTHS = (3, 8, 24)
LEAF_TOKENS: int | None = None
#: Tokens of the templates that a task holds of a leaf; lines that join none of them go another round.
BLOCK_TOKENS = 1_000_000
#: Hash of a variable token.
ANY = np.uint64(1)
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


class Lines:
    """The lines with a word of a chunk: row, ordinal in the row, token hashes."""

    def __init__(self, data: bytes, at: np.ndarray):
        raw, starts, ends, rows = T.find_words(data, at)
        digits = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(DIGIT[raw], out=digits[1:])
        self.tokens = np.where(digits[ends] > digits[starts], ANY, T.word_hashes(raw, starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        feeds = np.concatenate([[0], np.cumsum(raw == 10)])
        number = feeds[starts] - feeds[at[rows]] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(starts))
        self.row, self.number = rows[self.first], number[self.first]
        self.size = self.last - self.first
        up, self._down = T.powers(len(self.tokens))
        self._sum = np.zeros(len(self.tokens) + 1, np.uint64)
        np.cumsum(self.tokens * up[: len(self.tokens)], dtype=np.uint64, out=self._sum[1:])

    def hash(self, depth: int | None = None) -> np.ndarray:
        """Hash of the size and of the tokens, or of the first ``depth`` of them."""
        last = self.last if depth is None else np.minimum(self.last, self.first + depth)
        body = (self._sum[last] - self._sum[self.first]) * self._down[self.first]
        return T.mix(body + T.mix(self.size.astype(np.uint64) * np.uint64(31) + np.uint64(depth or 0)))


def _occurrences(batches, depths):
    """First occurrence of each line in each text: its hash, leaves, size, the text's key and its neighbours."""
    names = ["key", "line", "size", "context", *(f"leaf{d}" for d in depths)]
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for first, _, data, at in T.chunks(batch.column("text")):
            lines = Lines(data, at)
            if not len(lines.row):
                continue
            h = lines.hash()
            before, after = np.zeros_like(h), np.zeros_like(h)
            same = lines.row[1:] == lines.row[:-1]
            before[1:][same], after[:-1][same] = h[:-1][same], h[1:][same]
            context = T.mix(before * np.uint64(3) + T.mix(after + np.uint64(5)))
            order = np.lexsort((h, lines.row))
            once = np.ones(len(h), bool)
            once[order[1:]] = (h[order][1:] != h[order][:-1]) | (lines.row[order][1:] != lines.row[order][:-1])
            cols = [keys[first + lines.row], h, lines.size, context, *(lines.hash(d) for d in depths)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[once]).view(np.int64)) for c in cols], names=names)


def _line_tokens(batches):
    for batch in batches:
        for _, _, data, at in T.chunks(batch.column("text")):
            lines = Lines(data, at)
            if len(lines.row):
                h, once = np.unique(lines.hash(), return_index=True)
                tokens = [lines.tokens[lines.first[i] : lines.last[i]].tobytes() for i in once]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tokens, pa.binary())], names=["line", "tokens"])


class Leaf:
    """The templates of a leaf, at most ``most``, whose lines come one by one: all of the size of ``first`` and with
    its leading tokens.

    A line joins the template that shares most tokens with it, the earliest of equals, if they are at least the
    part ``agree`` of all; positions already variable don't count as shared. Else it founds a template. A template
    and a line that may differ in m places past the leading tokens agree in one of m + 1 parts at least: only
    templates with such a part are compared.
    """

    def __init__(self, first: np.ndarray, agree: float, most: int):
        n, lead = len(first), min(DEPTHS[0], len(first))
        self.need, self.most = agree * n, most
        self.spare = n - math.ceil(self.need) - int((first[:lead] == ANY).sum())
        cuts = np.linspace(lead, n, self.spare + 2).astype(int).tolist() if 0 <= self.spare < n - lead else [0, 0]
        self.parts = list(zip(cuts[:-1], cuts[1:]))
        self.templates = np.empty((4, n), np.uint64)
        self.owner: list[int] = []
        self.index: dict[tuple[int, bytes], list[int]] = {}

    def place(self, line: int, tokens: np.ndarray) -> int | None:
        """The founding line of the line's template; None if it joins none and there is no room for another."""
        if self.spare < 0:
            return line
        fixed = tokens != ANY
        keys = [(a, tokens[a:b].tobytes()) for a, b in self.parts if fixed[a:b].all()]
        at = sorted({t for k in keys for t in self.index.get(k, ())})
        if at:
            shared = ((self.templates[at] == tokens) & fixed).sum(1)
            best = int(shared.argmax())
            if shared[best] >= self.need:
                template = self.templates[at[best]]
                template[template != tokens] = ANY
                return self.owner[at[best]]
        k = len(self.owner)
        if k >= self.most:
            return None
        if k == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
        self.templates[k] = tokens
        self.owner.append(line)
        for key in keys:
            self.index.setdefault(key, []).append(k)
        return line


def _place(agree: float, block: int):
    """(line, template) of lines that don't found one, in a stream sorted by leaf; no template: another round."""

    def run(batches):
        leaf = last = held = None
        for batch in batches:
            out = []
            for name, line, tokens in zip(*(batch.column(c).to_pylist() for c in ("leaf", "line", "tokens"))):
                tokens = np.frombuffer(tokens, np.uint64)
                if held is None or name != leaf:
                    leaf, last, held = name, None, Leaf(tokens, agree, max(1, block // len(tokens)))
                if line == last:  # from several partitions, adjacent by the sort order
                    continue
                last, founder = line, held.place(line, tokens)
                if founder != line:
                    out.append((line, founder))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["line", "template"])

    return run


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def templates(docs: DataFrame, agree: float, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, template of each line that is not its own). ``docs`` has key and text.

    In a leaf, lines come by falling number of texts, then by hash: the result does not depend on partitions. A
    task holds a block of a leaf's templates; the lines that join none of them go another round, so no line that may
    join a template stays alone. One that agrees with templates of several blocks joins the best of the first.
    """
    depths = DEPTHS if LEAF_TOKENS else DEPTHS[:1]
    leaves = [f"leaf{d}" for d in depths]
    occurrences = saved(docs.mapInArrow(lambda batches: _occurrences(batches, depths), "key long, line long, size long, context long, " + ", ".join(f"{x} long" for x in leaves)), "line-occurrences")
    lines = saved(occurrences.groupBy("line").agg(F.count("*").alias("n"), F.first("size").alias("size"), *(F.first(x).alias(x) for x in leaves)), "lines")
    found = None
    rest = lines
    for leaf in leaves:
        counts = rest.groupBy(leaf).agg(F.count("*").alias("many"), F.sum("size").alias("tokens")).where("many > 1")
        members = rest.join(counts, leaf)
        fits = F.col("tokens") <= LEAF_TOKENS if LEAF_TOKENS else F.lit(True)
        part = members.where(fits).select("line", "n", F.col(leaf).alias("leaf"))
        found = part if found is None else found.unionByName(part)
        rest = members.where(~fits).select(*lines.columns)
    members = saved(found, "leaf-members")
    joined = None
    while True:
        tokens = docs.select("text").mapInArrow(_line_tokens, "line long, tokens binary").join(_small(members, broadcast_rows), "line")
        order = tokens.select("leaf", (-F.col("n")).alias("rank"), "line", "tokens").repartition("leaf").sortWithinPartitions("leaf", "rank", "line")
        placed = saved(order.mapInArrow(_place(agree, BLOCK_TOKENS), "line long, template long"), "line-templates")
        part = placed.where("template is not null")
        joined = part if joined is None else joined.unionByName(part)
        left = placed.where("template is null").select("line")
        if not left.limit(1).count():
            return occurrences, joined
        members = saved(members.join(left, "line"), "leaf-members")


def common_lines(occurrences: DataFrame, joined: DataFrame, min_texts: int) -> DataFrame:
    """(line, template, spread) of lines whose template stands in at least ``min_texts`` different texts; spread:
    between as many different pairs of neighbouring lines, too."""
    named = occurrences.join(joined, "line", "left").select("line", "key", "context", F.coalesce("template", "line").alias("template"))
    enough = [named.select("template", what).distinct().groupBy("template").count().where(F.col("count") >= min_texts).select("template") for what in ("key", "context")]
    often = enough[0].join(enough[1].withColumn("spread", F.lit(True)), "template", "left")
    return named.join(often, "template").select("line", "template", F.col("spread").isNotNull().alias("spread")).distinct()


def _among(h: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array ``chosen``."""
    if not len(chosen):
        return np.zeros(len(h), bool)
    return chosen[np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)] == h


def _passages(find):
    """(line, context) of the common lines, those of ``find(batch)``, in texts with most of their words in other
    lines; context: the nearest other lines around, at the line's first place in the text."""

    def run(batches):
        for batch in batches:
            common = find(batch)
            for first, n, data, at in T.chunks(batch.column("text")):
                lines = Lines(data, at)
                if not len(lines.row):
                    continue
                h = lines.hash()
                begin = np.searchsorted(lines.row, np.arange(n + 1))
                own = ~np.concatenate([_among(h[begin[r] : begin[r + 1]].view(np.int64), common(first + r)) for r in range(n)])
                place = np.arange(len(h))
                last = np.maximum.accumulate(np.where(own, place, -1))
                following = np.minimum.accumulate(np.where(own, place, len(h))[::-1])[::-1]
                before = np.where(last >= begin[lines.row], h[last], np.uint64(0))
                after = np.where(following < begin[lines.row + 1], h[np.minimum(following, len(h) - 1)], np.uint64(0))
                context = T.mix(before * np.uint64(3) + T.mix(after + np.uint64(5)))
                mostly = 2 * np.bincount(lines.row, weights=lines.size * own, minlength=n) > np.bincount(lines.row, weights=lines.size, minlength=n)
                order = np.lexsort((h, lines.row))
                once = np.ones(len(h), bool)
                once[order[1:]] = (h[order][1:] != h[order][:-1]) | (lines.row[order][1:] != lines.row[order][:-1])
                keep = once & ~own & mostly[lines.row]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (h, context)], names=["line", "context"])

    return run


def _lookup(keyed: DataFrame, occurrences: DataFrame, chosen: DataFrame, broadcast_rows: int):
    """(rows, find): ``find(batch)`` of the rows gives, for a row, the sorted hashes of the chosen lines, which are
    broadcast if counted and few, else joined to the rows."""
    if chosen.count() <= broadcast_rows:
        shared = keyed.sparkSession.sparkContext.broadcast(np.sort(np.array([r.line for r in chosen.toLocalIterator()], np.int64)))
        return keyed, lambda batch: lambda row: shared.value
    by_text = occurrences.join(chosen, "line").groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("chosen"))

    def of(batch):
        lists = batch.column("chosen").to_pylist()
        return lambda row: np.array(lists[row] or [], np.int64)

    return keyed.join(by_text, "key", "left"), of


def recurring(keyed: DataFrame, occurrences: DataFrame, joined: DataFrame, min_texts: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Lines whose template stands in at least ``min_texts`` different texts and in as many surroundings: pairs of
    neighbouring lines or, inside a passage of common lines, of the nearest lines around the passage."""
    common = saved(common_lines(occurrences, joined, min_texts), "common-lines")
    drop, inner = common.where("spread").select("line"), common.where("not spread").select("line", "template")
    if inner.limit(1).count():
        rows, find = _lookup(keyed.select("key", "text"), occurrences, common.select("line"), broadcast_rows)
        around = rows.drop("key").mapInArrow(_passages(find), "line long, context long").join(_small(inner, broadcast_rows), "line")
        enough = around.select("template", "context").distinct().groupBy("template").count().where(F.col("count") >= min_texts).select("template")
        drop = drop.unionByName(inner.join(enough, "template").select("line"))
    return saved(drop, "recurring-lines")


def _edit(text: str | None, lines: Lines, hashes: np.ndarray, drop: np.ndarray):
    """(text without the dropped lines, lines with a word, dropped); a text that would be emptied stays."""
    if text is None or not len(hashes):
        return text, len(hashes), 0
    gone = lines.number[drop]
    if not len(gone) or len(gone) == len(hashes):
        return text, len(hashes), 0
    gone = set(gone.tolist())
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(hashes), len(gone)


def _dropper(find):
    """``find(batch)`` gives, for a row, the sorted hashes to drop. Rows go out chunk by chunk: a worker never holds
    the edited texts of a whole batch."""

    def run(batches):
        for batch in batches:
            drops = find(batch)
            docs, texts = batch.column("doc"), batch.column("text")
            for first, n, data, at in T.chunks(texts):
                out, total, dropped = [], [], []
                lines = Lines(data, at)
                h = lines.hash().view(np.int64) if len(lines.row) else np.zeros(0, np.int64)
                begin = np.searchsorted(lines.row, np.arange(n + 1))
                for r in range(n):
                    a, b = begin[r], begin[r + 1]
                    one = Lines.__new__(Lines)
                    one.number = lines.number[a:b]
                    row = drops(first + r)
                    t, k, gone = _edit(texts[first + r].as_py(), one, h[a:b], _among(h[a:b], row))
                    out.append(t)
                    total.append(k)
                    dropped.append(gone)
                yield pa.RecordBatch.from_arrays([docs.slice(first, n), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["doc", "text", "n_lines", "n_dropped"])

    return run


def drop_recurring_lines(docs: DataFrame, min_texts: int, agree: float = 0.8, text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, and columns n_lines and n_dropped.

    Lines are cut at line feeds; a line without a word is never counted or dropped. A text is never emptied:
    one that consists of recurring lines only stays as it is. Null and empty texts stay; repeated rows are one
    text for the counts and each edited; other columns pass through (n_lines and n_dropped are replaced).
    Every whole text is read; the hashes of lines to drop are broadcast if counted and few, else joined.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc") if others else F.struct(F.lit(1).alias("none")).alias("doc"), F.col(text_col).alias("text"))
    keyed = packed.select("doc", "text", F.xxhash64("text").alias("key"))
    occurrences, joined = templates(keyed.select("key", "text"), agree, broadcast_rows)
    drop = recurring(keyed, occurrences, joined, min_texts, broadcast_rows)
    rows, find = _lookup(keyed, occurrences, drop, broadcast_rows)
    edited = rows.mapInArrow(_dropper(find), _schema(keyed))
    return edited.select(*(F.col("doc")[c].alias(c) for c in others), F.col("text").alias(text_col), "n_lines", "n_dropped")


def _schema(keyed: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([keyed.schema["doc"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])


def digests(edited: DataFrame) -> DataFrame:
    return edited.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
