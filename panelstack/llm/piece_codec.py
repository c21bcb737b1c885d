"""Exact merge-type piece encoding by backtracking, and its decoding (operator 4).

The result of merging pairs by score is unique, and a sequence of pieces is that result if and only if merging
every adjacent two of them again gives the same two. So a text is encoded from left to right: an Aho-Corasick
automaton gives the pieces that start at each position; the longest one that is compatible with its left
neighbour is taken, and where none fits, the position is marked in a bitfield of failed positions and the
search steps back. No merge queue over the text is kept. No piece has a space mark after another character,
so the text falls into independent words; frequent words are kept encoded.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words kept encoded and pairs kept checked by a Python worker.
WORDS_KEPT = 300_000
PAIRS_KEPT = 400_000
#: Rows whose ids a worker holds before they go out.
ROWS_OUT = 1_000


class Vocabulary:
    """Pieces of a sentencepiece BPE model with byte fallback, dummy prefix and identity normalisation."""

    def __init__(self, pieces, scores, kinds, unk, bos, eos):
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.unk, self.bos, self.eos = unk, bos, eos

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds, sp.unk_id(), sp.bos_id(), sp.eos_id())


class Kept(dict):
    """A cache that makes what it lacks, so that a hit costs no Python call."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class Codec:
    """Encodes and decodes in a worker; texts are ``str``, ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v = v
        normal = [i for i, k in enumerate(v.kinds) if k == "normal"]
        if any(SPACE in v.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece has a space mark inside; words are not independent")
        self.score = {v.pieces[i]: v.scores[i] for i in normal}
        self.code = {v.pieces[i]: i.to_bytes(4, "little") for i in normal}
        self.byte = {int(v.pieces[i][3:5], 16): i.to_bytes(4, "little") for i, k in enumerate(v.kinds) if k == "byte"}
        runs = {s for p, s in self.score.items() if len(p) > 1 and not p.strip(SPACE)}
        if len(runs) > 1 or runs and max(runs) >= min(s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)):
            raise ValueError("runs of space marks are merged before words; words are not independent")
        self.feeds_merge = any("\n" in p for p in self.score) or 10 not in self.byte
        self.automaton = ahocorasick.Automaton()
        made = {p for p in self.score if self.merge(p) == [p]}  # the others never appear
        #: Length of the longest proper prefix that may stand alone: a piece, or at last one character.
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in made), 1) for p in made if len(p) > 1}
        #: What each piece is merged from, and the pieces that are not merged in the order of scores.
        self.halves = {p: tuple(self.merge(p, 2)) for p in made if len(p) > 1}
        self.odd = {p for p, h in self.halves.items() if any(x in self.halves and self.score[x] <= self.score[p] for x in h)}
        #: Adjacent characters inside pieces: no merge goes over any others.
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.longer = ahocorasick.Automaton()  # without the single characters, which need no search
        for piece in made:
            self.automaton.add_word(piece, len(piece))
            if len(piece) > 1:
                self.longer.add_word(piece, len(piece) - 1)
        for automaton in (self.automaton, self.longer):
            if len(automaton):
                automaton.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.pairs_kept = 0
        self.words, self.after_feed = Kept(self.word), Kept(self.line)
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.begin, self.end = v.bos.to_bytes(4, "little"), v.eos.to_bytes(4, "little")
        self.controls = [i for i, k in enumerate(v.kinds) if k == "control"]
        shown = {"control": lambda p: b"", "unknown": lambda p: " ⁇ ".encode(), "byte": lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [shown.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(v.pieces, v.kinds)]

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The definition: join the best-scored adjacent pair, the leftmost of equals, while one is a piece."""
        parts = list(text)
        while len(parts) > least:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: merging both anew gives them back."""
        after = self.pairs.get(a)
        known = None if after is None else after.get(b)
        if known is None:
            if self.pairs_kept >= PAIRS_KEPT:
                self.pairs.clear()
                self.pairs_kept = 0
            odd = a in self.odd or b in self.odd
            known = self.merge(a + b) == [a, b] if odd else self.apart(a, b)
            self.pairs.setdefault(a, {})[b] = known
            self.pairs_kept += 1
        return known

    def apart(self, x: str, y: str) -> bool:
        """Merging x + y anew, followed at the border only and from the end back to single characters.

        x and y are what stands left and right of the border; each was used up by the next merge on its own
        side, at scores until_x and until_y. Had the pair a better score (the leftmost of equals goes first),
        the border would have been merged away.
        """
        until_x = until_y = -math.inf
        while True:
            s = self.score.get(x + y)
            if s is not None and s > until_x and s >= until_y:
                return False
            made_x = self.score[x] if x in self.halves else math.inf
            made_y = self.score[y] if y in self.halves else math.inf
            if made_x < made_y:
                until_x, x = made_x, self.halves[x][1]
            elif made_y < math.inf:
                until_y, y = made_y, self.halves[y][0]
            else:
                return True

    def split(self, text: str) -> list[str]:
        """Pieces of a word without runs of space marks; a character outside the vocabulary stands alone."""
        pairs, parts, pos, after = self.pairs, [], 0, None
        for end, size in self.automaton.iter_long(text):  # if nothing fails, the longest matches are the encoding
            if end + 1 - size != pos:
                return self.search(text, [], 0)
            piece = text[pos : end + 1]
            if pos and not ((after.get(piece) if after else None) or self.fits(parts[-1], piece)):
                return self.search(text, parts, pos)
            parts.append(piece)
            pos, after = end + 1, pairs.get(piece)
        return parts if pos == len(text) else self.search(text, [], 0)

    def search(self, text: str, parts: list[str], pos: int) -> list[str]:
        """The backtracking: the longest piece first, then ever shorter prefixes of it that are pieces.

        It goes on at ``pos`` behind ``parts``, each the longest piece at its place and none failed.
        """
        n = len(text)
        longest = [1] * n + [0]
        if len(self.longer):
            for end, more in self.longer.iter(text):  # ends ascend, so the last one of a place is the longest
                longest[end - more] = more + 1
        failed = bytearray(n + 1)
        shorter, pairs = self.shorter, self.pairs
        size, last = longest[pos], parts[-1] if parts else ""
        while pos < n:
            after = pairs.get(last) or {}
            while size:
                piece = text[pos : pos + size]
                if not failed[pos + size]:
                    if not last:
                        break
                    known = after.get(piece)
                    if known or known is None and self.fits(last, piece):
                        break
                size = shorter.get(piece, 0)
            if size:
                parts.append(piece)
                pos, last = pos + size, piece
                size = longest[pos]
            else:
                if not parts:
                    raise ValueError("no encoding")  # can't happen: the merged form always exists
                failed[pos] = 1
                pos -= len(last)
                size = shorter.get(parts.pop(), 0)
                last = parts[-1] if parts else ""
        return parts

    def codes(self, parts: list[str]) -> bytes:
        code = self.code
        try:
            return b"".join([code[p] for p in parts])
        except KeyError:
            byte = self.byte
            return b"".join([code[p] if p in code else b"".join(byte[x] for x in p.encode()) for p in parts])

    def segment(self, marks: int, rest: str) -> bytes:
        """``marks`` space marks and then a word without any.

        Pieces of several marks have the lowest scores, so they are merged when the word is done: the last
        mark belongs to the word if its first piece took it, else to the run.
        """
        parts = self.split(SPACE + rest) if marks and rest else self.split(rest) if rest else []
        if marks and rest:
            if parts[0] == SPACE:
                parts = parts[1:]
            else:
                marks -= 1
        run: list[str] = []
        for _ in range(marks):  # all their scores are equal, so the leftmost pair always goes first
            run.append(SPACE)
            while len(run) > 1 and run[-2] + run[-1] in self.score:
                run[-2:] = [run[-2] + run[-1]]
        return self.codes([*run, *parts])

    def fresh(self, key: str, first: bool) -> bytes:
        """Encodes a word, or takes it from the older generation of the cache, and keeps it."""
        code = self.older[0 if first else 1].get(key)
        if code is None and 1 < len(key) <= 64 and key[-2:] not in self.inside:  # as before a full stop
            return (self.words if first else self.after_feed)[key[:-1]] + self.codes([key[-1]])
        if code is None:
            code = self.segment(1, key) if first else self.byte[10] + self.segment(0, key)
        if len(key) <= 64:
            if len(self.words) + len(self.after_feed) >= WORDS_KEPT // 2:
                self.older = self.words, self.after_feed
                self.words, self.after_feed = Kept(self.word), Kept(self.line)
            (self.words if first else self.after_feed)[key] = code
        return code

    def word(self, key: str) -> bytes:
        """The codes of a mark and a word that isn't kept and may hold line feeds."""
        if "\n" in key:  # a line feed merges with nothing
            head, *lines = key.split("\n")
            return self.words[head] + b"".join([self.after_feed[x] for x in lines])
        return self.fresh(key, True)

    def line(self, key: str) -> bytes:
        """The codes of a line feed and the word after it, which isn't kept."""
        return self.fresh(key, False)

    def encode(self, text: str) -> bytes:
        """Ids of the text, with begin and end."""
        if not text:
            return self.begin + self.end
        parts = text.split(" ")
        if "" in parts or SPACE in text or self.feeds_merge:
            marked = SPACE + text.replace(" ", SPACE)
            body = b"".join([self.segment(len(m[1]), m[2]) for m in re.finditer(f"({SPACE}*)([^{SPACE}]*)", marked) if m[0]])
        else:
            body = b"".join([self.words[x] for x in parts])
        return self.begin + body + self.end

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control pieces vanish, and so does the mark of a first piece."""
        kinds = self.v.kinds
        start, stop = 0, len(ids)
        while start < stop and kinds[ids[start]] == "control":
            start += 1
        while start < stop and kinds[ids[stop - 1]] == "control":
            stop -= 1
        if start == stop:
            return ""
        first, rest = ids[start], ids[start + 1 : stop]
        head = self.surface[first]
        head = head[1:] if kinds[first] == "normal" and head[:1] == b" " else head
        if not any(c in rest for c in self.controls):
            return self._text(head + b"".join(map(self.surface.__getitem__, rest)))
        out, run = [], [head]
        for i in rest:  # a control piece ends a run of bytes
            if i in self.controls:
                out.append(self._text(b"".join(run)))
                run = []
            else:
                run.append(self.surface[i])
        return "".join([*out, self._text(b"".join(run))])

    def _text(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._repair(raw)

    @staticmethod
    def _repair(raw: bytes) -> str:
        """Every byte that is part of no valid character becomes a replacement character."""
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode())
                out.append("�")
                at += e.start + 1
        return "".join(out)


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker, whatever the number of its tasks."""
    if shared.value.pieces and id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = Codec(shared.value)
    return _codecs[id(shared.value)]


def _share(docs: DataFrame, model_path: str):
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row, with begin and end ids. Null counts as empty: begin and end only.

    The model file is read on the driver; its pieces (bounded by the model) are broadcast.
    """
    shared = _share(docs, model_path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            ids = [np.frombuffer(codec.encode(t or ""), np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; begin and end ids vanish, bytes of no valid character become U+FFFD. Null: empty."""
    shared = _share(rows, model_path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the ids that ``encode`` gives and their ``decode``.

    Null texts count as empty; repeated rows and null ids stay as they are; other columns are not read.
    """
    shared = _share(docs, model_path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                raw = codec.encode(text.as_py() or "")
                n.append(len(raw) // 4)
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_tokens, and decodes: whether the ids' ``decode`` is the text (null: empty) again.

    A text that holds the space mark itself decodes to spaces there, as the model can't tell them apart.
    """
    shared = _share(docs, model_path)

    def run(batches):
        codec = _codec(shared)
        for batch in (b.slice(at, ROWS_OUT) for b in batches for at in range(0, b.num_rows, ROWS_OUT)):
            ids, same = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                ids.append(np.frombuffer(codec.encode(t), np.int32))
                same.append(codec.decode(ids[-1].tolist()) == t)
            size = np.array([len(i) for i in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "decodes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decodes boolean")
