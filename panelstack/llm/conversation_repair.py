"""Cheapest repairs of conversations by a run-length min-plus DP (operator 11).

A repaired conversation's role initials are ``(s?(ua)+)?``. Every row of a conversation is a symbol: its role's
initial (s, u, a or another) and its fault. Over the four states of the grammar a symbol is a min-plus matrix:
insertions, then the row's deletion, keeping or new role. Equal consecutive symbols form a run; the vector of
costs to go passes a run of n rows by the binary digits of n through cached powers of the symbol's matrix, and
the choices are unrolled by halves of those powers, which are cached too.

Rows are dealt out by ranges of (conversation, turn), so a conversation may be of any length: pieces of at most
PIECE_ROWS rows or PIECE_BYTES are tied together by their matrices. Costs to go run backward and states forward
over one short row a piece, and only the final digest of a conversation's repaired texts is taken in one stream.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import saved, ship

PIECE_ROWS = 4096
PIECE_BYTES = 1 << 22
SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits; keeping is free.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. What may be inserted, or a row be made, in each.
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Costs to go after the last row: user and assistant are still to come after a system row, assistant after a user row.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: Faults of a row, as letters: none, truncated, blank, duplicate.
FINE, CUT, BLANK, AGAIN = ".tbd"


def times(m: tuple, v: tuple) -> tuple:
    return tuple(min(c + x for c, x in zip(row, v)) for row in m)


def product(a: tuple, b: tuple) -> tuple:
    columns = list(zip(*b))
    return tuple(tuple(min(min(x + y for x, y in zip(row, col)), FAR) for col in columns) for row in a)


def symbol(initial: str, fault: str) -> str:
    """One letter for what decides a row's edits: d must go; capitals are truncated."""
    return "d" if fault in "bd" else initial.upper() if fault == CUT else initial


def choices(letter: str, state: int):
    """(edit, cost, next state) of a row in a state, by the edits' letters."""
    yield "D", DELETE, state
    if letter == "d":
        return
    extra = TRUNCATED if letter.isupper() else 0
    kept = KEEPS.get((state, letter.lower()))
    if kept is not None:
        yield "K", extra, kept
    yield "R", REROLE + extra, FORCED[state]


@lru_cache(None)
def power(letter: str, k: int) -> tuple:
    """The matrix of 2^k rows of a symbol: insertions before each row, then its edit."""
    if k:
        half = power(letter, k - 1)
        return product(half, half)
    rows = []
    for state in range(4):
        cost = [FAR] * 4
        at, paid = state, 0
        for _ in range(3):  # more insertions come back to a state already seen
            for _, c, to in choices(letter, at):
                cost[to] = min(cost[to], paid + c)
            at, paid = FORCED[at], paid + INSERT
        rows.append(tuple(cost))
    return tuple(rows)


def bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def least(v: tuple) -> tuple:
    low = min(v)
    return tuple(x - low for x in v)


@lru_cache(200_000)
def unrolled(letter: str, k: int, state: int, after: tuple) -> tuple[str, int]:
    """The cheapest edits of 2^k rows of a symbol, ASCII-least, and the state they lead to."""
    if k:
        middle = least(times(power(letter, k - 1), after))
        one, state = unrolled(letter, k - 1, state, middle)
        two, state = unrolled(letter, k - 1, state, after)
        return one + two, state
    before = times(power(letter, 0), after)
    edits = ""
    while True:
        options = [(e, c + after[to], to) for e, c, to in choices(letter, state)]
        options.append(("I", INSERT + before[FORCED[state]], FORCED[state]))
        edit, _, to = min(o for o in options if o[1] == before[state])
        edits, state = edits + edit, to
        if edit != "I":
            return edits, state


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(letter, len(list(g))) for letter, g in groupby(symbols)]


def matrix(symbols: str) -> tuple:
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for letter, n in runs(symbols):
        for k in bits(n):
            out = product(out, power(letter, k))
    return out


def walk(symbols: str, state: int, after: tuple) -> tuple[str, int]:
    """The edits of a piece from a state, given the costs to go after it, and the state they lead to."""
    steps = [(letter, k) for letter, n in runs(symbols) for k in bits(n)]
    ahead = []
    for letter, k in reversed(steps):
        ahead.append(after)
        after = least(times(power(letter, k), after))
    out = []
    for (letter, k), after in zip(steps, reversed(ahead)):
        edits, state = unrolled(letter, k, state, after)
        out.append(edits)
    return "".join(out), state


def tail(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (END[state] // INSERT)


@lru_cache(100_000)
def solved(symbols: str) -> tuple[int, str]:
    v = END
    for letter, n in reversed(runs(symbols)):
        for k in bits(n):
            v = times(power(letter, k), v)
    edits, state = walk(symbols, START, END)
    return v[START], edits + tail(state)


def applied(edits: str, state: int, roles: list[str], texts: list[str], initials: str) -> list[str]:
    """The repaired rows, as ``role:text``, of these edits."""
    out, row = [], 0
    for e in edits:
        if e == "I":
            state = FORCED[state]
            out.append(f"{ROLE[state]}:")
            continue
        if e == "K":
            state = KEEPS[state, initials[row]]
            out.append(f"{roles[row]}:{texts[row]}")
        elif e == "R":
            state = FORCED[state]
            out.append(f"{ROLE[state]}:{texts[row]}")
        row += 1
    return out


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, seq int, first_turn long, last_turn long, n_turns long, initials string, faults string, roles array<string>, texts array<string>, digests array<binary>"


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, key, conv):
        self.key, self.conv = key, conv
        self.clear()

    def clear(self):
        self.first = self.last = None
        self.n_turns = self.bytes = 0
        self.initials, self.faults, self.roles, self.texts = [], [], [], []
        self.seen = {}

    def add(self, turn, role, text, initial, fault):
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.last, self.n_turns = turn, self.n_turns + 1
        if fault != BLANK and self.seen.setdefault((role, text), len(self.roles)) != len(self.roles):
            fault = AGAIN
        self.initials.append(initial)
        self.faults.append(fault)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def whole(self):
        initials, faults = "".join(self.initials), "".join(self.faults)
        cost, audit = solved("".join(map(symbol, initials, faults)))
        said = "\n".join(applied(audit, START, self.roles, self.texts, initials))
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        sha = hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.key, self.conv, gaps, faults.count(BLANK), faults.count(AGAIN), faults.count(CUT), illegal(initials), cost, audit, sha, *[None] * 10)

    def part(self, part, seq):
        new = {at for at in self.seen.values()}
        digests = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if i in new else None
                   for i, (r, t) in enumerate(zip(self.roles, self.texts))]
        return (self.key, self.conv, *[None] * 8, part, seq, self.first, self.last, self.n_turns, "".join(self.initials), "".join(self.faults), self.roles, self.texts, digests)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pieces(schema: T.StructType):
    """Whole conversations solved; the first and last of a partition, and long ones, as pieces."""

    def run(batches):
        out_schema = _arrow(schema)
        part = TaskContext.get().partitionId()
        out, held = [], 0
        now, seq, first = None, 0, True  # the open conversation, its pieces so far, and whether it may have begun before

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "conv", "turn", "role", "text", "initial", "fault", "present")]
            for key, conv, turn, role, text, initial, fault, present in zip(*columns):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.part(part, seq) if first or seq else now.whole())
                        held += now.bytes if first or seq else 0
                        first = False
                    now, seq = _Piece(key, conv), 0
                elif len(now.roles) >= PIECE_ROWS or now.bytes >= PIECE_BYTES:
                    out.append(now.part(part, seq))
                    held += now.bytes
                    now.clear()
                    seq += 1
                if present:
                    now.add(turn, role, text, initial, fault)
                if held > PIECE_BYTES or len(out) >= 4096:
                    yield _batch(out, out_schema)
                    out, held = [], 0
        if now is not None:
            out.append(now.part(part, seq))
        yield _batch(out, out_schema)

    return run


def _rows_of(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _chunked(rows, schema: pa.Schema, size: int = 4096, weight=None):
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += weight(r) if weight else 0
        if len(out) >= size or held > PIECE_BYTES:
            yield _batch(out, schema)
            out, held = [], 0
    yield _batch(out, schema)


def _marked(faults: str, again) -> str:
    if not again:
        return faults
    letters = list(faults)
    for i in again:
        letters[i] = AGAIN
    return "".join(letters)


def _matrices(schema):
    def run(batches):
        def rows():
            for key, part, seq, initials, faults, again in _rows_of(batches, ("key", "part", "seq", "initials", "faults", "again")):
                faults = _marked(faults, again)
                symbols = "".join(map(symbol, initials, faults))
                yield key, part, seq, symbols, [x for row in matrix(symbols) for x in row]

        yield from _chunked(rows(), _arrow(schema))

    return run


def _backward(schema):
    """Costs to go after each piece, over the pieces of a conversation from its last one on."""

    def run(batches):
        def rows():
            now, after = None, END
            for key, part, seq, symbols, m in _rows_of(batches, ("key", "part", "seq", "symbols", "matrix")):
                if key != now:
                    now, after = key, END
                here = after
                v = times(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), after)
                after = v
                low = min(here)
                yield key, part, seq, [x - low for x in here], v[START], [walk(symbols, s, least(here))[1] for s in range(4)]

        yield from _chunked(rows(), _arrow(schema))

    return run


def _forward(schema):
    """The state in which each piece begins."""

    def run(batches):
        def rows():
            now, state = None, START
            for key, part, seq, after, cost, ends in _rows_of(batches, ("key", "part", "seq", "after", "cost", "ends")):
                begins = key != now
                if begins:
                    now, state = key, START
                yield key, part, seq, after, cost if begins else 0, state
                state = ends[state]

        yield from _chunked(rows(), _arrow(schema))

    return run


def _said(schema):
    """Every piece's edits, repaired text and counts."""

    def run(batches):
        names = ("key", "part", "seq", "first_turn", "last_turn", "n_turns", "initials", "faults", "roles", "texts", "again", "after", "cost", "state")

        def rows():
            for key, part, seq, first, last, n, initials, faults, roles, texts, again, after, cost, state in _rows_of(batches, names):
                faults = _marked(faults, again)
                edits, end = walk("".join(map(symbol, initials, faults)), state, tuple(after))
                lines = applied(edits, state, roles, texts, initials)
                yield (key, part, seq, first, last, n, initials[:1], initials[-1:], faults.count(BLANK), faults.count(AGAIN), faults.count(CUT), illegal(initials),
                       cost, edits, end, "\n".join(lines) if lines else None)

        yield from _chunked(rows(), _arrow(schema), weight=lambda r: len(r[-1] or ""))

    return run


def _tied(schema):
    """One row a conversation from its pieces in order; texts only pass through the hash."""
    names = ("key", "first_turn", "last_turn", "n_turns", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "end", "said")

    def run(batches):
        def rows():
            now = None

            def result():
                audit.append(tail(end))
                state = end
                for _ in audit[-1]:
                    state = FORCED[state]
                    said(f"{ROLE[state]}:")
                return now, (high - low + 1 - turns if turns else 0), *counts, cost, "".join(audit), sha.hexdigest()

            def said(text):
                nonlocal spoken
                sha.update((("\n" if spoken else "") + text).encode("utf-8", "surrogatepass"))
                spoken = True

            for key, first, last, n, one, other, blank, duplicate, truncated, wrong, paid, edits, to, text in _rows_of(batches, names):
                if key != now:
                    if now is not None:
                        yield result()
                    now, sha, spoken, audit, counts, cost, turns, low, high, before, end = key, hashlib.sha256(), False, [], [0] * 4, 0, 0, None, None, "", START
                counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, wrong + (bool(before and one) and before + one not in LEGAL)))]
                before = other or before
                if n:
                    turns += n - (high is not None and first == high)
                    low, high = first if low is None else low, last
                cost += paid
                audit.append(edits)
                end = to
                if text is not None:
                    said(text)
            if now is not None:
                yield result()

        yield from _chunked(rows(), _arrow(schema))

    return run


def _fields(text: str) -> list[T.StructField]:
    return T.StructType.fromDDL(text).fields


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then by the hash of their
    text, equal rows beside each other. Null roles and texts count as one space, a null id is a conversation of
    its own. Rows for which ``present`` is not true only name their conversation: one without other rows, like
    one that loses all its rows, has an empty repaired text, whose hash is that of the empty string, and the
    former zeros and an empty audit. A row is blank if all its characters are spaces or of 0x09 to 0x0D, else a
    duplicate if its role and text stood earlier, else truncated if its last other character isn't one of
    ``.!?``. gaps counts the missing turns between the least and the greatest; illegal the adjacent role initials
    that are not su, ua or au. audit has the cheapest edits in order (Keep 0, Rerole 3, Delete 4, Insert 3, each
    truncated row that stays 3 more; blank rows and duplicates are deleted), the ASCII-least of equal cost.
    Other columns are not read; no rows give no rows.
    """
    ship(rows.sparkSession)
    conv_type = rows.schema[conv_col].dataType
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    conv = F.col(conv_col)
    told = rows.select(
        F.concat(F.when(conv.isNull(), "-").otherwise("+"), F.coalesce(conv.cast("string"), F.lit(""))).alias("key"), conv.alias("conv"),
        F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    told = told.select("key", "conv", "turn", "role", F.when(F.col("present"), F.col("text")).otherwise("").alias("text"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
                       F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault"), "present",
                       F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("nth")]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark", "nth")
    head = [T.StructField("key", T.StringType()), T.StructField("conv", conv_type)]
    schema = T.StructType([*head, *_fields(_COUNTS), *_fields(_PIECE)])
    both = saved(dealt.mapInArrow(_pieces(schema), schema), "conversations")
    counts = [f.name for f in _fields(_COUNTS)]
    done = both.where("seq is null").select(F.col("conv").alias(conv_col), *counts)

    place = ["key", "part", "seq"]
    pieces = both.where("seq is not null")
    # texts seen in an earlier piece of their conversation
    marks = pieces.select(*place, F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    firsts = marks.groupBy("key", "digest").agg(F.min(F.struct("part", "seq")).alias("least"), F.count("*").alias("many")).where("many > 1").select("key", "digest", "least")
    later = marks.join(firsts, ["key", "digest"]).where(F.struct("part", "seq") != F.col("least"))
    again = saved(later.groupBy(*place).agg(F.collect_list("at").alias("again")), "conversation-repeats")  # at most PIECE_ROWS each
    light = pieces.select(*place, "initials", "faults").join(again, place, "left")
    schema = T.StructType(_fields("key string, part int, seq int, symbols string, matrix array<long>"))
    steps = light.mapInArrow(_matrices(schema), schema)
    schema = T.StructType(_fields("key string, part int, seq int, after array<long>, cost long, ends array<int>"))
    back = steps.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq")).mapInArrow(_backward(schema), schema)
    # what a conversation costs stands at its first piece
    schema = T.StructType(_fields("key string, part int, seq int, after array<long>, cost long, state int"))
    begun = saved(back.repartition("key").sortWithinPartitions(*place).mapInArrow(_forward(schema), schema), "conversation-states")
    schema = T.StructType(_fields("key string, part int, seq int, first_turn long, last_turn long, n_turns long, first_initial string, last_initial string, blank long, duplicate long, "
                                  "truncated long, illegal long, cost long, edits string, end int, said string"))
    spoken = pieces.drop("conv", "digests", *counts).join(again, place, "left").join(begun, place).mapInArrow(_said(schema), schema)
    schema = T.StructType([head[0], *_fields(_COUNTS)])
    tied = spoken.repartition("key").sortWithinPartitions(*place).mapInArrow(_tied(schema), schema)
    named = F.when(F.substring("key", 1, 1) == "+", F.expr("substring(key, 2)")).cast(conv_type).alias(conv_col)
    return done.unionByName(tied.select(named, *counts))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by the crc32 of ``conv_id:turn`` modulo 20, nulls as one space: 0 drops the row
    (``present`` is false), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = (F.crc32(F.concat(plain["conv_id"], F.lit(":"), plain["turn"])) % 20).alias("kind")
    rows = rows.select("conv_id", "turn", plain["role"].alias("role"), plain["text"].alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")
