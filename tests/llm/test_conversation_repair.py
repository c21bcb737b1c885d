"""Operator 11 against a plain forward DP over whole strings of edits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelstack.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, cost string, present int"
ROLES = {"u": "user", "a": "assistant"}


def plain_edits(rows):
    """(cost, audit, lines): the best (cost, audit) of every way into each state, row by row."""

    def grow(best):  # any number of insertions
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 3, audit + "I", (*lines, f"{ROLES[to]}:"))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", ())}
    for role, text, fault in rows:
        best = grow(best)
        found = defaultdict(list)
        for state, (cost, audit, lines) in best.items():
            found[state].append((cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            i = role[:1]
            if (state, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                found[i].append((cost + more, audit + "K", (*lines, f"{role}:{text}")))
            to = "a" if state == "u" else "u"
            found[to].append((cost + more + 3, audit + "R", (*lines, f"{ROLES[to]}:{text}")))
        best = {s: min(x) for s, x in found.items()}
    best = grow(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows, damage):
    """The contract, by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        here = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        here += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows = set(), []
        for _, role, text in here:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = {t for t, _, _ in here if t is not None}
        count = Counter(f for _, _, f in rows)
        initials = [r[:1] for r, _, _ in rows]
        cost, audit, lines = plain_edits(rows)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
               sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(0, 14)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "sys", "User"])
            text = rng.choice(["Yes.", "No", "no!\n", " \t", "", None, "ok?", f"t{rng.random()}.", f"t{rng.random()}", "é 😀\x00.", "a\x85"])
            rows.append((c, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 7])
    rows += [(None, 1, "user", "Hm."), (None, 2, "assistant", "Hm."), (None, None, "system", "S."), (5000, None, None, None), (5001, None, "user", "x."), (5001, None, "assistant", "y.")]
    rows += [(6000, t, "user" if t % 3 else "assistant", "Same." if t % 2 else f"{t}.") for t in range(700)]  # one long conversation
    rows += [(6001, 4, "user", "Row.")] * 60 + [(6001, 5, "assistant", "w " * 30_000)]
    return rows


@pytest.mark.parametrize("piece", [R.PIECE_ROWS, 7])
@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, monkeypatch, damage, piece):
    monkeypatch.setattr(R, "PIECE_ROWS", piece)
    rows = conversations()
    df = spark.createDataFrame([(*r, "k", 1, "c", 0) for r in rows], SCHEMA).repartition(5)
    got = R.repair(R.damaged(df), present=F.col("present")) if damage else R.repair(df)
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, damage))


def test_pieces_far_apart(spark, monkeypatch):
    """Partitions cut conversations anywhere: every piece is one row."""
    monkeypatch.setattr(R, "PIECE_ROWS", 1)
    rows = [r for r in conversations(n=40) if r[0] != 6000]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, R.repair(df).collect())) == Counter(plain(rows, False))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert R.repair(R.damaged(empty), present=F.col("present")).count() == 0
    gone = spark.createDataFrame([("c", 1, "user", "Hi.")], empty.schema)
    assert [tuple(r) for r in R.repair(gone, present=F.lit(False)).collect()] == [("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_runs_equal_rows():
    """Powers and unrolled halves give what rows one by one give."""
    rng = random.Random(1)
    texts = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(400):
        symbols = "".join(rng.choice("suaxSUAXd") * rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randrange(0, 6)))
        rows = [(texts.get(x.lower(), "user"), str(i), "blank" if x == "d" else "truncated" if x.isupper() else "") for i, x in enumerate(symbols)]
        assert R.solved(symbols) == plain_edits(rows)[:2]
    cost, audit = R.solved("u" * 100_000)
    assert cost == 150_000 and audit == "KR" * 50_000  # every second row becomes an assistant


def test_query(spark):
    from panelstack.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, True))
