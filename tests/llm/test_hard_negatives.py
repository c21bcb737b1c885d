"""Operator 12 against all scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, block string, data int, nth string, score int, rank string"


def vectors(n=700, dim=9, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.6])
        rows.append((i, int(rng.integers(4)), [float(x) for x in (v / np.linalg.norm(v)).astype("f4")]))
    same = rows[20][2]
    rows += [(n + i, i % 3, same) for i in range(60)]  # copies, with ties between labels
    rows += [(n + 100, 1, None), (n + 101, None, same), (n + 102, 2, [0.1, float("nan")]), (n + 103, 2, [0.1, None]), (n + 104, 0, [float("inf")] * dim)]
    rows += [(n + 105, 1, []), (n + 106, 1, same[:4]), (None, 1, same), (None, 2, same), (None, 1, [0.0] * dim), rows[50], rows[50], rows[3], (n + 200, 77, same), (-100, 2, same), (-200, 3, [-x for x in same])]
    return rows


def plain(rows, asks, positives=5, negatives=5, low=80, high=100):
    v = [(i, y, [math.floor(256 * (x if abs(x) > 1e4 else np.float64(np.float32(x)))) for x in e]) for i, y, e in rows if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, y, e in v:
        if a is None or not asks(a):
            continue
        others = [(score(e, f), i, z) for i, z, f in v if i != a]
        for s, p, _ in sorted((o for o in others if o[2] == y), key=key)[:positives]:
            window = sorted((o for o in others if o[2] != y and low * s <= 100 * o[0] <= high * s), key=key)[:negatives]
            yield from ((a, p, rank, n, s, t) for rank, (t, n, _) in enumerate(window, 1))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 1, "n", 2, "r") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block,low,high,many", [(H.BLOCK_ROWS, 80, 100, 5), (97, 80, 100, 5), (300, 50, 120, 2), (97, -100, 40, 7)])
def test_mine(spark, monkeypatch, block, low, high, many):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "BATCH_ROWS", 40)
    rows = vectors()
    got = H.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, n_positives=many, n_negatives=many, low=low, high=high)
    expected = Counter(plain(rows, lambda i: i % 20 == 0, many, many, low, high))
    assert len(expected) > 100 and Counter(map(tuple, got.collect())) == expected


def test_few_rows(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, None, None)], [(0, 1, []), (1, 1, []), (2, 2, [])], [(0, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.45])], [(0, 1, [1e30, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 1.0])]):
        got = H.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
        cut = [(i, y, e and [min(x, H.LARGEST / 256) for x in e]) for i, y, e in rows]
        assert Counter(map(tuple, got)) == Counter(plain(cut, lambda i: i % 100 == 0))


def test_bounds_hold_and_save_work():
    """No row scores above its cell's bound, bounds descend, and clustered data need only some cells."""
    rng = random.Random(4)
    g = np.random.default_rng(4)
    centres = g.integers(-200, 200, (8, 10))
    x = centres[g.integers(0, 8, 3000)] + g.integers(-9, 10, (3000, 10))
    books = H.codebook(x[:, :5], H.CODEWORDS), H.codebook(x[:, 5:], H.CODEWORDS)
    block = H.Block(np.arange(3000), g.integers(0, 4, 3000), x.astype("<i4"), books)
    for _ in range(20):
        a = x[rng.randrange(3000)]
        bounds, rows = [], []
        for bound, begin, end in block.visits(a):
            assert (block.vectors[begin:end] @ a).max() <= bound
            bounds.append(bound)
            rows += range(begin, end)
        assert bounds == sorted(bounds, reverse=True) and sorted(rows) == list(range(3000))
        seen = 0
        for at, _ in block.batches(a, lambda: (x @ a).max() * 0.95):
            seen += len(at)
        assert seen < 1500


def test_query(spark):
    from panelstack.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_hard_negatives"](spark, sf)
    expected = Counter(plain(rows, lambda i: i % 100 == 0))
    assert Counter(map(tuple, got.collect())) == expected


def test_sql():
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, e) for i, y, e in con.sql("SELECT vec_id, label, embedding FROM embeddings").fetchall()]
    assert Counter(con.sql(H.SQL).fetchall()) == Counter(plain(rows, lambda i: i % 100 == 0))
