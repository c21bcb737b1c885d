import random

import numpy as np
import pyarrow as pa

from panelstack.llm import text as T
from panelstack.llm.graph import components
from panelstack.llm.store import sorted_groups

from . import brute


def test_words_across_chunks(rows):
    texts = [t for _, t in rows]
    for size in (1, 300, 1 << 20):
        got = {}
        for first, n, data, at in T.chunks(pa.array(texts), size):
            raw, starts, ends, where = T.find_words(data, at)
            for a, b, r in zip(starts, ends, where):
                got.setdefault(first + r, []).append(raw[a:b].tobytes())
        assert [got.get(i, []) for i in range(len(texts))] == [brute.words(t) for t in texts]


def test_chunks_of_sliced_and_large_arrays():
    a = pa.array(["x", None, "yy", "", "z"])
    for arr in (a, a.cast(pa.large_string())):
        s = arr.slice(1, 3)
        assert [(f, n, d, at.tolist()) for f, n, d, at in T.chunks(s)] == [(0, 3, b"yy", [0, 0, 2, 2])]
    assert list(T.chunks(pa.array([], pa.string()))) == []


def test_equal_words_have_equal_hashes():
    data = b"ab cd ab  abcd cd"
    raw, s, e, _ = T.find_words(data, np.array([0, len(data)]))
    h = T.word_hashes(raw, s, e).tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7)]
    groups = brute.Sets({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    least = {}
    for x in sorted(groups.parent):
        least.setdefault(groups.find(x), x)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, least[groups.find(x)]) for x in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sorted_groups():
    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5]
    t = pa.table({"k": keys, "v": list(range(9))})
    for size in (1, 2, 3, 9):
        got = [(g.column("k")[0].as_py(), g.column("v").to_pylist()) for g in sorted_groups(iter(t.to_batches(max_chunksize=size)), ["k"])]
        assert got == [(1, [0, 1]), (2, [2]), (3, [3, 4, 5]), (4, [6]), (5, [7, 8])]
