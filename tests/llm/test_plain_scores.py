"""Scores of operators 8 and 10 against plain loops over one row at a time."""

import math
import re
import zlib

import numpy as np
import pytest

from panelstack.llm import quality_rules as Q
from panelstack.llm import text as T
from panelstack.llm import toxicity as X

from .test_operators import toxic_rows


def slot(gram: bytes, n: int) -> int:
    """The hash of one n-gram, byte by byte."""
    h = 0
    for i, b in enumerate(gram):
        h = (h + int(T._BYTE[b]) * pow(T._BASE, i, 2**64)) % 2**64
    return int(T.mix(np.array([(h + n) % 2**64], np.uint64))[0]) >> (64 - X.BITS)


def plain_score(model, text):
    logits = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        padded = b" " + word + b" "
        values = [float(model.value[slot(padded[i : i + n], n)]) for n in X.GRAMS for i in range(len(padded) - n + 1)]
        logits.append(sum(values) / max(len(values), 1))
    best = sorted(logits, reverse=True)[: model.top]
    return 1 / (1 + math.exp(-(sum(best) / max(len(best), 1) + model.bias)))


def test_toxicity_scores(spark):
    rows = [(i, t) for i, t, _ in toxic_rows(n=120)] + [(900, None), (901, ""), (902, "é ß 😀 12 a"), (903, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows(n=120)], "doc_id long, toxic int")
    model = X.train(X.sample(docs, labels, X.Training(epochs=8), ~X.held_out()), X.Training(epochs=8))
    assert model.trained
    texts = dict(rows)
    got = X.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        p = plain_score(model, texts[r.doc_id])
        assert r.score == pytest.approx(p, abs=1e-6) and (abs(p - 0.7) < 1e-6 or r.predicted == int(p >= 0.7))
    whole = {r.doc_id: r.held_out for r in X.toxicity(docs, labels).collect()}
    assert whole == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}


def plain_posteriors(votes):
    """Expectation-maximisation one document at a time; votes are 0, 1 or -1."""
    rules = len(votes[0])
    start = {0: (0.3, 0.005), 1: (0.4, 0.7), -1: (0.3, 0.295)}  # bad, good
    table = [{v: list(start[v]) for v in start} for _ in range(rules)]
    share, last = 0.85, -math.inf

    def weights(row):
        bad, good = math.log(1 - share), math.log(share)
        for r, v in enumerate(row):
            bad, good = bad + math.log(table[r][v][0]), good + math.log(table[r][v][1])
        top = max(bad, good)
        return top, math.exp(bad - top), math.exp(good - top)

    for _ in range(200):
        parts = [weights(row) for row in votes]
        likelihood = sum(top + math.log(b + g) for top, b, g in parts) / len(votes)
        good = [g / (b + g) for _, b, g in parts]
        for r in range(rules):
            new = {v: [2.0 * start[v][0] + sum(1 - g for g, row in zip(good, votes) if row[r] == v), 2.0 * start[v][1] + sum(g for g, row in zip(good, votes) if row[r] == v)] for v in start}
            both = [sum(new[v][c] for v in new) for c in (0, 1)]
            table[r] = {v: [new[v][0] / both[0], new[v][1] / both[1]] for v in new}
        share = (sum(good) + 0.85 * 2.0) / (len(votes) + 2.0)
        if likelihood - last < 1e-9:
            break
        last = likelihood
    return [g / (b + g) for _, b, g in map(weights, votes)]


def test_quality_posteriors(docs, rows):
    rules = Q.rules()
    counted = Q.features(docs, "doc_id", "text").select("doc_id", "n_words", "word_chars", *(v.alias(f"_{n}") for n, v in rules.items()))
    voted = [tuple(r) for r in counted.collect()]
    votes = [tuple(-1 if v is None else int(v) for v in r[3:]) for r in voted]
    got = Q.quality(docs).collect()
    for a, b in zip(sorted((str(r.doc_id), r.n_words, r.word_chars, r.posterior) for r in got), sorted((str(r[0]), r[1], r[2], p) for r, p in zip(voted, plain_posteriors(votes)))):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-7)
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got)
