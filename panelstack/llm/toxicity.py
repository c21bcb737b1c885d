"""Toxicity scores from subword-bag embeddings and a linear softmax (operator 8).

A word is the bag of its character n-grams (with its ends marked) and its vector the average of their
embeddings; a linear softmax over that vector says how toxic the word is. An average over a whole text would
drown a few words in thousands, so a text's logit is the average over its most toxic words. Embeddings and
softmax are trained together in numpy on a bounded sample of labelled texts. Misspelt and unseen words share
n-gram vectors with seen ones. Scoring needs only each n-gram's projection on the softmax, a table of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

GRAMS = (3, 4, 5, 6, 8)
BITS = 18
WORDS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Training:
    """``per_class``: at most so many labelled texts of each class are used, those with the smallest hashes."""

    per_class: int = 2000
    size: int = 8
    top: int = 3
    epochs: int = 70
    rate: float = 0.3
    decay: float = 1e-4
    positive_weight: float = 2.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    value: np.ndarray  # by n-gram: softmax logit of its embedding, toxic less clean
    bias: float
    top: int
    trained: bool


def _marked(data: bytes, at: np.ndarray):
    """Lower-cased bytes, a blank after each text and every other byte than a letter or digit blank, and the words'
    places."""
    if len(at) > 2:  # without it a text's last n-grams would hold the first letter of the next one
        data = b" ".join(data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
        at = at + np.append(np.arange(len(at) - 1), len(at) - 2)
    raw = np.frombuffer(data.translate(T.LOWER), np.uint8)
    raw = np.where(T.ALNUM[raw], raw, 32).astype(np.uint8)
    _, starts, ends, rows = T.find_words(raw.tobytes(), at, T.SAME, T.ALNUM)
    return raw, starts, ends, rows


def _grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n: the n-gram slots of all words (blank, word, blank), and the number of them before each word."""
    padded = np.concatenate([[32], raw, [32]]).astype(np.uint8)
    up, down = T.powers(len(padded))
    total = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(T._BYTE[padded] * up[: len(padded)], dtype=np.uint64, out=total[1:])
    first, length = starts, ends - starts + 2  # in padded, a word with its blanks begins at its own start
    for n in GRAMS:
        count = np.maximum(length - n + 1, 0)
        base = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first - base[:-1], count) + np.arange(base[-1])
        slot = T.mix((total[at + n] - total[at]) * down[at] + np.uint64(n)) >> np.uint64(64 - BITS)
        yield slot.astype(np.int64), base


def word_logits(value: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for slot, base in _grams(raw, starts, ends):
        sums = np.zeros(len(slot) + 1)
        np.cumsum(value[slot], out=sums[1:])
        total += sums[base[1:]] - sums[base[:-1]]
        count += np.diff(base)
    return total / np.maximum(count, 1)


def pooled(logits: np.ndarray, rows: np.ndarray, n: int, top: int):
    """(mean of the ``top`` largest logits of each row, chosen entries, their rows, how many of each row)."""
    order = np.lexsort((-logits, rows))
    count = T.row_counts(rows, n)
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    chosen = order[rank < top]
    taken = np.minimum(count, top)
    return np.bincount(rows[chosen], weights=logits[chosen], minlength=n) / np.maximum(taken, 1), chosen, rows[chosen], taken


def _slots_by_word(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram slots word after word, number of each word's)."""
    joined = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    counts = sum(np.maximum(sizes + 2 - n + 1, 0) for n in GRAMS)
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for slot, base in _grams(joined, ends - sizes, ends):
        many = np.diff(base)
        out[np.repeat(at - base[:-1], many) + np.arange(len(slot))] = slot
        at = at + many
    return out, counts


def train(samples: list[tuple[int, bytes]], how: Training) -> Model:
    """Fit on (label, text) pairs. Each text counts each of its distinct words once."""
    labels = np.array([y for y, _ in samples], np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS), 0.0, how.top, False)
    index: dict[bytes, int] = {}
    entries, rows = [], []
    for row, (_, text) in enumerate(samples):
        raw, starts, ends, _ = _marked(text, np.array([0, len(text)], np.int64))
        body = raw.tobytes()
        found = {body[a:b] for a, b in zip(starts.tolist(), ends.tolist())}
        entries.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found)))
        rows.append(np.full(len(found), row, np.int32))
    entries, rows = np.concatenate(entries), np.concatenate(rows)
    words = list(index)
    del index
    slots, counts = [], []
    for a in range(0, len(words), WORDS_AT_ONCE):
        s, c = _slots_by_word(words[a : a + WORDS_AT_ONCE])
        slots.append(s)
        counts.append(c)
    del words
    slots, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (slots, counts))
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    grams = np.maximum(counts, 1)

    def sums_by_word(value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(value[slots], first[some])
        return out

    rng = np.random.default_rng(how.seed)
    embedding = rng.normal(0, 0.1, (1 << BITS, how.size))
    softmax = rng.normal(0, 0.5, (how.size, 2))
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seen_e, seen_s, seen_b = np.full(embedding.shape, 1e-8), np.full(softmax.shape, 1e-8), 1e-8
    weight = np.where(labels == 1, how.positive_weight, 1.0)
    weight /= weight.sum()
    for _ in range(how.epochs):
        value = embedding @ (softmax[:, 1] - softmax[:, 0])
        word = sums_by_word(value.astype(np.float32)) / grams
        logit, chosen, where, taken = pooled(word[entries], rows, len(labels), how.top)
        error = (1 / (1 + np.exp(-(logit + bias))) - labels) * weight
        by_word = np.bincount(entries[chosen], weights=(error / np.maximum(taken, 1))[where], minlength=len(grams))
        used = np.flatnonzero(by_word)  # only the words that speak for their text learn
        span = first[used + 1] - first[used]
        part = np.repeat(first[used] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        mine, at = np.repeat(np.arange(len(used)), span), slots[part]
        vector = np.stack([np.bincount(mine, weights=embedding[at, j], minlength=len(used)) for j in range(how.size)], 1) / grams[used, None]
        push = np.stack([-by_word[used], by_word[used]], 1)
        to_softmax = vector.T @ push + how.decay * softmax
        to_vector = (push @ softmax.T) / grams[used, None]
        touched, back = np.unique(at, return_inverse=True)
        to_embedding = np.stack([np.bincount(back, weights=to_vector[mine, j], minlength=len(touched)) for j in range(how.size)], 1) + how.decay * 1e-2 * embedding[touched]
        seen_e[touched] += to_embedding**2
        embedding[touched] -= how.rate * to_embedding / np.sqrt(seen_e[touched])
        seen_s += to_softmax**2
        softmax -= how.rate * to_softmax / np.sqrt(seen_s)
        seen_b += error.sum() ** 2
        bias -= how.rate * error.sum() / np.sqrt(seen_b)
    return Model(embedding @ (softmax[:, 1] - softmax[:, 0]), bias, how.top, True)


def sample(docs: DataFrame, labels: DataFrame, how: Training, learn_from=None) -> list[tuple[int, bytes]]:
    """At most ``per_class`` labelled texts of each class; a doc_id labelled twice is toxic if either says so, one
    with several rows gives the text with the smallest hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if learn_from is not None:
        known = known.where(learn_from)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("toxic", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("toxic", "doc_id", F.col("least.text").alias("text"))
    return [(r.toxic, r.text.encode()) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator()]


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text. Null and empty texts have no words and get the model's
    base rate; an untrained model (no labels of both classes) scores 0. Repeated rows each get their row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for _, n, data, at in T.chunks(batch.column(1)):
                raw, starts, ends, rows = _marked(data, at)
                logit = pooled(word_logits(m.value, raw, starts, ends), rows, n, m.top)[0] + m.bias
                out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))) if m.trained else np.zeros(n))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training(), threshold: float = 0.7) -> DataFrame:
    """Train on the labelled rows that are not held out and score every row: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(sample(docs, labels, how, ~held_out()), how)
    return score(docs, model, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
