"""Quality rules combined by weak supervision (operator 10).

Every rule votes good (1), bad (0) or abstains (-1) on a document. Expectation-maximisation over the vote
patterns of all documents estimates each rule's accuracy on good and on bad documents and the share of good
ones; a document is kept when the posterior probability of being good reaches a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import saved

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CONTINUATION = np.array([b & 0xC0 == 0x80 for b in range(256)])
ENDS = np.zeros(256, bool)
ENDS[list(b".!?:;\"'")] = True
UPPER, LOWERCASE = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LOWERCASE[97:123] = True
LETTERS = UPPER | LOWERCASE | (np.arange(256) >= 128)
REPEAT_WORDS = 3

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper", "n_ended_words", "n_plain_words", "n_bare_symbols"]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _covered(keys: np.ndarray, first: np.ndarray, rows: np.ndarray, width: int, words: int) -> np.ndarray:
    """Flags the words inside windows (key, first word, row) whose key comes twice or more in the row."""
    covered = np.zeros(words, bool)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = first[order[same[1:] | same[:-1]]]
    for i in range(width):
        covered[twice + i] = True
    return covered


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts in FEATURES of every whole text; null and empty texts have zeros."""

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in FEATURES]
            for _, n, data, at in T.chunks(batch.column(1)):
                raw, starts, ends, rows = T.find_words(data, at)
                words = T.word_hashes(raw, starts, ends)
                count = T.row_counts(rows, n)
                begins = np.zeros(len(raw), bool)
                begins[starts] = True
                at_words = np.concatenate([[0], np.cumsum(count)])
                # windows of words
                covered = np.zeros(len(words), bool)
                if len(words) >= REPEAT_WORDS:
                    first = np.flatnonzero(rows[: len(words) - REPEAT_WORDS + 1] == rows[REPEAT_WORDS - 1 :])
                    hashes, _ = T.shingle_hashes(words, rows, n, REPEAT_WORDS, whole=False)
                    covered = _covered(hashes, first, rows[first], REPEAT_WORDS, len(words))
                # lines
                dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
                feeds = np.flatnonzero(raw == 10)
                edges = np.union1d(feeds + 1, at)
                line_start = edges[:-1][edges[:-1] < len(raw)] if len(raw) else edges[:0]
                line_stop = np.append(line_start[1:], len(raw))
                if len(line_start):
                    body_stop = line_stop - (raw[line_stop - 1] == 10)
                    line_row = np.searchsorted(at, line_start, "right") - 1
                    with_word = _sums(begins, np.append(line_start, len(raw))) > 0
                    body = T.word_hashes(raw, line_start, body_stop)
                    body, line_row = body[with_word], line_row[with_word]
                    order = np.lexsort((body, line_row))
                    again = np.zeros(len(body), bool)
                    again[1:] = (body[order][1:] == body[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
                    dup, lines = T.row_counts(line_row[order][again], n), T.row_counts(line_row, n)
                order = np.lexsort((words, rows))
                fresh = np.ones(len(words), bool)
                fresh[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                ended = ENDS[raw[ends - 1]] if len(ends) else np.zeros(0, bool)
                letters = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(LETTERS[raw], out=letters[1:])
                in_word = letters[ends] - letters[starts]
                plain = (in_word > 0) & (in_word >= ends - starts - 1)  # letters and at most one mark
                chars = T.NOT_SPACE[raw] & ~CONTINUATION[raw]
                for o, x in zip(out, (count, _sums(chars, at), _sums(SYMBOLS[raw], at), dup, lines, _sums(covered, at_words), T.row_counts(rows[order][fresh], n), _sums(LETTERS[raw] & ~CONTINUATION[raw], at), _sums(UPPER[raw], at), _sums(ended, at_words), _sums(plain, at_words), _sums(in_word == 0, at_words))):
                    o.append(np.asarray(x, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out)], names=["doc_id", *FEATURES])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1).cast("byte")


def rules() -> dict[str, Column]:
    """Votes on a row of FEATURES: 1 good, 0 bad, -1 abstain. Products keep to integers, so ties are exact."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 60),
        "word_length": _vote((c("word_chars") < 2.5 * words) | (c("word_chars") > 12 * words), c("word_chars").between(3.5 * words, 9 * words)),
        "symbols": _vote(c("n_symbols") * 10 > words, c("n_symbols") * 100 <= words),
        "plain_words": _vote(c("n_plain_words") * 100 < 70 * words, c("n_plain_words") * 100 >= 90 * words),
        "bare_symbols": _vote(c("n_bare_symbols") * 100 > 10 * words, c("n_bare_symbols") * 100 <= 3 * words),
        "duplicate_lines": _vote(c("n_dup_lines") * 10 > 3 * F.greatest("n_lines", F.lit(1)), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        "repeated_words": _vote(c("n_repeat_words") * 100 > 30 * words, c("n_repeat_words") * 100 <= 5 * words),
        "variety": _vote((c("n_words") >= 50) & (c("n_distinct_words") * 100 < 20 * words), c("n_distinct_words") * 100 >= 35 * words),
        "letters": _vote(c("n_letters") * 100 < 80 * F.greatest("word_chars", F.lit(1)), c("n_letters") * 100 >= 93 * F.greatest("word_chars", F.lit(1))),
        "capitals": _vote(c("n_upper") * 100 > 40 * F.greatest("word_chars", F.lit(1)), c("n_upper") * 100 <= 10 * F.greatest("word_chars", F.lit(1))),
        "sentences": _vote(c("n_ended_words") * 100 < words, c("n_ended_words").between(0.01 * words, 0.35 * words)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 2.0) -> tuple[np.ndarray, float]:
    """(probability of each vote given bad or good, share of good) by expectation-maximisation.

    ``patterns`` has a row per distinct vote pattern (-1, 0, 1), ``counts`` how many documents show it. The
    start says that a rule seldom votes bad on a good document but often has nothing against a bad one, as each
    rule knows one fault; ``prior`` counts of that opinion keep every probability off 0 and 1.
    """
    rules = patterns.shape[1]
    start = np.array([[0.3, 0.005], [0.4, 0.7], [0.3, 0.295]])  # rows: vote 0, vote 1, abstain; columns: bad, good
    table = np.repeat(start[None], rules, axis=0)
    share = 0.85
    votes = np.where(patterns < 0, 2, patterns)
    counts = counts.astype(np.float64)
    total = max(counts.sum(), 1.0)
    last = -math.inf
    for _ in range(rounds):
        log = np.log(table)[np.arange(rules)[None], votes].sum(1) + np.log([1 - share, share])
        top = log.max(1, keepdims=True)
        weight = np.exp(log - top)
        likelihood = float((counts * (np.log(weight.sum(1)) + top[:, 0])).sum() / total)
        good = weight[:, 1] / weight.sum(1) * counts
        bad = counts - good
        for r in range(rules):
            for v in range(3):
                there = votes[:, r] == v
                table[r, v] = [bad[there].sum() + prior * start[v, 0], good[there].sum() + prior * start[v, 1]]
            table[r] /= table[r].sum(0)
        share = float((good.sum() + 0.85 * prior) / (total + prior))
        if likelihood - last < 1e-9:
            break
        last = likelihood
    return table, share


def posterior(table: np.ndarray, share: float, votes: dict[str, Column]) -> Column:
    """Probability of good: a logistic of the sum of the votes' log-likelihood ratios."""
    ratio = np.log(table[:, :, 1]) - np.log(table[:, :, 0])
    score = F.lit(math.log(share / (1 - share)))
    for (name, vote), r in zip(votes.items(), ratio):
        score = score + F.when(vote == 0, float(r[0])).when(vote == 1, float(r[1])).otherwise(float(r[2]))
    return 1 / (1 + F.exp(-score))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, make_rules: Callable[[], dict[str, Column]] = rules) -> DataFrame:
    """Per row: doc_id, the FEATURES, posterior double, base_failed, kept.

    Words are runs of non-white-space of the whole text (null: none). base_failed: fewer than 50 words, or more
    than half of the words in repeated 3-word windows. kept: base holds and the posterior is at least
    ``threshold``. The votes are counted over all rows, repeated ones included; only the counts of distinct
    patterns (3 to the power of the rules at most) come to the driver. An empty table gives no rows.
    """
    counted = saved(features(docs, id_col, text_col), "quality-features")  # a few numbers a row, read twice
    votes = make_rules()
    names = list(votes)
    seen = counted.select(*(v.alias(n) for n, v in votes.items())).groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in seen], np.int64).reshape(len(seen), len(names))
    table, share = fit(patterns, np.array([r["count"] for r in seen], np.int64))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = posterior(table, share, votes)
    return counted.select("doc_id", *FEATURES, good.alias("posterior"), base_failed.alias("base_failed"), (~base_failed & (good >= threshold)).alias("kept"))
