"""Vectorised words and shingles over Arrow string columns.

Texts are handled in chunks of about a quarter of a megabyte (one text is never cut), so memory follows the longest
text, not the batch. Words and shingles are known by 64-bit hashes: words by a polynomial over their bytes
(mod 2^64, random byte values), shingles by a mix of their words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_SPACE = bytes(range(9, 14)) + b" "
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SAME = bytes(range(256))
#: Word characters: everything but white space.
NOT_SPACE = np.array([b not in _SPACE for b in range(256)])
#: Word characters after lower-casing: digits, a-z and all of non-ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n and its inverses, grown as longer texts come."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, rows, their bytes joined, offsets of each row and the end). Null counts as empty."""
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    elif not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last - first, bytes(data[at[first] : at[last]]), at[first : last + 1] - at[first]
        first = last


def find_words(data: bytes, at: np.ndarray, table: bytes = SAME, is_word: np.ndarray = NOT_SPACE):
    """Bytes after ``table``, word starts and ends, and the row of each word; words end with their row."""
    raw = np.frombuffer(data.translate(table) if table is not SAME else data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none, none
    inside = is_word[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return raw, starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int, k: int, whole: bool = True):
    """(hash, row) of every window of k words; with ``whole``, a row of fewer words has them all as one window."""
    if not len(words):
        return words, rows
    size = np.zeros(len(words), bool)
    h = words * _PLACE[0]
    if len(words) >= k:
        body = h[: len(words) - k + 1].copy()
        for i in range(1, k):
            body += words[i : len(words) - k + 1 + i] * _PLACE[i]
        size[: len(words) - k + 1] = rows[: len(words) - k + 1] == rows[k - 1 :]
        out, where = mix(body[size[: len(body)]]), rows[np.flatnonzero(size)]
    else:
        out, where = words[:0], rows[:0]
    if whole:
        count = row_counts(rows, n)
        first = np.concatenate([[0], np.cumsum(count)])
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.array([np.add.reduce(words[first[r] : first[r + 1]] * _PLACE[: count[r]], dtype=np.uint64) + np.uint64(count[r]) for r in short], np.uint64)
            out, where = np.concatenate([out, mix(extra)]), np.concatenate([where, short])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, where


def shingle_sets(data: bytes, at: np.ndarray, k: int, table: bytes = LOWER, is_word: np.ndarray = NOT_SPACE):
    """The sorted distinct shingle hashes of every row of a chunk."""
    n = len(at) - 1
    raw, starts, ends, rows = find_words(data, at, table, is_word)
    hashes, where = shingle_hashes(word_hashes(raw, starts, ends), rows, n, k)
    first = np.concatenate([[0], np.cumsum(row_counts(where, n))])
    for r in range(n):
        yield np.unique(hashes[first[r] : first[r + 1]])
