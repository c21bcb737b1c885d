"""URL rules by a bit-parallel wildcard automaton (operator 7).

All glob patterns lie one after another in a bit field of as many 64-bit words as needed. A bit stands for
"this much of the pattern is read"; reading a character shifts the whole field by one, masks it with the
character's table (Shift-And), and keeps the bits before a ``*`` as they are. One pass over a URL thereby runs
all patterns at once, and a batch of URLs advances together, a column of characters at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: URLs that advance together; they are sorted by length, so few steps are idle.
TOGETHER = 8192


class GlobSet:
    """Globs over bytes: ``*`` any run, ``?`` any byte, a backslash takes the next character as it is."""

    def __init__(self, globs: list[str]):
        self.globs = globs
        symbols: list[tuple[int, list]] = []
        state = 0
        loops, begins, finals = [], [], []
        for g in globs:
            begins.append(state)
            at, raw = 0, g.encode()
            while at < len(raw):
                c = raw[at]
                if c == ord("*"):
                    loops.append(state)
                else:
                    if c == ord("\\") and at + 1 < len(raw):
                        at += 1
                        c = raw[at]
                        symbols.append((state + 1, [c]))
                    else:
                        symbols.append((state + 1, list(range(256)) if c == ord("?") else [c]))
                    state += 1
                at += 1
            finals.append(state)
            state += 1
        self.words = max(1, -(-state // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop, self.begin = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for s, chars in symbols:
            for c in chars:
                self.step[c, s // 64] |= np.uint64(1) << np.uint64(s % 64)
        for s in loops:
            self.loop[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        for s in begins:
            self.begin[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        self.final = np.array(finals, np.int64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob, whether the glob matches the whole text."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        by_length = np.argsort([len(t) for t in texts], kind="stable")
        for a in range(0, len(texts), TOGETHER):
            rows = by_length[a : a + TOGETHER]
            size = np.array([len(texts[r]) for r in rows])
            raw = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            state = np.repeat(self.begin[None], len(rows), axis=0)
            for i in range(int(size[-1]) if len(size) else 0):
                live = np.searchsorted(size, i, "right")  # shorter ones are done
                now = state[live:]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[live:] = (moved & self.step[raw[first[live:] + i]]) | (now & self.loop)
            out[rows] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1) > 0
        return out


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{_plain(self.host)}#{_plain(self.path)}*"


def _plain(s: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in s)


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
#: Where no rule fits: blocked if one of these matches the canonical form ``.host#path``, lower-cased.
BLOCK_GLOBS = ["*.spam*#*", "*-farm.*#*", "*-pills.*#*", "*cheap-*#*", "*casino*#*", "*#*/wp-login*", "*#*/cgi-bin/*", "*#*.exe"]


def host_path(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min([i for i in (rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {i: i + 32 for i in range(65, 91)}


def judge(pages: DataFrame, rules: list[Rule] = RULES, block_globs: list[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (its host and path, or null), verdict.

    Rules and globs are patterns over the canonical form ``.host#path``: neither part can hold a ``#``, so a
    rule's host ends where the host ends. Of the rules that fit the longest wins (the first of equals). Where
    none fits, a URL is blocked if a glob matches, else allowed. Null, empty and odd URLs have empty parts, fit
    no rule and are judged by the globs; repeated rows each get their row; other columns are not read. The
    rules are parameters, whatever the size of the table.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def run(batches):
        globs = GlobSet([r.glob for r in ranked] + block_globs)
        names = pa.array([r.name for r in ranked], pa.string())
        verdicts = pa.array([r.verdict for r in ranked] + ["allow", "block"], pa.string())
        k = len(ranked)
        for batch in batches:
            parts = [host_path(u) for u in batch.column(1).to_pylist()]
            exact = globs.match([f".{h}#{p}".encode() for h, p in parts])
            folded = globs.match([f".{h}#{p.translate(_LOWER)}".encode() for h, p in parts])[:, k:].any(1)
            fits = exact[:, :k]
            rule = np.where(fits.any(1), fits.argmax(1), -1) if k else np.full(len(parts), -1)
            chosen = np.where(rule >= 0, rule, k + folded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pc.take(names, pa.array(rule, mask=rule < 0)), pc.take(verdicts, pa.array(chosen))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
