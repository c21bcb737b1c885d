"""Plain versions of the operators, from their definitions, for small tables."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode())


class Sets:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def shingles(text, k):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard(rows, k, percent):
    """(n_shingles, component_id, n_links) by place in ``rows`` of (id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    groups = Sets(range(len(rows)))
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[groups.find(i)] = min(least.get(groups.find(i), doc), doc)
    return [(len(sets[i]), rows[i][0] if not sets[i] else least.get(groups.find(i)), len(links[i])) for i in range(len(rows))]


def line_dedup(texts, min_texts, agree, order, depth=3):
    """Texts without recurring lines; ``order(tokens)`` is the tie-break of lines in a leaf."""
    any_ = b"<*>"

    def tokens(line):
        return tuple(any_ if re.search(rb"[0-9]", w) else w for w in words(line))

    seen = defaultdict(set)
    contexts = defaultdict(set)
    count = Counter()
    for t in texts:
        lines = [tokens(x) for x in (t or "").split("\n")]
        lines = [x for x in lines if x]
        first = {}
        for i, x in enumerate(lines):
            first.setdefault(x, (lines[i - 1] if i else None, lines[i + 1] if i + 1 < len(lines) else None))
        for x, c in first.items():
            seen[x].add(t)
            contexts[x].add(c)
            count[x] += 1
    leaves = defaultdict(list)
    for x in seen:
        leaves[len(x), x[:depth]].append(x)
    template = {}
    for members in leaves.values():
        found = []
        for x in sorted(members, key=lambda x: (-count[x], order(x))):
            best = max(found, key=lambda f: (sum(a == b and b != any_ for a, b in zip(f[1], x)), -f[2]), default=None)
            if best and sum(a == b and b != any_ for a, b in zip(best[1], x)) >= agree * len(x):
                best[1][:] = [a if a == b else any_ for a, b in zip(best[1], x)]
                template[x] = best[0]
            else:
                found.append((x, list(x), len(found)))
                template[x] = x
    by_text, by_context = defaultdict(set), defaultdict(set)
    for x, f in template.items():
        by_text[f] |= seen[x]
        by_context[f] |= contexts[x]
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        worded = [i for i, x in enumerate(lines) if tokens(x)]
        drop = [i for i in worded if min(len(by_text[template[tokens(lines[i])]]), len(by_context[template[tokens(lines[i])]])) >= min_texts]
        out.append((t, len(worded), 0) if not drop or len(drop) == len(worded) else ("\n".join(x for i, x in enumerate(lines) if i not in drop), len(worded), len(drop)))
    return out
