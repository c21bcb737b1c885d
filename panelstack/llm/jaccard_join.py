"""N-gram Jaccard self-join through prefix tokens and a prefix tree (operator 5).

Steps: (1) each text becomes the set of its distinct n-word shingles (64-bit hashes), known by a 64-bit
fingerprint, so copies form one class; (2) a fixed-size table of hashed document frequencies over all texts
gives the global order, rare first; (3) classes that share a token of their prefixes, have compatible sizes and
whose token histograms differ by no more than a link allows form candidate groups; (4) in each group the sets
are stored in a prefix tree and joined by one traversal that carries the overlaps of all probes, shared by all
sets below a node, and prunes subtrees by the remaining length. Groups beyond a token limit are cut into
blocks, and every pair of blocks is joined in its own task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .store import BROADCAST_ROWS, by_group, saved

SKETCH_BITS = 18
SKETCH_BLOCK = 4096
#: Sets of up to so many tokens are told apart by their histograms if they share nothing but a few tokens.
TELL_APART = 12_000
#: Tokens of one block of a group; a task holds two blocks.
BLOCK_TOKENS = 2_000_000


def least_overlap(x, y, percent: int):
    """The smallest intersection with which sets of sizes x and y link: 100 i >= percent (x + y - i)."""
    return -(-percent * (x + y) // (100 + percent))


def fingerprint(s: np.ndarray) -> int:
    """64 bits that depend on the set's elements and size only."""
    total = int(np.add.reduce(T.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15
    return int(T.mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])


def hist_bins(percent: int) -> int:
    """Bins of the histograms, a power of two. Two sets of n tokens without common ones differ by about
    1.13 sqrt(n bins) in all bins together; that must exceed the difference that a link allows."""
    allowed = 2 * (100 - percent) / (100 + percent)
    return 1 << min(12, max(6, math.ceil(math.log2(max(1.0, allowed**2 * TELL_APART / 1.27)))))


def _hist(s: np.ndarray, bins: int) -> bytes:
    """Counts mod 256 of the tokens by some bits of their hashes."""
    return np.bincount(((s >> np.uint64(20)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8).tobytes()


def _sketch_slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(words: int, bins: int):
    """Per row its set's size, fingerprint and histogram; at the end the partition's token counts."""
    names = ["doc_id", "carried", "mark", "n", "cid", "hist", "block", "counts"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, cid, hist = [], [], []
            for _, _, data, at in T.chunks(batch.column("text")):
                for s in T.shingle_sets(data, at, words):
                    n.append(len(s))
                    cid.append(fingerprint(s))
                    hist.append(_hist(s, bins))
                    if len(s):
                        np.add.at(sketch, _sketch_slot(s), 1)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(hist, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = [i for i in range(len(sketch) // SKETCH_BLOCK) if sketch[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK].any()]
        k = len(blocks)
        counts = [sketch[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK].tobytes() for i in blocks]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(5)), pa.nulls(k, pa.binary()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())], names=names)

    return run


def _sum_sketch(parts: DataFrame) -> np.ndarray:
    """The document frequencies of all texts: 2^18 sums, whatever the input."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.repartition("block").mapInArrow(run, "block int, counts binary").collect():
        out[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(row.counts, np.int64)
    return out


def _prefixes(words: int, percent: int, sketch):
    """Prefix tokens of every set: the rarest n - ceil(n * percent / 100) + 1 in the global order.

    The order is by hashed document frequency, then by hash; equal keys at the cut are all taken, which is
    safe. A class seen already in the partition is left out.
    """

    def run(batches):
        weight = np.minimum(sketch.value, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
        seen: set[int] = set()
        for batch in batches:
            token, owner, size = [], [], []
            for _, _, data, at in T.chunks(batch.column("text")):
                for s in T.shingle_sets(data, at, words):
                    n = len(s)
                    if not n or (100 * n // percent == n and -(-percent * n // 100) == n):
                        continue  # such a size links with equal sets only
                    cid = fingerprint(s)
                    if cid in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(cid)
                    p = n - -(-percent * n // 100) + 1
                    key = weight[_sketch_slot(s)] | (s >> np.uint64(24))
                    part = s[key <= np.partition(key, p - 1)[p - 1]]
                    token.append(part.view(np.int64))
                    owner.append(np.full(len(part), cid, np.int64))
                    size.append(np.full(len(part), n, np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, owner, size)], names=["token", "cid", "n"])

    return run


def _shared(percent: int):
    """From postings sorted by (token, n, cid): those with a neighbour of another class and a compatible size."""

    def run(batches):
        held = None
        tail = None  # (token, cid, n) of the last row given up, for its neighbour

        def keep(token, cid, n, last):
            ok = np.zeros(len(token), bool)
            pair = (token[1:] == token[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            ok[1:] |= pair
            ok[:-1] |= pair
            if last is not None and len(token):
                ok[0] |= last[0] == token[0] and 100 * int(last[2]) >= percent * int(n[0])
            return ok

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("token", "cid", "n")]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            token, cid, n = (c[new] for c in cols)
            if not len(token):
                continue
            ok = keep(token, cid, n, tail)
            held = [c[-1:] for c in (token, cid, n)]  # its next neighbour is not known yet
            ok[-1] = False
            if len(token) > 1:
                tail = (token[-2], cid[-2], n[-2])
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[ok]), pa.array(cid[ok])], names=["token", "cid"])
        if held is not None:
            ok = keep(*held, tail)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(held[0][ok]), pa.array(held[1][ok])], names=["token", "cid"])

    return run


def _may_link(n1, h1, n2, h2, percent: int) -> np.ndarray:
    """Whether the sizes and histograms allow a link: each histogram step costs a token of the difference."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    need = least_overlap(n1, n2, percent)
    step = np.abs(h1.astype(np.int16) - h2.astype(np.int16))
    return (need <= np.minimum(n1, n2)) & (np.minimum(step, 256 - step).sum(1) <= n1 + n2 - 2 * need)


def _joined(n: np.ndarray, hist: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Labels of the classes of one token, sorted by size, after joining all that may link; ``label`` has the
    runs of neighbours that may."""
    label = label.copy()
    low = np.searchsorted(n * 100, n * percent, "left")
    for i in range(1, len(n)):
        rest = low[i] + np.flatnonzero(label[low[i] : i] != label[i])
        while len(rest):
            some, rest = rest[-1024:], rest[:-1024]
            hit = some[_may_link(n[some], hist[some], np.full(len(some), n[i]), hist[i][None], percent)]
            if len(hit):
                label[np.isin(label, np.unique(label[hit]))] = label[i]
                rest = rest[label[rest] != label[i]]
    return label


def _bucket_edges(percent: int):
    """From postings sorted by (token, n, cid): edges that connect the classes of a token that may link, at most
    one a class. Neighbours are compared for a whole batch at once; only where they leave a token's classes
    apart are others compared. A batch's last token waits for its remaining rows."""

    def edges(token, cid, n, hist):
        same = token[1:] == token[:-1]
        near = np.zeros(len(token), bool)
        near[1:] = same & _may_link(n[:-1], hist[:-1], n[1:], hist[1:], percent)
        label = np.cumsum(~near)
        first = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(first, len(token)))
        apart = label[first + size - 1] > label[first]
        for a, k in zip(first[apart & (size > 2)].tolist(), size[apart & (size > 2)].tolist()):
            label[a : a + k] = _joined(n[a : a + k], hist[a : a + k], label[a : a + k], percent)
        order = np.lexsort((cid, label))
        start = np.append(True, label[order][1:] != label[order][:-1])
        root = cid[order][start][np.cumsum(start) - 1]
        pairs = np.unique(np.column_stack([cid[order], root])[~start], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hist = np.frombuffer(b"".join(batch.column("hist").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            rows = [*(batch.column(c).to_numpy() for c in ("token", "cid", "n")), hist]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield edges(*(r[:cut] for r in rows))
            held = [r[cut:] for r in rows]
        if held is not None:
            yield edges(*held)

    return run


def trie_links(sets: list[np.ndarray], percent: int, probes: list[np.ndarray] | None = None):
    """Link counts and component labels of ``sets`` (or of sets + probes when joining two collections).

    The sets are laid in a prefix tree: tokens by falling frequency in the collection, sets in lexicographic
    order, so that a set shares its path with the one before it up to their common prefix. The traversal keeps
    the overlaps of all probes at each branching node, and skips a subtree when no probe can still reach the
    overlap it needs with the tokens that remain below.
    """
    own = probes is None
    probes = sets if own else probes
    k, m = len(sets), len(probes)
    size, probe_size = np.array([len(s) for s in sets], np.int64), np.array([len(s) for s in probes], np.int64)
    total = k if own else k + m
    links, label = np.zeros(total, np.int64), np.arange(total)
    pool, inverse, count = np.unique(np.concatenate(sets if own else [*sets, *probes]), return_inverse=True, return_counts=True)
    rank = np.empty(len(pool), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(pool))
    several = int((count > 1).sum())  # tokens of one set only can't overlap
    ranks = rank[inverse]

    def paths(lengths, start):
        ends = start + np.cumsum(lengths)
        out = [np.sort(ranks[e - n : e]) for e, n in zip(ends, lengths)]
        return [r[: np.searchsorted(r, several)] for r in out]

    path = paths(size, 0)
    probe_path = path if own else paths(probe_size, int(size.sum()))
    where = np.repeat(np.arange(m), [len(p) for p in probe_path])
    flat = np.concatenate(probe_path) if m else np.zeros(0, np.int64)
    by_token = np.argsort(flat, kind="stable")
    holders, first = where[by_token], np.searchsorted(flat[by_token], np.arange(several + 1))

    order = sorted(range(k), key=lambda i: path[i].astype(">u4").tobytes())
    common = np.zeros(k + 1, np.int64)
    for j in range(1, k):
        a, b = path[order[j - 1]], path[order[j]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        common[j] = differ[0] if len(differ) else n
    common[0] = common[k] = -1
    following, stack = np.full(k + 1, k), []
    for j in range(k + 1):
        while stack and common[stack[-1]] > common[j]:
            following[stack.pop()] = j
        stack.append(j)

    length = np.array([len(p) for p in path], np.int64)[order]
    in_order = size[order]
    node: list[tuple[int, np.ndarray]] = [(0, np.zeros(m, np.int32))]
    y = 0
    while y < k:
        p, shared = path[order[y]], max(int(common[y]), 0)
        while node[-1][0] > shared:
            node.pop()
        depth, overlap = node[-1]
        stops, j = [], y + 1
        while j < k and common[j] > shared:
            stops.append((int(common[j]), j))
            j = int(following[j])
        # depth-first order of the branching nodes on this path, with the end of each one's subtree
        ends = {c: int(following[i]) if i < k else k for c, i in stops}
        cut = None
        for stop in sorted({*ends, len(p)}):
            end = ends.get(stop, y + 1)
            if stop > depth:
                a, b = first[p[depth:stop]], first[p[depth:stop] + 1]
                spans = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                overlap = overlap + np.bincount(holders[at], minlength=m).astype(np.int32)
                depth = stop
            if stop in ends:
                left = int(length[y:end].max()) - depth
                if not (overlap + left >= least_overlap(probe_size, int(in_order[y:end].min()), percent)).any() and end > y + 1:
                    cut = end
                    break
                node.append((depth, overlap))
        if cut is not None:
            y = cut
            continue
        i = order[y]
        hit = np.flatnonzero((overlap >= least_overlap(probe_size, int(size[i]), percent)) & (overlap > 0))
        if own:
            hit = hit[hit != i]
            links[i] = len(hit)
            ids = hit
        else:
            links[i] += len(hit)
            ids = hit + k
            links[ids] += 1
        if len(ids):
            seen = np.unique(label[np.append(ids, i)])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
        y += 1
    return links, label


def _group_links(percent: int):
    """Links within a block or between the two blocks of a pair: (cid, root, links), one row per set."""

    def work(group: pa.Table):
        group = group.combine_chunks()
        cid, block = group.column("cid").to_numpy(), group.column("block").to_numpy()
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        _, once = np.unique(cid, return_index=True)  # a repeated row gives a set twice
        cid, block = cid[once], block[once]
        tokens = group.column("tokens").to_pylist()
        sets = [np.frombuffer(tokens[i], np.uint64) for i in once]
        if first == second:
            names, (links, label) = cid, trie_links(sets, percent)
        else:
            left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
            names = cid[np.concatenate([left, right])]
            if not len(left) or not len(right):
                return None
            links, label = trie_links([sets[i] for i in left], percent, [sets[i] for i in right])
        linked = links > 0
        if not linked.any():
            return None
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, label, names)
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(least[label][linked]), pa.array(links[linked])], names=["cid", "root", "links"])

    return work


def _sets_of(words: int):
    """Sets of the rows that stand for their class."""

    def run(batches):
        for batch in batches:
            at_row = 0
            want = batch.column("cid").to_numpy()
            rows, tokens = [], []
            for _, _, data, at in T.chunks(batch.column("text")):
                for s in T.shingle_sets(data, at, words):
                    if fingerprint(s) == want[at_row]:
                        rows.append(at_row)
                        tokens.append(s.tobytes())
                    at_row += 1
            kept = batch.select(["grp", "cid", "blocks"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tokens, pa.large_binary()).cast(pa.binary())], names=["grp", "cid", "blocks", "tokens"])

    return run


def jaccard_components(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, root: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, n_links, and ``carry``, a long column to pass on.

    ``root`` names a further column that tells components apart even if their ids are missing or repeated; null
    for rows without words.

    Words are maximal runs of non-white-space after lower-casing A-Z; a set holds the distinct ``words``-word
    shingles, or the whole sequence if there are fewer words. Two rows link when 100 * intersection >=
    ``percent`` * union. component_id is the smallest id reachable by links, the row's own included (null only
    if all ids are null). n_links counts the other texts (classes of equal sets) linked directly. Rows without
    words (null, empty, white space) have n_shingles 0, link with nothing and keep their own id. Repeated rows
    are members of one class and each gets its row. Columns other than the two named are not read. Hashes of
    64 bits stand for shingles and sets.
    """
    spark = docs.sparkSession
    carried = F.col(carry) if carry else F.lit(None)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), carried.cast("long").alias("carried"), F.col(text_col).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    described = saved(docs.mapInArrow(_describe(words, hist_bins(percent)), "doc_id long, carried long, mark long, n long, cid long, hist binary, block int, counts binary"), "jaccard-sets")
    sketch = spark.sparkContext.broadcast(_sum_sketch(described.where("block is not null").select("block", "counts")))
    rows = described.where("n is not null").select("doc_id", "carried", "mark", "n", "cid", "hist")
    # a class is represented by the rows of one id and text
    classes = saved(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("who"), F.first("n").cast("int").alias("n"), F.first("hist").alias("hist")), "jaccard-classes")

    postings = docs.select("text").mapInArrow(_prefixes(words, percent, sketch), "token long, cid long, n int")
    shared = saved(postings.repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(_shared(percent), "token long, cid long"), "jaccard-shared")
    known = shared.join(classes.select("cid", "n", "hist"), "cid").select("token", "cid", "n", "hist")
    edges = known.repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(_bucket_edges(percent), "a long, b long")
    groups = components(edges)

    members = groups.select(F.col("node").alias("cid"), F.col("root").alias("grp")).join(classes.select("cid", "who", "n"), "cid")
    weight = members.groupBy("grp").agg(F.sum("n").alias("tokens")).select("grp", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    needed = saved(members.join(weight, "grp").select("grp", "cid", "who", "blocks"), "jaccard-members")
    small = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = docs.join(small, F.col("doc_id").eqNullSafe(F.col("who.doc_id")) & (F.col("mark") == F.col("who.mark"))).select("text", "grp", "cid", "blocks").mapInArrow(_sets_of(words), "grp long, cid long, blocks int, tokens binary")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("grp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "cid", "block", "blocks", "tokens")
    found = saved(by_group(sets, ["grp", "first", "second"], ["cid"], _group_links(percent), "cid long, root long, links long"), "jaccard-links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"), F.countDistinct("root").alias("roots"))
    counts = saved(counts, "jaccard-counts")
    if needed.where("blocks > 1").limit(1).count():  # a class in several blocks: join their parts
        joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        counts = counts.join(joined.select(F.col("node").alias("cid"), F.col("root").alias("whole")), "cid", "left").withColumn("root", F.coalesce("whole", "root"))
    classes = classes.join(counts.select("cid", "root", "n_links"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = classes.join(least, "root").select("cid", "root", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", *([F.col("carried").alias(carry)] if carry else []), *([F.col("root").alias(root)] if root else [])]
    rows = rows.drop("hist", "mark")
    whole = rows.where("n > 0").join(final, "cid").select(*out)
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long")).withColumn("root", F.lit(None).cast("long"))
    return whole.unionByName(empty.select(*out))
