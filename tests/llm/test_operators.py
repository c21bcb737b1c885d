"""Every operator against its definition, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstack.llm import (jaccard_join, license_scan, line_templates, paragraph_dedup, phrase_index, piece_codec,
                            quality_rules, text as T, token_files, toxicity, url_rules)

from . import brute
from .conftest import table


def same(got, expected):
    assert Counter(got) == Counter(expected)


def empty_of(docs):
    return docs.limit(0)


# 1 ---------------------------------------------------------------------------------------------------------
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum(t):
    return ALNUM.findall((t or "").encode().lower())


def hits(rows, items, window):
    windows = defaultdict(set)
    for item, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    for doc, t in rows:
        w, hit, found = alnum(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= names
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items_of(rows):
    return [(1, " ".join(rows[3][1].split()[2:14])), (2, "ONE two"), (10, rows[9][1]), (3, None), (4, ""), (None, "one"), (5, "tail"), (6, "absent words here")]


@pytest.mark.parametrize("block", [2_000_000, 1])
def test_decontamination(spark, rows, docs, monkeypatch, block):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(*x, 1) for x in items_of(rows)], "item_id long, text string, doc_id int")
    got = phrase_index.digests(phrase_index.contamination(docs, items, window=5)).collect()
    expected = list(hits(rows, items_of(rows), 5))
    assert any(e[-1] for e in expected) and not all(e[-1] for e in expected)
    same(map(tuple, got), expected)


def test_decontamination_empty(spark, docs, rows):
    items = spark.createDataFrame(items_of(rows), "item_id long, text string")
    assert phrase_index.contamination(empty_of(docs), items).count() == 0
    got = phrase_index.contamination(docs, items.limit(0)).collect()
    assert len(got) == len(rows) and not any(r.spans or r["items"] for r in got)


def test_segments_of_many_sizes(rows):
    for size in (1, 50, 10**6):
        held, segments, count = [[], [], [], []], [], 0
        for doc, t in rows:
            data = (t or "").encode()
            words, counts = phrase_index.words_of(data, np.array([0, len(data)], np.int64))
            if count + len(words) > size and held[0]:
                segments.append(held)
                held, count = [[], [], [], []], 0
            for h, x in zip(held, (np.array([doc or 0]), np.array([doc is not None]), words, counts)):
                h.append(x)
            count += len(words)
        segments.append(held)
        found = 0
        items = phrase_index.Items(["1"], [" ".join(rows[3][1].split()[2:8])], 4)
        for h in segments:
            s = phrase_index.Segment(dict(zip(phrase_index._PLACES, phrase_index._segment(*h))))
            found += len(phrase_index.phrases(s, items.words, items.first, items.size)[0])
        w = alnum(" ".join(rows[3][1].split()[2:8]))
        windows = Counter(tuple(w[j : j + 4]) for j in range(len(w) - 3))
        texts = [alnum(t) for _, t in rows]
        assert found == sum(windows[tuple(x[i : i + 4])] for x in texts for i in range(len(x) - 3))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "f x x x x x a"), (3, "a f"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "f a")], "item_id long, text string")
    same(phrase_index.proximity(docs, items, 5).select("doc_id", "item_id").distinct().collect(), [(1, "7"), (3, "7")])


# 2 ---------------------------------------------------------------------------------------------------------
def ranks_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_token_counts(docs, rows, block):
    import base64

    import tiktoken

    path, pattern = ranks_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    files, contents = token_files.write_files(docs, path, pattern, 50256, block_tokens=block)
    got = contents.join(token_files.count_tokens(files, 50256), ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    same(map(tuple, got), [(d, len(encoding.encode_ordinary(t or ""))) for d, t in rows])
    assert token_files.document_tokens(empty_of(docs), path, pattern, 50256).count() == 0


def test_separator_scan(spark):
    streams = {0: [9, 1, 1, 9, 9, 1, 1, 1], 1: [], 2: [9, 9], 3: [1, 2, 3], 4: [1, 9]}
    blocks = []
    for f, s in streams.items():
        for b, cut in enumerate(range(0, max(len(s), 1), 2)):
            blocks.append((f, b, bytearray(np.array(s[cut : cut + 2], "<u2").tobytes())))
    blocks.append((0, 9, None))
    got = token_files.count_tokens(spark.createDataFrame(blocks, "file int, block long, data binary"), 9).collect()
    same(map(tuple, got), [(0, 0, 0, 0), (0, 1, 1, 2), (0, 2, 4, 0), (0, 3, 5, 3), (2, 0, 0, 0), (2, 1, 1, 0), (3, 0, 0, 3), (4, 0, 0, 1)])


# 3 ---------------------------------------------------------------------------------------------------------
def paragraphs(rows, k, percent, least):
    found = [(d, i, len(brute.words(x)), brute.shingles(x, k)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(brute.words(x)) >= least]
    groups = brute.Sets(range(len(found)))
    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if 100 * len(a[3] & b[3]) >= percent * len(a[3] | b[3]):
                groups.join(i, j)
    members = defaultdict(list)
    for i in range(len(found)):
        members[groups.find(i)].append(i)
    for m in members.values():
        if len(m) > 1:
            d, line = min(((found[i][0] is None, found[i][0] or 0, found[i][1]) for i in m))[1:]
            d = None if all(found[i][0] is None for i in m) else d
            for i in m:
                yield found[i][0], found[i][1], found[i][2], d, line, (found[i][0], found[i][1]) != (d, line)


def test_window_starts():
    """Every run of ``among`` places has one, and it follows from the run alone."""
    g = np.random.default_rng(3)
    sizes = [0, 1, 5, 6, 7, 40, 300, 2]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    marks = g.integers(0, 2**63, len(rows)).astype(np.uint64) * np.uint64(1 << 20)
    for among in (1, 2, 6, 7, 30):
        got = set(paragraph_dedup.window_starts(marks, rows, among).tolist())
        expected, at = set(), 0
        for n in sizes:
            for j in range(max(1, n - among + 1) if n else 0):
                run = range(at + j, at + min(n, j + among))
                expected.add(min(run, key=lambda i: (int(marks[i]) >> 16, i)))
            at += n
        assert got == expected


def covered(rows, k, percent, least, window, among):
    """(doc, first, n, removed) of the merged spans, from all pairs of lines and all places of windows."""
    texts = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    found = []  # text, first word, words, key, kind
    for at, (_, t) in enumerate(texts):
        w, begin = [x.lower() for x in brute.words(t)], 0
        for line in (t or "").split("\n"):
            n = len(brute.words(line))
            if n >= least:
                found.append((at, begin, n, tuple(w[begin : begin + n]), 0))
            begin += n
        h = T.word_hashes(*T.find_words((t or "").encode(), np.array([0, len((t or "").encode())]), T.LOWER)[:3])
        starts = range(len(w) - window + 1)
        marks = [int(T.mix(np.add.reduce(h[i : i + k] * T._PLACE[:k], dtype=np.uint64)[None])[0]) >> 16 for i in starts]
        chosen = {min(starts[j : j + among], key=lambda i: (marks[i], i)) for j in range(max(1, len(starts) - among + 1) if len(starts) else 0)}
        found += [(at, i, window, tuple(w[i : i + window]), 1) for i in chosen]
    groups = brute.Sets(range(len(found)))
    lines = [i for i, f in enumerate(found) if f[4] == 0]
    sets = {i: brute.shingles(" ".join(x.decode() for x in found[i][3]), k) for i in lines}
    for i in lines:
        for j in lines:
            if j < i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                groups.join(i, j)
    by_words = defaultdict(list)
    for i, f in enumerate(found):
        by_words[f[3], f[4]].append(i)
    for same_words in by_words.values():
        for i in same_words:
            groups.join(same_words[0], i)
    members = defaultdict(list)
    for i in range(len(found)):
        members[groups.find(i)].append(i)
    kept, gone = defaultdict(set), defaultdict(set)
    for m in members.values():
        if len({found[i][:2] for i in m}) > 1 and (len({found[i][0] for i in m}) > 1 or any(found[i][4] == 0 for i in m)):
            key = lambda i: (texts[found[i][0]][0] is None, texts[found[i][0]][0] or 0, found[i][1])
            first = min(map(key, m))
            for i in m:
                (kept if key(i) == first else gone)[found[i][0]].update(range(found[i][1], found[i][1] + found[i][2]))
    for at, (d, _) in enumerate(texts):
        for removed, held in ((False, kept[at]), (True, gone[at] - kept[at])):
            held = sorted(held)
            for i, x in enumerate(held):
                if i == 0 or held[i - 1] != x - 1:
                    n = next((j for j in range(i, len(held)) if j + 1 == len(held) or held[j + 1] != held[j] + 1), i) - i + 1
                    yield d, x, n, removed


@pytest.mark.parametrize("window,among,least,few,held", [(8, 6, 5, 8, 1 << 19), (8, 6, 5, 1, 40), (6, 4, 5, 2, 1 << 19), (paragraph_dedup.WINDOW_WORDS, paragraph_dedup.WINDOW_AMONG, 20, 8, 1 << 19)])
def test_repeated_passages(docs, rows, monkeypatch, window, among, least, few, held):
    monkeypatch.setattr(paragraph_dedup, "WINDOW_FEW", few)
    monkeypatch.setattr(paragraph_dedup, "WINDOW_ROWS", held)
    monkeypatch.setattr(paragraph_dedup, "BAND_ROWS", held)
    got = paragraph_dedup.repeated_passages(docs, words=5, percent=80, least_words=least, recall=0.999999, window=window, among=among).collect()
    same([(r.doc_id, r.first_word, r.n_words, r.removed) for r in got], list(covered(rows, 5, 80, least, window, among)))
    words = defaultdict(set)
    for d, t in rows:
        words[d].add(tuple(x.lower() for x in brute.words(t)))
    for r in got:
        if r.removed and r.n_words == window:  # a window by itself stands word for word where it is kept
            here = {w[r.first_word : r.first_word + r.n_words] for w in words[r.doc_id]}
            assert here & {w[r.keep_first_word : r.keep_first_word + r.n_words] for w in words[r.keep_doc_id]}
    assert paragraph_dedup.repeated_passages(empty_of(docs)).count() == 0


def test_without_passages(spark):
    """Cut texts hold every passage once, and no words but the removed ones go."""
    g = np.random.default_rng(5)
    word = lambda: "".join(g.choice(list("abcdé"), g.integers(3, 9)))
    passage = [word() for _ in range(70)]
    rows = [(i, "  ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(30))]) + "\n", i) for i in range(6)] + [(7, None, 7), (8, "", 8), (None, "lone\twords", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone2 int").repartition(3)
    spans = paragraph_dedup.repeated_passages(docs)
    got = {r["_gone2"]: r.text for r in paragraph_dedup.without_passages(docs, spans).collect()}
    taken = {(r.doc_id, r.first_word, r.n_words) for r in spans.collect() if r.removed}
    for d, t, i in rows:
        if t is None or d is None:
            assert got[i] == t
            continue
        w = t.split()
        dropped = {x for doc, a, n in taken if doc == d for x in range(a, a + n)}
        assert got[i].split() == [x for k, x in enumerate(w) if k not in dropped]
    whole = " ".join(passage[25:45])  # well inside: windows reach at most 29 words less than the passage at an end
    assert sum(whole in " ".join((t or "").split()) for t in got.values()) == 1
    again = paragraph_dedup.repeated_passages(paragraph_dedup.without_passages(docs, spans))
    assert not again.where("removed").count()


def test_hot_windows(spark, monkeypatch):
    """A window that stands many times in one text and once in another, beside one in every text."""
    monkeypatch.setattr(paragraph_dedup, "WINDOW_FEW", 2)
    common = " ".join(f"c{i}" for i in range(60))
    own = " ".join(f"o{i}" for i in range(25))
    rows = [(1, " z ".join([own] * 30)), (2, "y " + own)] + [(10 + i, f"a{i} {common} b{i}") for i in range(90)]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least_words=200).collect()
    same([(r.doc_id, r.first_word, r.n_words, r.removed) for r in got], list(covered(rows, 5, 80, 200, paragraph_dedup.WINDOW_WORDS, paragraph_dedup.WINDOW_AMONG)))
    assert {r.doc_id for r in got} == {1, 2, *range(10, 100)} and {r.keep_doc_id for r in got} == {1, 10}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_streams_in_batches(size):
    """Windows and band values come in batches of any size."""
    import pyarrow as pa

    g = np.random.default_rng(2)
    rows = sorted((int(c), int(d), int(k), int(f)) for c, d, f in g.integers(0, 6, (300, 3)) for k in [d * 7])
    cls, doc, key, first = (np.array(x, np.int64) for x in zip(*rows))
    stream = pa.table({"class": cls, "doc_key": key, "doc_id": doc, "first_word": first, "n_words": np.full(300, 4), "hot": np.zeros(300, bool)})
    got = [r for b in paragraph_dedup._same_windows(iter(stream.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    expected = []
    for c in set(cls.tolist()):
        mine = sorted({r for r in rows if r[0] == c})
        if len({r[2] for r in mine}) > 1:
            expected += [(c, k, d, f, mine[0][1], mine[0][3], (d, f) == (mine[0][1], mine[0][3])) for _, d, k, f in mine]
    same([(r["class"], r["doc_key"], r["doc_id"], r["first_word"], r["keep_doc_id"], r["keep_first_word"], r["is_first"]) for r in got], expected)
    stream = pa.table({"value": cls, "class": doc, "other": pa.array([int(x) if i % 9 == 0 else None for i, x in enumerate(first)], pa.int64())})
    edges = [(r["a"], r["b"]) for b in paragraph_dedup._edges(iter(stream.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    expected = [(int(doc[i]), int(first[i])) for i in range(0, 300, 9)]
    for c in set(cls.tolist()):
        mine = [int(doc[i]) for i in range(300) if cls[i] == c and i % 9]
        expected += [(x, mine[0]) for x in mine if x != mine[0]]
    same(edges, expected)


def test_planted_passages(spark):
    """With the registered parameters: passages of 50 words and more inside lines, over line feeds and in short lines."""
    g = np.random.default_rng(8)
    word = lambda: "".join(g.choice(list("abcdefgh"), g.integers(2, 9)))
    passages = [[word() for _ in range(int(n))] for n in g.integers(50, 120, 30)]
    rows, planted = [], set()
    for doc in range(400):
        w = [word() for _ in range(int(g.integers(60, 400)))]
        if doc % 2:
            at = int(g.integers(0, len(w)))
            w[at:at] = passages[doc % 30]
            planted.add(doc)
        glue = [" ", "\n", " "][doc % 3]
        rows.append((doc, "".join(x + (glue if g.random() < 0.3 else " ") for x in w)))
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    found = {r.doc_id for r in got}
    assert len(found & planted) >= 0.99 * len(planted) and not found - planted
    assert len({r.doc_id for r in got if r.removed}) == len(planted) - len({d % 30 for d in planted})
    assert all(r.n_words <= 120 for r in got)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_repeated_paragraphs(docs, rows, monkeypatch, block):
    monkeypatch.setattr(paragraph_dedup, "BLOCK_TOKENS", block)
    got = paragraph_dedup.repeated_paragraphs(docs, words=3, percent=80, least_words=5, recall=0.999999).collect()
    expected = list(paragraphs(rows, 3, 80, 5))
    assert len(expected) > 15
    same(map(tuple, got), expected)
    assert paragraph_dedup.repeated_paragraphs(empty_of(docs)).count() == 0


def test_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1), (2, None, 2), (3, "x", 3)], "doc_id long, text string, line int")
    gone = spark.createDataFrame([(1, 1, True), (1, 2, False)], "doc_id long, line long, removed boolean")
    same(map(tuple, paragraph_dedup.without_repeats(docs, gone).collect()), [(1, "a\nc", 1), (2, None, 2), (3, "x", 3)])


def test_bands_reach_their_recall():
    for threshold in (0.5, 0.8, 0.9):
        b, r = paragraph_dedup.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**r) ** b >= 0.999


# 4 ---------------------------------------------------------------------------------------------------------
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    ids = [(d, sp.encode(t or "", add_bos=True, add_eos=True)) for d, t in rows]
    text = {tuple(i): sp.decode(i) for _, i in ids}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = piece_codec.round_trip(docs, model_path()).collect()
    same(map(tuple, got), [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(text[tuple(i)].encode())) for d, i in ids])
    encoded = piece_codec.encode(docs, model_path())
    same([(r.doc_id, tuple(r.ids)) for r in encoded.collect()], [(d, tuple(i)) for d, i in ids])
    same(map(tuple, piece_codec.decode(encoded, model_path()).collect()), [(d, text[tuple(i)]) for d, i in ids])
    checked = piece_codec.encode_checked(docs, model_path()).collect()
    same([(r.doc_id, tuple(r.ids), r.decodes) for r in checked], [(d, tuple(i), text[tuple(i)] == (t or "")) for (d, i), (_, t) in zip(ids, rows)])
    assert piece_codec.round_trip(empty_of(docs), model_path()).count() == 0


def test_pieces_at_random():
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    codec, rng = piece_codec.Codec(piece_codec.Vocabulary.load(model_path())), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz" * 2 + "ABCD0123456789 ,.;:!?-_=*#/\\\n\t\r\x00éèüßñç▁日本語ﬁ😀\xa0　"
    for n in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        t = " " * n if n < 40 else t
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == sp.encode(t, add_bos=True, add_eos=True)
        assert codec.decode(ids) == sp.decode(ids)
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == sp.decode(ids)
    made = [p for p in codec.halves if p.strip("▁")]
    for _ in range(5000):
        a, b = rng.choice(made), rng.choice(made)
        if not b.startswith("▁") and not {a, b} & codec.odd:
            assert codec.apart(a, b) == (codec.merge(a + b) == [a, b])


def test_pieces_keep_their_work(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    monkeypatch.setattr(piece_codec, "WORDS_KEPT", 40)
    monkeypatch.setattr(piece_codec, "PAIRS_KEPT", 30)
    codec, made = piece_codec.Codec(piece_codec.Vocabulary.load(model_path())), []
    segment = codec.segment
    codec.segment = lambda marks, rest: made.append((marks, rest)) or segment(marks, rest)
    words = ["thonessatind", "erhendonthea", "unoninghees", "inatntiesing"]
    t = " ".join([*words, *(w + "." for w in words), *words]) + "\n" + "\n".join([*words, *words])
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
    assert sorted(made) == sorted([*((1, w) for w in words), *((0, w) for w in words)])  # a full stop ends a kept word
    for n in range(300):  # through many generations of kept words and pairs
        t = " ".join(a + b + str(n) for a in words for b in words)
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
        assert len(codec.words) + len(codec.after_feed) + sum(map(len, codec.older)) <= 40 and sum(map(len, codec.pairs.values())) <= 30
    begun = []
    search = codec.search
    codec.search = lambda text, parts, pos: begun.append(pos) or search(text, parts, pos)
    for a in words:
        for b in words:
            assert codec.split(a + b) == codec.merge(a + b)
    assert begun and all(begun)  # the search goes on where the longest matches stop to fit


# 5 ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("k,percent,block", [(3, 90, 2_000_000), (1, 60, 2_000_000), (1, 60, 40), (2, 70, 300)])
def test_jaccard_join(docs, rows, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    expected = brute.jaccard(rows, k, percent)
    assert sum(e[2] > 0 for e in expected) >= (3 if k == 3 else 12)
    same([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got], [(d, *e) for (d, _), e in zip(rows, expected)])


def test_jaccard_join_empty(docs):
    assert jaccard_join.jaccard_components(empty_of(docs), 3, 90).count() == 0
    assert jaccard_join.jaccard_components(docs.where("text is null"), 3, 90).count() == 2


def test_trie_links():
    rng = np.random.default_rng(4)
    for round_ in range(60):
        percent = int(rng.choice([30, 50, 80, 90]))
        sets = [np.unique(rng.integers(0, 24, rng.integers(1, 16))).astype(np.uint64) for _ in range(rng.integers(1, 30))]
        cut = int(rng.integers(0, len(sets)))
        linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
        links, label = jaccard_join.trie_links(sets, percent)
        groups = brute.Sets(range(len(sets)))
        for i, a in enumerate(sets):
            assert links[i] == sum(linked(a, b) for j, b in enumerate(sets) if i != j)
            for j in range(i):
                if linked(a, sets[j]):
                    groups.join(i, j)
        assert all((label[i] == label[j]) == (groups.find(i) == groups.find(j)) for i in range(len(sets)) for j in range(i))
        if 0 < cut:
            links, _ = jaccard_join.trie_links(sets[:cut], percent, sets[cut:])
            assert links.tolist() == [sum(linked(a, b) for j, b in enumerate(sets) if (j < cut) != (i < cut)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_bucket_edges(size):
    """Edges of each token's classes join exactly the classes that may link, whatever the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(60):
        percent, rows, cid = int(rng.choice([50, 80, 90])), [], 0
        for token in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(1, 9))):
                n, hist, base = int(rng.integers(20, 60)), np.zeros(64, np.uint8), 5 * int(rng.integers(0, 3))
                hist[base : base + n // 4] = 3
                hist[rng.integers(0, 64, 3)] += 1
                cid += 1
                rows.append((token, int(rng.permutation(7)[0]) * 1000 + cid, n, hist))
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        stream = pa.table({"token": [r[0] for r in rows], "cid": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int32()), "hist": pa.array([r[3].tobytes() for r in rows], pa.binary())})
        got = set()
        for b in jaccard_join._bucket_edges(percent)(iter(stream.to_batches(max_chunksize=size))):
            got |= set(zip(b["a"].to_pylist(), b["b"].to_pylist()))
        expected = set()
        for token in range(5):
            mine = [r for r in rows if r[0] == token]
            groups = brute.Sets([r[1] for r in mine])
            for i, a in enumerate(mine):
                for b in mine[:i]:
                    if jaccard_join._may_link(np.array([a[2]]), a[3][None], np.array([b[2]]), b[3][None], percent)[0]:
                        groups.join(a[1], b[1])
            least = {}
            for c in sorted(groups.parent):
                least.setdefault(groups.find(c), c)
            expected |= {(c, least[groups.find(c)]) for c in groups.parent if least[groups.find(c)] != c}
        assert got == expected


def test_histogram_bound_is_safe():
    """A pair that links is never turned down by its sizes and histograms."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        percent = int(rng.choice([60, 80, 90]))
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40)), dtype=np.uint64)]))
        h = [np.frombuffer(jaccard_join._hist(s, jaccard_join.hist_bins(percent)), np.uint8)[None] for s in (a, b)]
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            assert jaccard_join._may_link(np.array([len(a)]), h[0], np.array([len(b)]), h[1], percent)[0]


# 6 ---------------------------------------------------------------------------------------------------------
def line_order(tokens):
    line = b" ".join(b"0" if t == b"<*>" else t for t in tokens)
    return int(line_templates.Lines(line, np.array([0, len(line)])).hash().view(np.int64)[0])


def line_rows(rows):
    heads = ["see page 12 of this site now", "see page 7 of this site now", "see page 9 of that site now", "all rights kept", ""]
    return [(d, t if t is None or i % 3 else f"{heads[i % 5]}\n{t}\n{heads[(i + 2) % 5]}") for i, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup(spark, rows, broadcast):
    rows = line_rows(rows)
    docs = table(spark, rows)
    edited = line_templates.drop_recurring_lines(docs, 3, agree=0.7, broadcast_rows=broadcast)
    expected = [(d, *e) for (d, _), e in zip(rows, brute.line_dedup([t for _, t in rows], 3, 0.7, line_order))]
    assert sum(e[3] for e in expected) > 10
    same([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in edited.collect()], expected)
    assert [c for c in edited.columns if c not in ("n_lines", "n_dropped")] == ["doc_id", *[c for c in docs.columns if c not in ("doc_id", "text", "n_dropped")], "text"]
    assert line_templates.drop_recurring_lines(empty_of(docs), 3).count() == 0


def test_edited_rows_go_out_by_chunks():
    texts = [f"own {i}\n" + "w" * 100_000 + f" {i}" for i in range(12)] + [None, ""]
    docs = pa.array([{"doc_id": i} for i in range(14)])
    lines = line_templates.Lines(b"own 5", np.array([0, 5], np.int64)).hash().view(np.int64)
    out = list(line_templates._dropper(lambda batch: lambda row: lines if row == 5 else lines[:0])([pa.RecordBatch.from_arrays([docs, pa.array(texts)], names=["doc", "text"])]))
    assert max(b.column("text").nbytes for b in out) <= 1 << 18  # a worker holds no whole batch of edited texts
    got = [(x["doc"]["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for b in out for x in b.to_pylist()]
    expected = [(i, t, 2, 0) for i, t in enumerate(texts[:12])] + [(12, None, 0, 0), (13, "", 0, 0)]
    expected[5] = (5, "w" * 100_000 + " 5", 2, 1)
    assert got == expected


def test_line_dedup_deep_leaves(spark, rows, monkeypatch):
    monkeypatch.setattr(line_templates, "LEAF_TOKENS", 8)
    docs = table(spark, [(i, f"a b c {x}\nown{chr(97 + i)} line{chr(98 + i)}") for i, x in enumerate("pqppqr")])
    got = line_templates.drop_recurring_lines(docs, 3, agree=0.7).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}  # no generalising past the limit


def grown(tokens, agree):
    """Founder of each line's template, comparing each line with all templates."""
    owner, templates = [], []
    for i, x in enumerate(tokens):
        shared = [int(((t == x) & (x != line_templates.ANY)).sum()) for t in templates]
        if shared and max(shared) >= agree * len(x):
            best = shared.index(max(shared))
            templates[best][templates[best] != x] = line_templates.ANY
            yield owner[best]
        else:
            templates.append(x.copy())
            owner.append(i)
            yield i


def test_leaf_finds_the_best_of_all_templates():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 8, 13, 30):
        for agree in (0.3, 0.7, 0.8, 1.0):
            bases = rng.integers(2, 9, (12, n)).astype(np.uint64)
            tokens = bases[rng.integers(0, 12, 150)]
            noise = rng.random(tokens.shape) < 0.12
            tokens[noise] = rng.integers(1, 9, noise.sum())  # 1 is a variable token
            tokens[:, :3] = rng.integers(1, 4, n)[:3]
            tokens = tokens[np.sort(np.unique(tokens, axis=0, return_index=True)[1])]
            leaf = line_templates.Leaf(tokens[0], agree, 10**6)
            assert [leaf.place(i, x) for i, x in enumerate(tokens)] == list(grown(tokens, agree))


def test_line_dedup_large_leaves(spark, monkeypatch):
    assert line_templates.LEAF_TOKENS is None  # no size past which lines don't generalise
    rows = [(i, f"own line {word(100 + i)} {word(300 + i)}\nwe thank you dear {word(i)} for reading\nanother one {word(200 + i)}\nwe thank you for a {word(500 + i)} visit") for i in range(25)]
    for block in (1_000_000, 7):  # of the second, one template a round
        monkeypatch.setattr(line_templates, "BLOCK_TOKENS", block)
        got = line_templates.drop_recurring_lines(table(spark, rows), 20).collect()
        assert {r.doc_id: r.text.split("\n") for r in got} == {i: t.split("\n")[::2] for i, t in rows}


def word(i):
    return "".join(chr(97 + int(c)) for c in str(i))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup_passages(spark, broadcast):
    footer = ["this site keeps all rights", "write to the desk for a licence", "thanks for your visit"]
    own = [[f"{kind} {word(100 + i)} tells of {word(200 + i)} and {word(300 + i)} at {word(400 + i)} by {word(500 + i)}" for kind in ("alpha", "beta", "gamma")] for i in range(25)]
    copied = [f"chapter {word(j)} of one {word(10 + j)} story" for j in range(8)]
    rows = [(i, "\n".join([*lines, *footer] if i % 2 else [lines[0], *footer, *lines[1:]])) for i, lines in enumerate(own)]
    rows += [(100 + i, "\n".join([*copied[: i % 8], f"edit {word(i)} in a copy by {word(600 + i)}", *copied[i % 8 + 1 :]])) for i in range(40)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(table(spark, rows), 20, broadcast_rows=broadcast).collect()}
    assert got == {i: ("\n".join(own[i]), 3) if i < 100 else (t, 0) for i, t in rows}  # near copies of one document stay whole


# 7 ---------------------------------------------------------------------------------------------------------
def test_globs():
    import random

    rng = random.Random(1)
    for _ in range(200):
        globs = ["".join(rng.choice("ab*?.") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 30))]
        texts = ["".join(rng.choice("ab.") for _ in range(rng.randrange(9))) for _ in range(6)]
        got = url_rules.GlobSet(globs).match([t.encode() for t in texts])
        for i, t in enumerate(texts):
            for j, g in enumerate(globs):
                regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
                assert got[i, j] == bool(re.fullmatch(regex, t, re.S))


URLS = [None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.COM/x?y#z", "http://www.example.com/en/1", "http://x.www.example.com/en/", "http://example.com/en/", "http://notexample.com/en/", "http://example.com/En/", "http://a.net/es/", "http://a.net/es", "http://net/fr/a", "http://b.net/x.com/es/", "http://b.org/?q=net/es/", "http://b.org#f/x", "a://b://c.com/", "http://spam.org/", "http://b.org/.com#/x", "http://ünï.com/é", "http://a.org/" + "x" * 70_000, "http://a.net/fr/", "http://a.net/fr/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i if i else None, u, 1, 2) for i, u in enumerate(URLS)], "page_id long, url string, host int, rule int")
    got = url_rules.judge(pages).collect()

    def verdict(u):
        rest = u.split("://", 1)[1] if u is not None and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best and best.verdict

    for r in got:
        u = URLS[r.page_id or 0]
        assert (r.host, r.path, r.rule) == verdict(u)[:3]
        assert r.verdict == (verdict(u)[3] or ("block" if u and ("spam" in u) else "allow"))
    assert len(got) == len(URLS) and {r.rule for r in got} == {None, *(r.name for r in url_rules.RULES)}
    assert url_rules.judge(pages.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------
def toxic_rows(seed=3, n=600):
    import random

    rng = random.Random(seed)
    mild = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    out = []
    for i in range(n):
        words = [rng.choice(mild) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), "rotten" + rng.choice(["", "ly", "ish", "est"]) + rng.choice(["", "x", "!"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "rottenish rotten rottenly"), (5002, "Rottten rotttenly rottenn words")])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, toxicity.Training(per_class=200)).collect()}
    assert len(got) == len(rows) + 4
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held) and len(held) > 150
    assert got[None].predicted == 1 and got[5002].predicted == 1  # misspellings share n-grams
    assert got[5000].score == got[5001].score < 0.7


def test_toxicity_without_labels(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    assert toxicity.toxicity(empty_of(docs), labels).count() == 0


def test_toxicity_sample_of_a_hot_id(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(2, "other"), (3, None), (3, "third"), (4, "fourth")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    how = toxicity.Training(per_class=2)
    got = toxicity.sample(table(spark, rows), labels, how)
    assert Counter(y for y, _ in got) == {0: 2, 1: 2} and {t for _, t in got} >= {b"other", b"fourth"}
    assert got == toxicity.sample(table(spark, rows[::-1], 5), labels, how)


# 9 ---------------------------------------------------------------------------------------------------------
def test_license_scan(spark, rows):
    import duckdb

    notice = license_scan.NOTICES
    extra = [(900, "x " * 11 + notice["GPL-3.0"]), (901, "x. " * 500 + notice["MIT"] + " and " + notice["MIT"]), (902, notice["Apache-2.0"].upper()), (903, "all Rights-RESERVED"), (903, "all rights\nreserved"), (904, notice["GPL-3.0"].replace("This work is", "Our work is")), (905, "rights reserved all"), (None, notice["CC-BY-NC-4.0"])]
    rows = rows + extra
    docs = table(spark, rows)
    got = license_scan.scan(docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t and t.replace("\x00", " ")) for d, t in rows])
    expected = con.execute(license_scan.sql()).fetchall()
    assert len(expected) >= 6
    same(map(tuple, got.collect()), expected)
    assert license_scan.scan(empty_of(docs)).count() == 0
    assert not re.search("Python|Pandas|ArrowEval", got._jdf.queryExecution().executedPlan().toString())


# 10 --------------------------------------------------------------------------------------------------------
def test_quality(docs, rows):
    got = quality_rules.quality(docs).collect()
    expected = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup, cover = set(), 0, set()
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        count = Counter(zip(w, w[1:], w[2:]))
        for i in range(len(w) - 2):
            if count[w[i], w[i + 1], w[i + 2]] > 1:
                cover |= {i, i + 1, i + 2}
        expected.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), len(set(w)), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_distinct_words, r.base_failed) for r in got], expected)
    assert not any(r.kept and (r.base_failed or r.posterior < 0.5) for r in got)
    assert quality_rules.quality(empty_of(docs)).count() == 0


def test_weak_supervision():
    """Three noisy rules and one that always abstains: the posterior finds the hidden class."""
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    votes = np.full((len(good), 5), -1)
    for r in range(4):
        bad_vote = rng.random(len(good)) < np.where(good, 0.01, 0.6)
        votes[:, r] = np.where(bad_vote, 0, np.where(rng.random(len(good)) < 0.8, 1, -1))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table_, share = quality_rules.fit(patterns, counts)
    v = np.where(patterns < 0, 2, patterns)
    log = np.log(table_)[np.arange(5)[None], v].sum(1) + np.log([1 - share, share])
    found = (log[:, 1] >= log[:, 0])[inverse]
    assert (found == good).mean() > 0.95 and abs(share - 0.85) < 0.05
    assert np.all((table_ > 0) & (table_ < 1))
