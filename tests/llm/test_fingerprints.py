"""Operator 13 against plain sets of MD5 hashes."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelstack.llm import fingerprints as P

from . import brute
from .conftest import table


def marks(text, k=5):
    return {hashlib.md5(b" ".join(x)).hexdigest()[:16] for x in brute.shingles(text, k)}


def bottom(text, size):
    return sorted(marks(text))[:size]


def near(a, b, size):
    union = sorted(set(a) | set(b))[:size]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def plain(rows, size):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, next_ = bottom(text, size), bottom(edited, size), bottom(after, size)
        yield (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), near(own, other, size), near(own, next_, size))


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("size", [P.SIZE, 4])
def test_edited_fingerprints(docs, rows, size):
    got = P.edited_fingerprints(docs, size=size).drop("kept")
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, size))


@pytest.mark.parametrize("rows", [[(7, "one two three")], [(7, None), (None, None)], [(7, "a b c d e f g h")] * 5 + [(3, "x")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    assert Counter(map(tuple, P.edited_fingerprints(df).drop("kept").collect())) == Counter(plain(rows, P.SIZE))


def test_no_rows(spark, docs):
    assert P.edited_fingerprints(docs.limit(0)).count() == 0
    assert P.fingerprints(docs.limit(0)).count() == 0
    assert P.merge(P.fingerprints(docs.limit(0)), ["doc_id"]).count() == 0


def test_order_over_many_partitions(spark):
    keys = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") != 5, F.col("id") % 300).alias("doc_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("mark"))
    order = [r.key for r in keys.orderBy(F.col("doc_id").asc_nulls_last(), "mark").collect()]
    got = {r.key: r.next for r in P.followers(keys.repartition(13)).collect()}
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_parts_merge_to_the_whole(spark, rows):
    texts = [t for _, t in rows]
    parts = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(9, None), (9, "")], "part int, text string").repartition(6)
    got = P.merge(P.fingerprints(parts, "part"), ["doc_id"])
    expected = {p: sorted(set().union(*(marks(t) for t in texts[p::3])))[: P.SIZE] for p in range(3)}
    assert {r.doc_id: list(r.sketch) for r in got.collect()} == expected
    both = spark.createDataFrame([(texts[3], texts[4])], "a string, b string").select(P.merged(P.sketch(F.col("a")), P.sketch(F.col("b"))).alias("s"), P.read(P.written(P.sketch(F.col("a")))).alias("a")).first()
    assert both.s == sorted(marks(texts[3]) | marks(texts[4]))[: P.SIZE] and both.a == bottom(texts[3], P.SIZE)


def test_estimates(spark):
    """Within four standard errors of the truth, 400 texts of known overlap."""
    pairs = []
    for i in range(400):
        a = [f"a{i}x{j}" for j in range(3000)]
        b = a[: 1500] + [f"b{i}x{j}" for j in range(500)]
        pairs.append((" ".join(a), " ".join(b)))
    s = spark.createDataFrame(pairs, "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    got = s.select(P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("b"), F.col("a")).alias("c"), P.distinct_shingles(F.col("a")).alias("n")).agg(
        F.avg("j").alias("j"), F.avg("c").alias("c"), F.avg("n").alias("n"), F.stddev("j").alias("sd")).first()
    assert abs(got.j - 1496 / 3496) < 0.01 and abs(got.c - 1496 / 1996) < 0.02 and abs(got.n / 2996 - 1) < 0.03
    assert got.sd < 0.06


def test_native_plan_and_sql(spark):
    import duckdb
    from panelstack.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    df = QUERIES["op13_document_fingerprints"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(SQL["op13_document_fingerprints"]).fetchall()
    assert Counter(map(tuple, df.select(*COLUMNS).collect())) == Counter(map(tuple, expected))
