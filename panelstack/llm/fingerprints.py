"""Bottom-k fingerprints of documents (operator 13), by DataFrame expressions only.

A fingerprint holds the k smallest distinct hashes of a text's five-word shingles: the first 16 hex digits of
their MD5, so SQL engines agree on it and text order is numeric order. Sketches of parts merge into that of the
whole (the k smallest of their union). From two sketches follow the resemblance of the texts (the share of the k
smallest of the union that both hold), the number of distinct shingles (from the k-th smallest hash) and the
containment of one in the other. Texts with fewer than k shingles are described exactly.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_scan import let
from .store import saved

SHINGLE = 5
SIZE = 128
DIGITS = 16
SPACE = r"[\x20\x09-\x0D]+"


def hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of every ``shingle`` consecutive words; a text of fewer words has them all as one; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)

    def of(w: Column) -> Column:
        n = F.size(w)
        mark = lambda x: F.substring(F.md5(x), 1, DIGITS)
        joined = lambda i: F.concat(*(x for j in range(shingle) for x in ([F.lit(" ")] if j else []) + [F.get(w, i + j)]))
        every = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: mark(joined(i)))
        return F.when(n >= shingle, every).when(n > 0, F.array(mark(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(lowered, SPACE), lambda w: w != ""), of)


def least(marks: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(marks)), 1, size)


def sketch(text: Column, size: int = SIZE) -> Column:
    """The sorted ``size`` smallest distinct hashes of a text's shingles."""
    return least(hashes(text), size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both parts together."""
    return least(F.concat(a, b), size)


def written(marks: Column) -> Column:
    """A sketch as text: its hashes one after another."""
    return F.array_join(marks, "")


def read(text: Column) -> Column:
    """A sketch from its text."""

    def of(t: Column) -> Column:
        n = (F.length(t) / DIGITS).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * DIGITS + 1, F.lit(DIGITS)))).otherwise(F.array().cast("array<string>"))

    return let(text, of)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches; 1 if neither has a shingle."""
    return let(merged(a, b, size), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(marks: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    last = F.conv(F.get(marks, F.lit(size - 1)), 16, 10).cast("decimal(20,0)").cast("double")
    return F.when(F.size(marks) < size, F.size(marks).cast("double")).otherwise((size - 1) * 2.0**64 / last)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first text's distinct shingles that the second holds; 1 if the first has none."""
    both = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, size)))


def merge(sketches: DataFrame, by: list[str], sketch_col: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch for each value of ``by``, from any number of parts.

    Equal hashes are taken together before the shuffle and only the ``size`` smallest of a group leave a
    partition, so a group may hold any share of the rows. Null and empty sketches add nothing; a group of such
    sketches only has no row.
    """
    marks = sketches.select(*by, F.explode(sketch_col).alias("_mark")).distinct()
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_mark"))
    kept = marks.withColumn("_nth", nth).where(F.col("_nth") <= size)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list("_mark")).alias(sketch_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, sketch, fingerprint and distinct_shingles (estimated) of every row; texts that are null, empty or
    without words have an empty sketch."""
    marked = docs.select(F.col(id_col).alias("doc_id"), sketch(F.col(text_col), size).alias("sketch"))
    return marked.select("doc_id", "sketch", written(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), size).alias("distinct_shingles"))


def followers(keys: DataFrame) -> DataFrame:
    """``key`` and ``next``, the following key by (doc_id, mark), nulls last; the first key follows the last one.

    Keys are sorted by ranges and numbered within each; only the least and greatest number of a range, as many
    rows as there are partitions, are looked at together.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
    ranked = saved(keys.repartitionByRange(*order).sortWithinPartitions(*order).select("key", F.monotonically_increasing_id().alias("nth")), "document-order")
    ends = ranked.groupBy(F.shiftright("nth", 33).alias("part")).agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
    links = ends.select(F.col("high").alias("nth"), F.lead("low").over(Window.orderBy("part")).alias("after"))
    first = ends.agg(F.min("low").alias("first"))
    links = F.broadcast(links.crossJoin(first).select("nth", F.coalesce("after", "first").alias("after")))
    after = ranked.join(links, "nth", "left").select("key", F.coalesce("after", F.col("nth") + 1).alias("nth"))
    return after.join(ranked.withColumnRenamed("key", "next"), "nth").select("key", "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next document.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    kept: the estimated containment of the edited text's shingles in the own ones. The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by (id, MD5 of the
    text), nulls last; after the last comes the first, which may be itself. A null text is empty. Rows alike in
    id and text are one key, so that a hot one is put together before the shuffle, and follow each other: all but
    one of them have themselves as next document. Other columns are not read; no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.md5(text)
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), mark).alias("key")
    keys = saved(docs.groupBy(F.col(id_col).alias("doc_id"), mark.alias("mark"), key).agg(F.max(F.char_length(text)).cast("long").alias("n"), F.count("*").alias("many")), "document-keys")
    # for each key, whose next document it is and how many of its code points that one takes
    before = keys.select("key", "doc_id", "many", F.floor(F.col("n") / 2).cast("int").alias("take"))
    wants = followers(keys).join(before, "key").select(F.col("next").alias("key"), F.col("key").alias("before"), "doc_id", "many", "take")
    wants = saved(wants, "document-takes")
    whole = docs.select(key, text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))  # one shuffle for both joins
    pack = F.unhex(written(sketch(F.col("text"), size)))
    taken = whole.join(wants, "key").select(F.col("before").alias("key"), "doc_id", "many", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("put"), pack.alias("packed"))
    both = whole.join(taken, "key")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - half)
    here = both.select("doc_id", n.cast("long").alias("n_chars"), "many", head.alias("head"), sketch(F.col("text"), size).alias("own"), F.substring(F.col("text"), F.lit(1), half).alias("put_own"), "put",
                       read(F.lower(F.hex("packed"))).alias("after"))
    variant = lambda put, after, times: F.struct(F.concat("head", put).alias("edited"), after.alias("after"), times.alias("times"))
    variants = F.filter(F.array(variant(F.col("put"), F.col("after"), F.lit(1).cast("long")), variant(F.col("put_own"), F.col("own"), F.col("many") - 1)), lambda v: v["times"] > 0)
    cut = here.select("doc_id", "n_chars", "own", F.explode(variants).alias("v")).select("doc_id", "n_chars", "own", "v.after", "v.times", F.sha2("v.edited", 256).alias("edited_sha256"), sketch(F.col("v.edited"), size).alias("other"))
    own, other, after = F.col("own"), F.col("other"), F.col("after")
    out = cut.select(F.col("doc_id").cast(id_type).alias("doc_id"), "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(other).alias("edited_fingerprint"),
                     resemblance(own, other, size).alias("near_edited"), resemblance(own, after, size).alias("near_next"), containment(other, own, size).alias("kept"), "times")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def sql(size: int = SIZE) -> str:
    """DuckDB text of ``edited_fingerprints`` over documents."""
    lowered = f"translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r, count(*) OVER () AS c FROM documents),
e AS (SELECT a.r, a.doc_id, a.t AS own, b.t AS after, length(a.t) AS n, substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS other
      FROM d a JOIN d b ON b.r = a.r % a.c + 1),
w AS (SELECT r, k, list_filter(regexp_split_to_array({lowered}, '{SPACE}'), lambda y: y <> '') AS w
      FROM (SELECT r, 'own' AS k, own AS x FROM e UNION ALL SELECT r, 'other', other FROM e UNION ALL SELECT r, 'after', after FROM e)),
m AS (SELECT r, k, CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: left(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), {DIGITS}))
                        WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), {DIGITS})] ELSE [] END AS m FROM w),
s AS (SELECT r, k, list_sort(list_distinct(m))[1:{size}] AS s FROM m),
p AS (SELECT r, max(s) FILTER (k = 'own') AS own, max(s) FILTER (k = 'other') AS other, max(s) FILTER (k = 'after') AS after FROM s GROUP BY r),
u AS (SELECT r, own, other, after, list_sort(list_distinct(own || other))[1:{size}] AS ue, list_sort(list_distinct(own || after))[1:{size}] AS ua FROM p),
f AS (SELECT r, own, other, CASE WHEN len(ue) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(ue, own), other)) / len(ue) END AS near_edited,
             CASE WHEN len(ua) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(ua, own), after)) / len(ua) END AS near_next, ue FROM u)
SELECT e.doc_id, e.n AS n_chars, sha256(e.other) AS edited_sha256, array_to_string(f.own, '') AS fingerprint, array_to_string(f.other, '') AS edited_fingerprint,
       CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next
FROM e JOIN f USING (r)"""
