"""Licence notices found by MinHash bands over text windows and verified by containment (operator 9).

Only DataFrame expressions: words and shingle hashes are arrays of each row, windows overlap by half, so a
notice of up to STRIDE + 1 words lies whole in one of them. A window's one-permutation MinHash has 2^BIN_BITS
bins, each a band of one row; it retrieves the notices that share a band. A shingle of the notice misses its
band only if another shingle of the window falls into its bin with a smaller hash: at most 20 / 2^15 for one
shingle, and all shingles of the notice must miss. Retrieved notices are verified by the exact share of their
shingles that the window holds.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
STRIDE = 12
WINDOW = 2 * STRIDE
BIN_BITS = 14
#: Wordings of common public notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "BSD": "Redistribution and use in source and binary forms, with or without modification",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "under the terms of the GNU General Public License, version 2",
    "LGPL": "under the terms of the GNU Lesser General Public License",
    "AGPL": "under the terms of the GNU Affero General Public License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0": "dedicated to the public domain under CC0 1.0",
    "ARR": "All rights reserved.",
}
#: Whatever is not a letter, a digit or outside ASCII parts words.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often or in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of every SHINGLE consecutive words; fewer words have none."""
    count = F.size(w) - (SHINGLE - 1)
    hashed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    return F.when(count > 0, hashed).otherwise(F.array().cast("array<long>"))


def notice_table(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, and the distinct shingles of its notice (15 rows, or as many as the caller gives)."""
    df = spark.createDataFrame(list(notices.items()), "license string, text string")
    return df.select("license", F.size(words(F.col("text"))).alias("n"), let(words(F.col("text")), lambda w: F.array_distinct(shingles(w))).alias("wanted"))


def bin_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, license, containment, n_windows, first_word.

    containment is the largest share of the notice's distinct 3-word shingles in one window, at least
    ``percent`` / 100; n_windows the windows that reach it, first_word the start of the first. Words are runs of
    letters, digits and non-ASCII after lower-casing A-Z. Null, empty and clean texts give no row, repeated
    rows of a document count together, other columns are not read. Notices must have 3 to STRIDE + 1 words.
    """
    spark = docs.sparkSession
    table = notice_table(spark, notices)
    wanted = table.collect()  # the notices are a parameter, not data
    for r in wanted:
        if not SHINGLE <= r.n <= STRIDE + 1:
            raise ValueError(f"notice {r.license} has {r.n} words; it must have {SHINGLE} to {STRIDE + 1}")
    bands = [x for r in wanted for x in r.wanted]

    def window(held: Column, start: Column) -> Column:
        hit = F.filter(held, lambda x: x.isin(bands) & ~F.exists(held, lambda y: (bin_of(y) == bin_of(x)) & (y < x)))
        return F.struct(start.alias("first_word"), hit.alias("bands"), held.alias("held"))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - 1, F.lit(STRIDE))
        cut = F.transform(starts, lambda o: let(F.slice(h, o + 1, WINDOW - SHINGLE + 1), lambda held: window(held, o)))
        return F.when(F.size(h) > 0, F.filter(cut, lambda w: F.size(w["bands"]) > 0))

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(let(words(F.col(text_col)), lambda w: let(shingles(w), windows))).alias("w"))
    lists = F.broadcast(table.select("license", "wanted"))  # a parameter's few rows
    retrieved = found.join(lists, F.arrays_overlap("w.bands", "wanted"))
    share = F.size(F.array_intersect("wanted", "w.held")) / F.size("wanted")
    matched = retrieved.select("doc_id", "license", "w.first_word", share.alias("share")).where(F.col("share") * 100 >= percent)
    return matched.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").cast("long").alias("first_word"))


def sql(notices: dict[str, str] = NOTICES, percent: int = 80) -> str:
    """DuckDB text of ``scan``: containment in every window, by the words themselves."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in notices.items())
    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{}', '{}'), '{}'), lambda w: w <> '')".format(string.ascii_uppercase, string.ascii_lowercase, SEPARATORS)
    return f"""
WITH notices(license, text) AS (VALUES {quoted}),
n AS (SELECT license, {split} AS w FROM notices),
wanted AS (SELECT DISTINCT license, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT license, w, unnest(range(1, len(w) - 1)) AS i FROM n)),
sizes AS (SELECT license, count(*) AS size FROM wanted GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
s AS (SELECT r, doc_id, i - 1 AS pos, len(w) - 2 AS total, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d)),
hits AS (SELECT r, doc_id, pos, total, license, wanted.s FROM s JOIN wanted USING (s)),
windows AS (SELECT r, doc_id, license, s, unnest([pos // {STRIDE}, pos // {STRIDE} - 1]) AS k, pos FROM hits),
shares AS (SELECT r, doc_id, license, k, count(DISTINCT s) AS held FROM windows
           WHERE k >= 0 AND pos < k * {STRIDE} + {WINDOW - SHINGLE + 1} GROUP BY r, doc_id, license, k),
ok AS (SELECT doc_id, license, k, held / size AS share FROM shares JOIN sizes USING (license) WHERE held / size * 100 >= {percent})
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(k) * {STRIDE} AS first_word FROM ok GROUP BY doc_id, license"""
