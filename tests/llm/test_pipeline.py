"""The pipeline's stages on their own input, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

from . import brute
from .conftest import rows_of
from .test_operators import hits, items_of, line_order, toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = rows_of()
    toxic = [(1000 + i, t, y) for i, t, y in toxic_rows(n=300)]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows] + [(i, t, "en", None, len(t)) for i, t, _ in toxic]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic] + [(i, 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([x for x in items_of(rows) if x[0] != 10], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(C, "LINE_TEXTS", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"] and C.ORACLE_SQL is None
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    kept = C.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    before, after = plain(docs), plain(kept)
    gone = [i for i, _ in set(before) - set(after)]
    assert sum(labels[i] for i in gone) >= 70 and sum(labels[i] == 0 for i in gone) <= 3  # 75 are toxic

    edited = C.drop_repeated_lines(spark, kept, sf_dir)
    assert edited.columns == docs.columns
    expected = brute.line_dedup([t for _, t in after], 3, 0.8, line_order)
    assert plain(edited) == sorted(((i, e[0]) for (i, _), e in zip(after, expected)), key=str)
    assert edited.where("n_chars != length(text)").count() == 0

    rows = plain(edited)
    unique = C.drop_near_duplicates(spark, edited, sf_dir)
    assert unique.columns == docs.columns
    linked = brute.jaccard(rows, 5, 80)
    stays = {(i, t) for (i, t), (n, c, _) in zip(rows, linked) if c == i}
    assert set(plain(unique)) == stays and len([x for x in plain(unique) if brute.words(x[1])]) == len({x for x in stays if brute.words(x[1])})
    assert len(plain(unique)) - len([x for x in plain(unique) if brute.words(x[1])]) == len([x for x in rows if not brute.words(x[1])])

    rows = plain(unique)
    clean = C.drop_contaminated(spark, unique, sf_dir)
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert plain(clean) == [(i, t) for (i, t), h in zip(rows, hits(rows, items, 10)) if not h[-1]]
    assert len(plain(clean)) < len(rows)

    ids = C.encode_pieces(spark, clean, sf_dir)
    assert ids.count() == clean.count() and ids.where("n_tokens != size(ids)").count() == 0


def test_run(spark, sf_dir):
    out = C.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decodes"] and 0 < out.count() < 369
    assert out.where(F.col("ids")[0] != 1).count() == 0 and np.all([r.n_tokens >= 2 for r in out.collect()])


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert C.encode_pieces(spark, docs, sf_dir).count() == 0


NEAR = " ".join(f"word{i}" for i in range(60))


def test_near_duplicates_of_repeated_and_missing_ids(spark, sf_dir):
    """One row a component, whatever its ids; rows without words all stay."""
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(8, NEAR), (8, NEAR + " end"), (None, NEAR + " tail"), (8, other), (None, other + " x"), (5, ""), (5, ""), (5, None), (5, None), (6, " \n"), (7, "lone words here"), (7, "lone words here")]
    extra = [(*r, f"l{i}", None if i % 2 else "s", i, i, "g", 0.5) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, SCHEMA + ", __row_key int, __gone string, __again double").repartition(4)
    out = C.drop_near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text, r.lang) for r in out.collect()]
    assert sorted(x[0] for x in got if brute.words(x[1])) == [7, 8, 8]
    assert {x[1].split()[0] for x in got if x[0] == 8} == {"word0", "other0"}
    assert (7, "lone words here", "l10") in got  # the first by its other columns
    assert sorted(map(str, (x[:2] for x in got if not brute.words(x[1])))) == sorted(map(str, (r for r in rows if not brute.words(r[1]))))
    # repeated rows without words do not change what happens to others
    assert sorted(map(str, plain(C.drop_near_duplicates(spark, docs.where("doc_id = 5"), sf_dir)))) == sorted(map(str, [(5, ""), (5, ""), (5, None), (5, None)]))


def test_one_id_for_all_rows_is_linear(spark):
    """The join that fetches the texts of classes gives a row a text, not one for every pair of them."""
    from panelstack.llm import jaccard_join

    sets_of = jaccard_join._sets_of
    counted = spark.sparkContext.accumulator(0)

    def counting(words):
        work = sets_of(words)

        def run(batches):
            def passed():
                for b in batches:
                    counted.add(b.num_rows)
                    yield b

            yield from work(passed())

        return run

    jaccard_join._sets_of = counting
    try:
        rows = [(1, NEAR + f" e{i}") for i in range(150)] + [(None, NEAR + f" f{i}") for i in range(150)]
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    finally:
        jaccard_join._sets_of = sets_of
    assert {r.component_id for r in got} == {1} and {r.n_links for r in got} == {299} and 0 < counted.value <= 600
