"""Null ids, rows that repeat, ties, and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, mixing, toxicity
from siltstone.llm.decontamination import decontaminate, keep_clean
from siltstone.llm.exact_dedup import exact_dedup
from siltstone.llm.jaccard_join import keep_one, similar_sets
from siltstone.llm.quality import keep_good
from siltstone.llm.substring_dedup import substring_dedup
from siltstone.llm.token_output import token_output
from siltstone.llm.warc import archive

LONG = " ".join(f"w{k}" for k in range(80))
ROWS = [(None, "a b"), (None, None), (1, LONG), (1, LONG), (2, LONG), (2, LONG), (3, LONG + " more"), (4, ""), (4, ""), (5, "a b")]


@pytest.fixture(scope="module")
def docs(spark):
    names = ["digest", "winner", "size", "parts", "spans", "range", "key", "source_size", "label", "positive", "n", "a", "b", "component", "__mix_id"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    return df.select("*", F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), *[F.lit(k).alias(n) for k, n in enumerate(names[:-1])])


def test_exact_dedup(docs):
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup(docs).collect())
    assert got == [(0, 4, 3, False), (0, 5, 2, False), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 3, 1, True), (4, 4, 3, True), (4, 4, 3, True), (5, 5, 2, True)]


def test_exact_dedup_without_ids(spark):
    """Rows without an id whose text nobody else has, or only others without an id, or only history."""

    def run(rows, history=None):
        frame = lambda x: spark.createDataFrame(x, "doc_id long, text string").repartition(2)
        out = exact_dedup(frame(rows), None if history is None else frame(history)).collect()
        return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["historical"]) for r in out), key=str)

    big = (1 << 53) + 1
    assert run([(1, "a"), (2, "b"), (10, "z"), (None, "a")]) == sorted([(1, 1, 2, True, True), (2, 2, 1, True, True), (10, 10, 1, True, False), (None, 1, 2, False, True)], key=str)
    assert run([(1, "a"), (big, "z"), (None, "q"), (None, "q")]) == sorted([(1, 1, 1, True, True), (big, big, 1, True, False), (None, None, 2, True, False), (None, None, 2, True, False)], key=str)
    assert run([(None, "a"), (None, "b"), (big, "b")], [(7, "a"), (None, "b"), (None, "b")]) == sorted([(None, 7, 2, False, True), (None, big, 4, False, True), (big, big, 4, True, True)], key=str)


def test_substring_dedup(docs):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 80, 0), (1, 80, 0), (2, 80, 80), (2, 80, 80), (3, 81, 80), (4, 0, 0), (4, 0, 0), (5, 2, 0)]


def test_similar_sets(docs):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["class_id"] or 0, r["component_id"] or 0) for r in similar_sets(docs).collect())
    assert got == [(0, 0, 0, 0), (0, 1, 0, 0), (1, 76, 1, 1), (1, 76, 1, 1), (2, 76, 1, 1), (2, 76, 1, 1), (3, 77, 3, 1), (4, 0, 4, 4), (4, 0, 4, 4), (5, 1, 5, 5)]
    assert sorted(r["doc_id"] or 0 for r in keep_one(docs).collect()) == [0, 0, 1, 1, 4, 4, 5]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(13))), (None, "a b"), (2, None)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in decontaminate(docs, bench).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 80, 13), (1, 80, 13), (2, 80, 13), (2, 80, 13), (3, 81, 13), (4, 0, 0), (4, 0, 0), (5, 2, 0)]
    assert sorted(r["doc_id"] or 0 for r in keep_clean(docs, bench).collect()) == [0, 0, 4, 4, 5]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and sum(r["taken"] for r in rows) == round(rows[0]["target"]) == round(1.5 * 405)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 5}


def test_token_output(docs):
    got = sorted(((r["start"], r["n_tokens"], r["doc_id"]) for r in token_output(docs).collect()))
    assert [g[2] for g in got] == [None] * 2 + [1, 1, 2, 2, 3, 4, 4, 5]
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_models(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 1, 0), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(ROWS)
    assert keep_good(docs, labels).columns == docs.columns
    assert {r["lang_pred"] for r in language_id.language_id(docs).collect()} == {"und"}
    taught = docs.withColumn("lang", F.lit("xx"))
    assert sorted(r["lang_pred"] for r in language_id.language_id(taught).collect()) == ["und"] * 3 + ["xx"] * 7


def test_archive(spark):
    big = "x" * 100
    pages = spark.createDataFrame([(None, "u", big), (1, "u", big), (1, "u", big), (2, "u", big), (3, None, None), (3, None, None)], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in archive(pages).collect())
    assert got == [(0, "response", 0), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (3, "response", 0)]


def test_archive_of_any_id(spark):
    ids = [-(1 << 63), -1, 0, 300_000_000_000, (1 << 63) - 1, None, None]
    pages = spark.createDataFrame([(i, f"http://a.org/{k}", "y" * 200) for k, i in enumerate(ids)], "page_id long, url string, html string")
    got = archive(pages).collect()
    assert sorted(r["page_id"] for r in got if r["page_id"] is not None) == sorted(i for i in ids if i is not None) and len(got) == len(ids)
    assert all((r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] in (None, -(1 << 63)) else ("revisit", -(1 << 63))) for r in got)
