"""Queries that must see every row of their tables."""

import pytest

from corpusloom.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_violations_of_late_items_and_other_orders_are_found(spark, folder):
    # orders 2 and 1002 share an id, 3 and 4 a part in their third items; 5 has four items for a ratio of 4 / 3, 6 has two for 2
    items = [(2, 1, 20), (1002, 1, 21), (3, 3, 30), (4, 3, 30), (5, 1, 50), (5, 2, 51), (5, 3, 52), (5, 4, 53), (6, 1, 60), (6, 2, 61)]
    sf = folder(lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long"))
    found = {tuple(r) for r in registry.QUERIES["corpus_violations"](spark, sf).collect()}
    assert found == {("duplicate task_id", "t2"), ("pdf_url in several tasks", "30"), ("coverage_ratio out of bounds", "t6")}


def test_documents_of_all_languages_are_retrieved(spark, folder):
    filler = [(i, f"anderes wort nummer w{'abcdefghij'[i - 10]}", "en") for i in range(10, 18)]
    docs = [(1, "häuser stehen am ufer", "de"), (2, "les maisons du port", "fr"), (3, "houses stand here", "en"), (4, "houses without language", None), *filler]
    asked = [(7, "häuser am ufer"), (8, "maisons port"), (9, "houses")]
    sf = folder(documents=(docs, "doc_id long, text string, lang string"), benchmark=(asked, "item_id long, text string"))
    got = {(r.qid, r.docno) for r in registry.QUERIES["bm25_top10"](spark, sf).collect()}
    assert got == {(7, 1), (8, 2), (9, 3), (9, 4)}
    assert {r.qid: r.docnos for r in registry.QUERIES["pool_topk"](spark, sf).collect()} == {7: "1", 8: "2", 9: "3,4"}
    stemmed = {(r.lang, r.qid, r.docno, r["rank"]) for r in registry.QUERIES["stemmed_bm25_top10"](spark, sf).collect()}
    assert stemmed == {("de", 7, 1, 1), ("fr", 8, 2, 1), ("en", 9, 3, 1), ("", 9, 4, 1)}


def test_relevant_documents_that_the_run_misses_lower_ndcg(spark, folder):
    docs = [(i, "rare thing", "en") for i in range(1, 13)] + [(50, "some rare thing with a far longer text " * 30, "de")] + [(i, f"other text {i}", "en") for i in range(60, 80)]
    asked = [(1, "Rare thing with"), (2, "no document holds this")]
    sf = folder(documents=(docs, "doc_id long, text string, lang string"), benchmark=(asked, "item_id long, text string"))
    judged = {tuple(r) for r in registry._holders(spark, sf).collect()}
    assert judged == {(1, 50, 1)}
    run = spark.createDataFrame([(1, i, i, 1.0) for i in range(1, 11)], "qid long, docno long, rank int, score double")
    assert [tuple(r) for r in registry.judging.ndcg(run, registry._holders(spark, sf)).collect()] == [(1, 0.0)]
    assert [r.qid for r in registry.QUERIES["ndcg_at_10"](spark, sf).collect()] == [1]
