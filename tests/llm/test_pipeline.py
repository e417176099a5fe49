"""The pipeline: each stage on its own input, and the whole."""

import corpus_pipeline
from corpusloom.llm.common import cut, table
from tests.llm import brute
from tests.llm.conftest import SF, prose


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), name)
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before.keys()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "near_dedup":
            assert after == {d for d, (_, _, kept) in brute.op9(list(before.items())).items() if kept}
        if name == "decontamination":
            assert after == {d for d, x in brute.op4(list(before.items()), items).items() if not x[-1]}
        if name == "sentencepiece":
            assert after == before.keys() and out.filter("not round_trip").count() == 0
        seen.append(name)
        docs = out
    assert seen == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_odd_rows_and_clashing_columns(spark, odd_rows):
    """Nulls, empty and long texts, ties, repeated rows, other columns with the names that the stages add."""
    rows = [(d, t, None, s, None if t is None else len(t), "x", 1, [7]) for d, t, s in [*odd_rows, odd_rows[3], (None, prose(50, 9), "z")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string, n_ids int, ids array<int>")
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), name)
        if name == "sentencepiece":
            assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_removed", "n_ids", "ids", "_ids", "_n_ids", "round_trip"]
            assert out.filter("not round_trip and text is not null" if "text" in out.columns else "not round_trip").count() == 0
        else:
            assert out.columns == docs.columns
        assert out.filter("n_removed <> 'x' or n_ids <> 1 or ids[0] <> 7").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "quality_rules":
            kept = {r["doc_id"] for r in out.collect()}
            assert not kept & {1, 2, 3, 15, 16} and {4, 5, 6, None} <= kept and out.filter("doc_id = 4").count() == 2
        if name == "near_dedup":
            ids = [r["doc_id"] for r in out.collect()]
            assert 5 not in ids and 6 not in ids and ids.count(4) == 2 and None in ids
        docs = out
