"""Readers of side files, kept stages, manifests, tools for PDFs, models that callers bring."""

import json
import logging
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.functions import counts, facts, papers
from corpusloom.operators import islands, judging, metrics, review, stages, tasks
from corpusloom.sources import content, files, pdf, sinks, web

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def task(task_id, confidence="high"):
    return {"task_id": task_id, "venue": "V", "parent_venue": "C", "year": 2023, "task_name": "T", "ceur_volume": "1", "overview": {"pdf_url": f"o{task_id}", "title": "O", "authors": [], "is_umbrella": False}, "participants": [{"title": "P", "authors": ["A"], "pdf_url": f"p{task_id}", "team_name": None}], "provenance": {"task_assignment_method": "m", "confidence": confidence, "extracted_at": "x"}}


def test_candidates_by_confidence_and_id(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(task(i, c)) for i, c in (("a", "high"), ("b", "medium"))))
    ids = lambda *a, **k: [r["task_id"] for r in files.candidates(spark, str(path), *a, **k).orderBy("task_id").collect()]
    assert ids() == ["a"] and ids("all") == ["a", "b"] and ids("medium", task_id="b") == ["b"]
    for args in (("low-ish",), ("high", "b")):
        with pytest.raises(ValueError):
            ids(*args)


def test_side_files_are_optional_but_missing_ones_are_named(spark, tmp_path, caplog):
    (tmp_path / "counts").mkdir()
    (tmp_path / "counts/a.json").write_text(json.dumps({"teams": 16, "runs": None}, indent=2))
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.json").write_text(json.dumps([{"pdf_url": "pa", "code_urls": [{"url": "u", "status": "200", "evidence": True}], "third_party_urls": [], "tira_refs": ["t"]}]))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(task(i)) for i in "ab"))
    found = files.candidates(spark, str(tmp_path / "c.jsonl"))
    told = files.counts(spark, str(tmp_path / "counts"))
    with caplog.at_level(logging.WARNING):
        assert [r[0] for r in stages.warn_missing(found, told, "task_id", "counts file").collect()] == ["b"]
    assert "b: no counts file" in caplog.text
    got = {r["task_id"]: r["counts"] for r in tasks.join_counts(found, told).collect()}
    assert got["a"]["coverage_ratio"] == 0.062 and got["a"]["ratio"] == 0.0625 and got["b"]["coverage_ratio"] is None  # as Python rounds
    links = tasks.join_links(tasks.participants(found), files.code_links(spark, str(tmp_path / "code")))
    assert {r["pdf_url"]: (r["code_urls"], r["tira_refs"]) for r in links.collect()} == {"pa": (["u"], ["t"]), "pb": ([], [])}
    (tmp_path / "counts/b.json").write_text("[1]")
    with pytest.raises(ValueError, match="b.json"):
        files.counts(spark, str(tmp_path / "counts"))


def test_kept_results_are_not_computed_again(spark, tmp_path):
    todo = spark.createDataFrame([(i, i * i) for i in range(4)], "id long, v long")
    path = str(tmp_path / "kept")
    first = stages.resume(todo.filter("id < 2"), path, "id", lambda df: df.withColumn("by", F.lit("first")))
    assert {r["by"] for r in first.collect()} == {"first"}
    both = stages.resume(todo.filter("id > 0"), path, "id", lambda df: df.withColumn("by", F.lit("second")))
    assert {(r["id"], r["by"]) for r in both.collect()} == {(1, "first"), (2, "second"), (3, "second")}


def test_manifest_upserts_and_asks_for_ocr(spark, tmp_path):
    rows = [("t", "overview", "u1", "t/overview.md", "x" * 9000, 3, 2, 0, 0), ("t", "participant", "u2", "t/participants/p.md", "x" * 100, 5, 0, 1, 1), ("t", "participant", "u3", "t/participants/q.md", "x" * 9000, None, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "task_id string, role string, pdf_url string, markdown_path string, text string, pages int, n_figures int, n_tables int, n_table_images int")
    records = stages.document_records(docs)
    got = {r["pdf_url"]: r for r in records.collect()}
    assert not got["u1"]["needs_ocr"] and got["u1"]["figures_dir"] == "t/figures/overview" and got["u1"]["chars_per_page"] == 3000.0
    assert got["u2"]["needs_ocr"] and got["u2"]["quality_flags"] == ["only 20.0 chars/page", "only 100 chars extracted in total"] and got["u2"]["tables_dir"] == "t/tables/p"
    assert got["u3"]["quality_flags"] == ["page count could not be determined"]
    assert not stages.document_records(docs, ocr_used=True).filter("needs_ocr").count()
    path = str(tmp_path / "manifest")
    assert stages.write_manifest(records.filter("pdf_url <> 'u3'"), path).count() == 2
    again = stages.document_records(docs.filter("pdf_url <> 'u1'").withColumn("text", F.repeat(F.lit("y"), 5000)), ocr_used=True)
    assert stages.write_manifest(again, path).count() == 3
    read = files.manifest(spark, path)
    assert {r["pdf_url"]: r["ocr_server_used"] for r in read.collect()} == {"u1": False, "u2": True, "u3": True}
    told = sinks.texts_markdown(records, "2026-01-01")
    assert "| participant | 2 | 9100 |" in told and "| t | u2 | only 20.0 chars/page; only 100 chars extracted in total |" in told


def test_markers_settings_and_figures_of_use(spark, tmp_path):
    stages.write_marker(spark, str(tmp_path), "de")
    assert stages.read_marker(spark, str(tmp_path)) == "de"
    assert stages.required(["A"], {"A": " x "}) == {"A": "x"}
    with pytest.raises(ValueError, match="B, C"):
        stages.required(["A", "B", "C"], {"A": "x", "B": " "})
    n, told = stages.measured(spark, "count", lambda: spark.range(1000).repartition(3).count(), str(tmp_path / "use"))
    assert n == 1000 and told["jobs"] >= 1 and told["stages"] >= 1
    assert any(r[0].startswith("wallclock_ms: ") for r in spark.read.text(str(tmp_path / "use")).collect())


def read(content):
    return content.decode() if content != b"bad" else 1 / 0


def look(content):
    return {"pages": len(content), "complex": False, "geometry": [{"page": 1, "width": 600.0, "height": 800.0, "lines": [{"x1": 1.0, "x2": 300.0, "y1": y, "y2": y} for y in (10.0, 20.0)]}]}


def test_tools_for_pdfs(spark, tmp_path):
    for name, content in (("a.pdf", b" text "), ("b.PDF", b"bad"), ("c.pdf", b" \n"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    found = pdf.pdf_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    got = {r["path"]: (r["text"], (r["failure"] or "").split(":")[0]) for r in pdf.extract_texts(found, read).collect()}
    assert got == {"a.pdf": ("text", ""), "b.PDF": (None, "ZeroDivisionError"), "c.pdf": (None, "no text")}
    assert pdf.command("cat")(b"x") == "x"
    pages = pdf.ruled_pages(pdf.probe(found.filter("path = 'a.pdf'"), look))
    regions = islands.table_regions(islands.rules(pages)).collect()
    assert [(r["doc"], r["page"], r["y0"], r["y1"]) for r in regions] == [("a.pdf", 1, 10.0, 20.0)]
    failed = pdf.probe(found.filter("path = 'b.PDF'"), read).first()
    assert failed["pages"] is None and failed["failure"].startswith("ZeroDivisionError")


def test_tables_are_written_as_files(spark, tmp_path):
    docs = spark.createDataFrame([("p", "| a |\n|---|\n| 1 |\ntext\n| b |\n| 2 |")], "doc string, text string")
    tables = islands.markdown_tables(docs, "doc", "text")
    assert sinks.write_files(sinks.table_files(tables), str(tmp_path)) == 2
    assert (tmp_path / "p/table-02.md").read_text() == "| b |\n| 2 |\n"
    with pytest.raises(Exception, match="below"):
        sinks.write_files(spark.createDataFrame([("../x", "t")], "path string, text string"), str(tmp_path / "in"))


def stub(request):
    labels = {"d1": 3, "d2": True}
    return [{"label": labels.get(c["docid"], 0), "record": json.dumps({"of": c["docid"]})} for c in request["candidates"]]


def test_judging_with_a_model(spark):
    pools = spark.createDataFrame([("q1", ["d0", "d1"]), ("q2", ["d2"])], "qid string, docnos array<string>")
    asked = judging.requests(pools, spark.createDataFrame([("q1", "x"), ("q2", "y")], "qid string, text string"), spark.createDataFrame([(f"d{i}", "t") for i in range(3)], "docno string, text string"))
    said = judging.align_responses(pools, judging.judge(asked, stub))
    got = {r["qid"]: [(j["docno"], j["judgment"]) for j in r["judgments"]] for r in said.collect()}
    assert got == {"q1": [("d0", 0), ("d1", 3)], "q2": [("d2", None)]}
    assert [tuple(r) for r in judging.invalid_responses(pools, said).collect()] == [("q2", "label out of range")]  # a boolean is no label
    assert judging.stale_requests(asked, asked).isEmpty()
    other = asked.withColumn("request", F.col("request").withField("query.text", F.lit("new")))
    assert sorted(r[0] for r in judging.stale_requests(asked, other).collect()) == ["q1", "q2"]
    counted = judging.label_histogram(judging.qrels(said).filter("rel is not null"))
    assert [r[0] for r in sinks.histogram_lines(counted).collect()] == ["topic\t0\t1\t2\t3\ttotal", "q1\t1\t0\t0\t1\t2"]


def answer(prompt, most_tokens):
    assert most_tokens == 50 and "EVIDENCE_JSON" in prompt
    if "c2" in prompt.split("\n")[0]:
        return {"finish_reason": "length", "reasoning": "abc"}
    if "c3" in prompt.split("\n")[0]:
        raise TimeoutError("late")
    return {"content": '{"antrag": "c1", "result": "abgelehnt", "begruendung": "Zu spät."}'}


def test_cases_are_decided_by_a_model(spark):
    docs = spark.createDataFrame([("c1", "a.pdf", "Kosten 10"), ("c2", "a.pdf", "nichts"), ("c3", "a.pdf", "x")], "case_id string, filename string, text string")
    due = docs.select("case_id", "filename").unionByName(spark.createDataFrame([("c1", "b.pdf")], "case_id string, filename string"))
    bundles = {r["case_id"]: (r["missing"], r["complete"]) for r in review.evidence(docs, due).collect()}
    assert bundles == {"c1": (["b.pdf"], False), "c2": ([], True), "c3": ([], True)}
    got = {r["case_id"]: (r["result"], r["problem"]) for r in review.decide(docs, answer, due, most_tokens=50).collect()}
    assert got == {"c1": ("abgelehnt", None), "c2": (None, "no final content (finish reason length, 3 characters of reasoning)"), "c3": (None, "no final content (finish reason TimeoutError: late, 0 characters of reasoning)")}
    with pytest.raises(ValueError):
        review.decide(docs, answer, most_tokens=0)


def test_tools_of_an_agent(spark):
    assert sorted(review.TOOLS) == ["check_facts", "list_case_documents", "lookup_policy", "read_pdf", "search_case"]
    docs = spark.createDataFrame([("c1", "a.pdf", "t"), ("c2", "b.pdf", "u")], "case_id string, filename string, text string")
    assert review.TOOLS["read_pdf"](docs, "c1", "a.pdf", allowed="c1").first()["text"] == "t"
    for args in (("c2", "b.pdf", "c1"), ("c3", "a.pdf"), ("c1", "../a.pdf")):
        with pytest.raises(ValueError):
            review.TOOLS["read_pdf"](docs, *args)
    comparison = "array<struct<name:string,left:string,operator:string,right:string>>"
    schema = f"kind string, comparisons {comparison}, amounts array<string>, expected string, tolerance string, left array<string>, right array<string>, present array<string>, required array<string>"
    empty = [None] * 8
    rows = [
        ("compare_dates", [("start", "1.3.2026", "<", "2026-03-02"), ("end", "2.3.26", ">", "2026-03-02")], *empty[1:]), ("compare_dates", [("x", "soon", "<", "2026-03-02")], *empty[1:]), ("compare_dates", [], *empty[1:]),
        ("sum_amounts", None, ["0.1", "0.2"], "0.31", None, *empty[:4]), ("sum_amounts", None, ["0.1", "0.2"], "0.32", "0.001", *empty[:4]), ("sum_amounts", None, [], "1", None, *empty[:4]),
        ("overlap", None, None, None, None, ["A", "b"], ["a", "C"], None, None), ("required_fields", *empty[:6], ["A"], ["a", "B"]), ("other", *empty),
    ]
    got = [(json.loads(r["result"]) if r["result"] else None, r["problem"]) for r in review.check_facts(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert [x["passed"] for x in got[0][0]["results"]] == [True, False] and got[0][0]["results"][1]["name"] == "end"
    assert got[1][1] == "a date or an operator can't be read" and got[2][1] == "no comparisons" and got[5][1] == "no amounts"
    assert got[3][0]["passed"] and not got[4][0]["passed"]
    assert got[6][0] == {"overlap": ["a"], "has_overlap": True} and got[7][0] == {"missing": ["b"], "complete": False} and got[8][1].startswith("kind must be")


def test_ids_must_match_before_scores(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, summary string")
    assert metrics.checked_pairs(rows, rows).count() == 2
    with pytest.raises(ValueError, match="missing: b"):
        metrics.checked_pairs(rows.filter("id = 'a'"), rows)


def test_team_counts_are_discarded_by_ratio_only_if_it_is_known(spark):
    rows = spark.createDataFrame([("20 participating teams", 10), ("4 participating teams", 14), ("4 participating teams", None)], "t string, n int")
    assert [r[0] for r in rows.select(counts.team_count(F.col("t"), F.col("n"))).collect()] == [20, None, 4]


def test_small_functions(spark):
    one = spark.createDataFrame([("T", "A", "![](img_p1.png) ![](other.png)")], "t string, a string, m string")
    assert one.select(papers.summary(F.col("t"), F.col("a")), papers.summary(F.col("t"), F.col("a"), "title")).first()[:] == ("T\n\nA", "T")
    with pytest.raises(ValueError):
        papers.summary(F.col("t"), F.col("a"), "all")
    assert one.select(papers.figure_links(F.col("m"), "figures/x")).first()[0] == "![](figures/x/img_p1.png) ![](other.png)"
    assert one.select(facts.sum_amounts(F.array(F.lit("1.005")), F.lit("1"))["passed"]).first()[0]


def test_archives_are_listed_and_none_is_an_error(spark, tmp_path):
    for name in ("b.warc.gz", "a.warc.gz"):
        (tmp_path / name).write_bytes(b"x")
    assert [x.rsplit("/", 1)[1] for x in web.archives(spark, f"{tmp_path}/*.warc.gz")] == ["a.warc.gz", "b.warc.gz"]
    with pytest.raises(ValueError, match="no archives"):
        web.read_warc(spark, f"{tmp_path}/*.none")


def test_pages_with_unmatched_tags_take_linear_time():
    import time

    began = time.process_time()
    page = content.parse("<span>" * 16_000 + "</div>" * 16_000 + "text")
    assert content.densest(page) == ["text"]
    assert time.process_time() - began < 2
