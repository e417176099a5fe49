import pytest
from pyspark.sql import functions as F

from corpusloom.operators import islands, metrics, review, tasks

PAPER = "parent_venue string, year int, volume string, section string, section_no int, position int, title string, authors array<string>, pdf_url string"


def papers(spark, *titles, section="LifeCLEF: Plants"):
    return spark.createDataFrame([("CLEF", 2023, "9999", section, 0, i, t, ["A"], f"u{i}") for i, t in enumerate(titles, 1)], PAPER)


def built(spark, *titles, **kw):
    return {r["overview"]["title"]: r for r in tasks.build_tasks(papers(spark, *titles, **kw), "2026-01-01").collect()}


def test_one_overview_takes_all_others(spark):
    got = built(spark, "Overview of Plant Search", "Team XY at LifeCLEF 2023", "Best of Labs: Old", "Another")
    (task,) = got.values()
    assert [p["title"] for p in task["participants"]] == ["Team XY at LifeCLEF 2023", "Another"]
    assert task["participants"][0]["team_name"] == "XY"
    assert task["provenance"]["confidence"] == "high" and task["task_id"] == "clef2023-lifeclef-plant-search"


def test_first_paper_stands_in_for_a_missing_overview(spark):
    assert list(built(spark, "Plant Search in General", "Team X at Y")) == ["Plant Search in General"]


def test_titles_decide_among_overviews_and_ties_are_dropped(spark):
    got = built(spark, "Overview of FungiCLEF", "Overview of GeoLifeCLEF", "Overview of PlantCLEF", "Finding Plant Leaves", "Geo Life of Fungi and Fungi", "Unrelated")
    assert list(got) == ["Overview of PlantCLEF", "Overview of GeoLifeCLEF"] or set(got) == {"Overview of PlantCLEF", "Overview of GeoLifeCLEF"}
    assert got["Overview of PlantCLEF"]["provenance"]["task_assignment_method"] == "title_heuristic"
    assert not built(spark, "Overview of A Report", "Overview of B Report", "The Report")


def test_another_task_number_lowers_confidence_and_several_make_an_umbrella(spark):
    (task,) = built(spark, "Overview of Task 1 on Plants", "Leaves for Task 2").values()
    assert task["provenance"]["confidence"] == "medium"
    (task,) = built(spark, "Overview of Plants", "Leaves for Task 2", "Roots for Task 1").values()
    assert task["overview"]["is_umbrella"] and task["provenance"]["confidence"] == "high"


def test_no_participants_no_task(spark):
    assert not built(spark, "Overview of Plants")


def test_authors_of_the_second_bibliography(spark):
    rows = papers(spark, "A Title!", "No Match", "Empty")
    other = spark.createDataFrame([("a title", ["Old"], 0), ("A-Title", ["New"], 1), ("empty", [], 2)], "title string, authors array<string>, ord int")
    got = {r["title"]: (r["authors"], r["dblp_match"]) for r in tasks.match_authors(rows, other).collect()}
    assert got == {"A Title!": (["New"], True), "No Match": (["A"], False), "Empty": (["A"], True)}


def corpus(spark):
    made = tasks.build_tasks(papers(spark, "Overview of Plants", "X at Y", "Z at Y").unionByName(papers(spark, "Overview of Birds", "W at Y", section="BirdCLEF: B").withColumns({"section_no": F.lit(1), "pdf_url": F.concat(F.lit("b"), "pdf_url")})), "2026-01-01")
    counts = spark.createDataFrame([("clef2023-lifeclef-plants", 4, 9)], "task_id string, teams int, runs int")
    return tasks.join_counts(made, counts)


def test_counts_links_texts_and_ranking(spark):
    got = corpus(spark)
    by_id = {r["task_id"]: r["counts"] for r in got.collect()}
    assert by_id["clef2023-lifeclef-plants"]["coverage_ratio"] == 0.5 and by_id["clef2023-birdclef-birds"]["coverage_ratio"] is None
    assert [r["task_id"] for r in tasks.select_corpus(got).collect()] == ["clef2023-lifeclef-plants", "clef2023-birdclef-birds"]
    assert len(tasks.select_corpus(got, 1).collect()) == 1
    links = spark.createDataFrame([("clef2023-lifeclef-plants", "u2", [("http://x", "200", True), ("http://d", "404", False)], ["t"], ["tira"])], "task_id string, pdf_url string, code_urls array<struct<url:string,status:string,evidence:boolean>>, third_party_urls array<string>, tira_refs array<string>")
    people = tasks.join_links(tasks.participants(got), links)
    assert {r["pdf_url"]: r["code_urls"] for r in people.collect()} == {"u2": ["http://x", "http://d"], "u3": [], "bu2": []}
    report = tasks.corpus_report(got, people).first()
    assert (report["tasks"], report["participants"], report["live"], report["dead"], report["third_party"], report["with_code"]) == (2, 3, 1, 1, 1, 1)
    flat = {r["task_id"]: r for r in tasks.flat(got, people).collect()}
    row = flat["clef2023-lifeclef-plants"]
    assert list(row.asDict()) == tasks.CSV_COLUMNS and row["code_urls"] == "http://d; http://x" and row["code_urls_live"] == "http://x" and row["participant_pdf_urls"] == "u2; u3"
    assert row["participant_fulltext_paths"] == "; "
    manifest = spark.createDataFrame([("u2", "old", None, 1, None, 0, 0), ("u2", "new", None, 2, None, 1, 1)], "pdf_url string, markdown_path string, figures_dir string, n_figures int, tables_dir string, n_tables int, ord int")
    texts = {r["pdf_url"]: (r["fulltext_path"], r["n_figures"]) for r in tasks.join_fulltext(people, manifest).collect()}
    assert texts == {"u2": ("new", 2), "u3": (None, 0), "bu2": (None, 0)}
    assert "fulltext_path" not in tasks.join_fulltext(people, None).columns


def test_violations(spark):
    got = corpus(spark)
    assert tasks.violations(got).isEmpty()
    rules = {r["rule"] for r in tasks.violations(got.unionByName(got)).collect()}
    assert rules == {"duplicate task_id"}
    shared = got.withColumn("task_id", F.concat("task_id", F.lit("-2")))
    assert {r["rule"] for r in tasks.violations(got.unionByName(shared)).collect()} == {"pdf_url in several tasks"}
    bad = got.withColumn("counts", F.col("counts").withField("coverage_ratio", F.lit(3.5)))
    assert {r["rule"] for r in tasks.violations(bad).collect()} == {"coverage_ratio out of bounds"}


def test_metrics_of_identical_and_different_texts(spark):
    same = spark.createDataFrame([("a", "The cat sat on the mat, twice.", "The cat sat on the mat, twice.")], "id string, hypothesis string, reference string")
    got = {r["key"]: round(r["value"], 6) for r in metrics.evaluate(same).collect()}
    assert got == {"BLEU": 100.0, "chrF": 100.0, "ROUGE-1": 1.0, "ROUGE-2": 1.0, "ROUGE-L": 1.0}
    other = spark.createDataFrame([("a", "running cats", "a cat runs"), ("b", "zzz", "qqq")], same.schema)
    got = {r["key"]: r["value"] for r in metrics.evaluate(other).collect()}
    assert abs(got["ROUGE-1"] - (2 * 2 / 5) / 2) < 1e-9 and abs(got["ROUGE-L"] - (2 * 1 / 5) / 2) < 1e-9 and got["ROUGE-2"] == 0
    assert metrics.mismatched_ids(same.limit(0), same).collect() == [("a", "missing")]


def test_search_snippets_and_limits(spark):
    docs = spark.createDataFrame([("c", "a.pdf", "Kosten\n\nRückreise am Montag, Rückreise spät\nEnde"), ("c", "b.pdf", "keine RÜCKREISE")], "case_id string, filename string, text string")
    got = review.search(docs, "Rückreise x", 5).collect()
    assert [(r["score"], r["document"], r["line"]) for r in got] == [(2, "a.pdf", 3), (1, "b.pdf", 1)]
    assert got[0]["snippet"] == "Rückreise am Montag, Rückreise spät Ende"
    for query, n in (("x", 5), ("Kosten", 0), ("Kosten", 21)):
        with pytest.raises(ValueError):
            review.search(docs, query, n)
    bundle = review.evidence(docs).first()
    assert set(bundle["documents"]) == {"a.pdf", "b.pdf"} and bundle["missing"] == [] and len(bundle["policies"]) == 9
    assert "EVIDENCE_JSON" in review.prompts(review.evidence(docs)).first()["prompt"]


def test_file_names(spark):
    names = spark.createDataFrame([("a.pdf",), ("../a.pdf",), ("x/a.pdf",), ("a.txt",)], "f string")
    assert [r[0] for r in names.filter(review.document_name_ok(F.col("f"))).collect()] == ["a.pdf"]


def test_upsert_and_retry(spark):
    old = spark.createDataFrame([("a", True), ("b", False)], "pdf_url string, needs_ocr boolean")
    new = spark.createDataFrame([("a", False), ("c", False)], old.schema)
    assert sorted(tasks.upsert(old, new).collect()) == [("a", False), ("b", False), ("c", False)]
    assert tasks.retry(old, old).count() == 1 and tasks.retry(new, new).count() == 2


def test_crop_boxes_stay_on_the_page(spark):
    regions = spark.createDataFrame([("d", 1, 1, 2.0, 100.0, 3.0, 50.0)], "doc string, page int, index int, x0 double, x1 double, y0 double, y1 double")
    row = islands.crop_boxes(regions, F.lit(200), F.lit(90)).first()
    assert (row["left"], row["top"], row["right"], row["bottom"]) == (0, 0, 200, 90)


def _most_rows(node) -> int:
    """The most rows that any operator of an executed plan gave."""
    kind, metric = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
    children = node.children()
    return max([metric.get().value() if metric.isDefined() else 0, *map(_most_rows, inner), *[_most_rows(children.apply(i)) for i in range(children.size())]])


def test_titles_of_the_same_words_are_scored_once(spark):
    row = "parent_venue string, year int, volume string, section_no int, position int, title string"
    papers = spark.createDataFrame([("V", 2024, "1", 0, i, ["Plants red", "Red plants", "Birds", "Fish"][i % 4]) for i in range(400)], row)
    overviews = spark.createDataFrame([("V", 2024, "1", 0, 1000 + i, "Birds" if i < 60 else "Fish" if i == 60 else "Blue plants") for i in range(62)], row)
    found = tasks.best_overview(papers, overviews)
    assert sorted((r.position, r.overview) for r in found.collect()) == sorted((i, 1060 if i % 4 == 3 else 1061) for i in range(400) if i % 4 != 2)
    assert _most_rows(found._jdf.queryExecution().executedPlan()) <= 600  # 100 papers and 60 overviews have a word in common
