import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analysis
from corpusloom.functions.text import words
from corpusloom.operators import judging, retrieval

DOCS = [("d1", "a a b"), ("d2", "b c c c"), ("d3", "a c d d d d d")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "docno string, text string")
    asked = spark.createDataFrame([("q", "a c")], "qid string, text string")
    return docs, asked


def by_hand(model: str) -> dict[str, float]:
    docs = {d: t.split() for d, t in DOCS}
    n, total = len(docs), sum(map(len, docs.values()))
    avdl, out = total / n, {}
    for d, toks in docs.items():
        s, dl = 0.0, len(toks)
        for term in ("a", "c"):
            tf = toks.count(term)
            if not tf:
                continue
            df, cf = sum(term in t for t in docs.values()), sum(t.count(term) for t in docs.values())
            lg, norm, tfn, f, e = math.log2, 1.2 * (0.25 + 0.75 * dl / avdl), tf * math.log2(1 + avdl / dl), tf / dl, cf * dl / total
            s += {
                "bm25": lg((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + norm),
                "tf-idf": 1.2 * tf / (tf + norm) * lg(n / df + 1),
                "dirichlet-lm": lg(1 + tf / (2500 * cf / total)) + lg(2500 / (dl + 2500)),
                "hiemstra-lm": lg(1 + 0.15 * tf * total / (0.85 * cf * dl)),
                "pl2": (tfn * lg(tfn / (cf / n)) + (cf / n - tfn) * lg(math.e) + 0.5 * lg(2 * math.pi * tfn)) / (tfn + 1),
                "dph": (1 - f) ** 2 / (tf + 1) * (tf * lg(tf * (avdl / dl) * (n / cf)) + 0.5 * lg(2 * math.pi * tf * (1 - f))),
                "dlh": (tf * lg(tf * (avdl / dl) * (n / cf)) + (dl - tf) * lg(1 - f) + 0.5 * lg(2 * math.pi * tf * (1 - f))) / (tf + 0.5),
                "lgd": lg((df / n + tfn) / (df / n)),
                "dfic": lg(1 + (tf - e) ** 2 / e) if tf > e else 0.0,
                "dfiz": lg(1 + (tf - e) / math.sqrt(e)) if tf > e else 0.0,
            }[model]
        out[d] = s
    return out


@pytest.mark.parametrize("model", sorted(retrieval.MODELS))
def test_models_by_hand(spark, model):
    docs, asked = frames(spark)
    got = {r["docno"]: r["score"] for r in retrieval.retrieve(docs, asked, words(F.col("text")), words(F.col("text")), model).collect()}
    want = by_hand(model)
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-8 for d in want)


def test_single_term_documents_have_no_logarithm_of_zero(spark):
    docs = spark.createDataFrame([("d1", "a a"), ("d2", "b")], "docno string, text string")
    asked = spark.createDataFrame([("q", "a")], "qid string, text string")
    for model in ("dph", "dlh"):
        assert retrieval.retrieve(docs, asked, words(F.col("text")), words(F.col("text")), model).first()["score"] == 0.0


def test_stop_word_queries_have_no_rows_and_stems_meet(spark):
    docs = spark.createDataFrame([("d1", "Die Häuser sind groß"), ("d2", "Wir laufen schnell")], "docno string, text string")
    asked = spark.createDataFrame([("1", "das Haus"), ("2", "und der die")], "qid string, text string")
    t = analysis.index_tokens(F.col("text"), "de")
    got = retrieval.retrieve(docs, asked, t, t).collect()
    assert [(r["qid"], r["docno"], r["rank"]) for r in got] == [("1", "d1", 1)]


@pytest.mark.parametrize("broadcast", (500_000, 0))
def test_parts_are_ranked_as_if_alone_and_texts_are_analysed_once(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_TERMS", broadcast)
    rows = [("x", f"d{i}", " ".join("abcd"[(i * k) % 4] for k in range(1 + i % 5))) for i in range(40)] + [("y", f"e{i}", "a b " + "zz " * i) for i in range(15)] + [("x", "none", None), ("y", "digits", "1 2")]
    docs = spark.createDataFrame(rows, "part string, docno string, text string")
    asked = spark.createDataFrame([(p, q, t) for p in "xy" for q, t in (("q1", "a c c"), ("q2", "b zz nowhere"))], "part string, qid string, text string")
    log = tmp_path / "seen"

    @F.udf("array<string>")
    def counted(text):
        with log.open("a") as out:
            out.write(f"{text}\n")
        return None if text is None else [w for w in text.split() if w.isalpha()]

    got = {tuple(r) for r in retrieval.retrieve(docs, asked, counted("text"), words(F.col("text")), depth=5, part="part").collect()}
    assert sorted(log.read_text().splitlines()) == sorted(str(t) for _, _, t in rows)
    index = {p: retrieval.build_index(docs.filter(F.col("part") == p), words(F.col("text"))) for p in "xy"}
    assert got == {(p, *r) for p in "xy" for r in retrieval.search(index[p], asked.filter(F.col("part") == p), words(F.col("text")), depth=5).collect()}
    assert len(got) == 20


def test_tokens_by_language(spark):
    rows = [("en", "The houses weren't running’s"), ("de", "Die Häuser laufen"), ("fr", "Les maisons d'ici"), ("", "The houses"), ("en", None), ("de", ""), ("en", "the")]
    got = spark.createDataFrame(rows, "lang string, text string").select(analysis.tokens_by_language(F.col("text"), F.col("lang"))).collect()
    assert [r[0] for r in got] == [["hous", "run"], ["haus", "lauf"], ["les", "maisons", "d", "ici"], ["the", "houses"], None, [], []]


def test_unknown_model_and_language(spark):
    with pytest.raises(ValueError):
        retrieval.score(None, None, "none")
    for language in ("fr", "EN"):
        with pytest.raises(ValueError, match="Unsupported language"):
            analysis.tokens(F.lit("x"), language)
    rows = spark.createDataFrame([("de",), ("en",)], "language string")
    with pytest.raises(ValueError, match="de, en"):
        retrieval.dataset_language(rows)
    assert retrieval.dataset_language(rows.limit(1)) in ("de", "en")


def test_pool_of_two_runs(spark):
    rows = [("1", d, s, r) for r, ds in enumerate(("abc", "bca")) for d, s in zip(ds, (3.0, 2.0, 1.0), strict=True)]
    runs = spark.createDataFrame(rows, "qid string, docno string, score double, run int")
    assert judging.pool(runs, 2).collect() == [("1", ["a", "b", "c"])]
    with pytest.raises(ValueError):
        judging.pool(runs, 0)


def test_requests_responses_and_qrels(spark):
    pools = spark.createDataFrame([("1", ["a", "b"]), ("2", ["c"])], "qid string, docnos array<string>")
    queries = spark.createDataFrame([("1", "q1"), ("2", "q2")], "qid string, text string")
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "docno string, text string")
    assert judging.unknown_ids(pools, queries, docs).collect() == [("document", "c")]
    made = judging.requests(pools.filter("qid = '1'"), queries, docs).first()["request"]
    assert made["query"]["text"] == "q1" and [c["docid"] for c in made["candidates"]] == ["a", "b"]
    answers = spark.createDataFrame([("1", [(3, "x"), (0, "y")])], "qid string, labels array<struct<label:int,record:string>>")
    judged = judging.align_responses(pools, answers)
    assert judging.invalid_responses(pools, judged).collect() == [("2", "missing response")]
    from corpusloom.sources.sinks import qrels_lines

    assert [r[0] for r in qrels_lines(judging.qrels(judged)).collect()] == ["1 0 a 3", "1 0 b 0"]
    hist = judging.label_histogram(judging.qrels(judged)).first()
    assert (hist["c0"], hist["c1"], hist["c2"], hist["c3"], hist["total"]) == (1, 0, 0, 1, 2)
    bad = judging.align_responses(pools, spark.createDataFrame([("1", [(7, "x"), (0, "y")]), ("2", [])], answers.schema))
    assert sorted(judging.invalid_responses(pools, bad).collect()) == [("1", "label out of range"), ("2", "no judgments")]
    assert judging.pending(pools, judged).collect()[0]["qid"] == "2"


def test_ndcg(spark):
    run = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "qid string, docno string, rank int")
    rel = spark.createDataFrame([("1", "b", 1), ("2", "x", 1)], "qid string, docno string, rel int")
    got = {r["qid"]: r["ndcg"] for r in judging.ndcg(run, rel).collect()}
    assert abs(got["1"] - 1 / math.log2(3)) < 1e-12 and got["2"] == 0.0


def generated(spark, n=300):
    import random

    r = random.Random(5)
    words_ = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words_[: r.choice((3, 10, 60))]) for _ in range(r.choice((0, 1, 3, 20, 200))))) for i in range(n)]
    asked = [(q, " ".join(r.choice(words_) for _ in range(r.choice((1, 2, 6))))) for q in range(12)]
    return spark.createDataFrame(rows, "docno long, text string"), spark.createDataFrame(asked, "qid long, text string")


@pytest.fixture(scope="module")
def small_slices(spark):
    from corpusloom.session import new_path

    docs, asked = generated(spark)
    index = retrieval.write_index(docs, words(F.col("text")), new_path(spark, "index"), slice_docs=4)
    return index, retrieval.query_terms(asked, words(F.col("text")))


@pytest.mark.parametrize("model", sorted(retrieval.MODELS))
def test_slices_that_cannot_matter_change_no_rank(small_slices, model):
    index, asked = small_slices
    for depth in (1, 5):
        found, every = retrieval.top(index, asked, model, depth), retrieval.score(index, asked, model)
        assert sorted(retrieval.rank(found, depth).collect()) == sorted(retrieval.rank(every, depth).collect())


def test_slices_are_left_out(small_slices):
    index, asked = small_slices
    assert index.slices == 75
    assert retrieval.top(index, asked, "bm25", 1).count() < retrieval.score(index, asked, "bm25").count() / 2


def test_no_weight_is_above_its_bound(spark):
    """Blocks of any two documents: their bound is computed from the larger tf, the shorter length and the larger share."""
    import random

    r = random.Random(3)
    rows = []
    for _ in range(4000):
        n = r.choice((5, 1000, 10**6))
        df = r.randint(1, n)
        cf, total = df * r.choice((1, 3, 50)), n * r.choice((60, 300))
        pair = [(tf, tf + r.choice((0, 1, 10, 500))) for tf in (r.choice((1, 2, 5, 40)) for _ in range(2))]
        rows.append((*[float(x) for p in pair for x in p], float(max(p[0] for p in pair)), float(min(p[1] for p in pair)), max(a / b for a, b in pair), float(df), float(cf), float(n), float(total), total / n))
    blocks = spark.createDataFrame(rows, "tf1 double, dl1 double, tf2 double, dl2 double, top_tf double, low_dl double, share double, df double, cf double, n double, total double, avdl double")
    for model, weight in retrieval.MODELS.items():
        bound = retrieval.highest(model, retrieval._figures("top_tf", "low_dl"), F.col("share"))
        above = [weight(retrieval._figures(f"tf{i}", f"dl{i}")) > bound + 1e-9 for i in (1, 2)]
        assert blocks.filter(above[0] | above[1]).count() == 0, model


def test_a_query_reads_the_shelves_of_its_terms_and_sums_where_postings_lie(spark, small_slices):
    index, _ = small_slices
    one = spark.createDataFrame([("q", "waa")], "qid string, text string")
    plan = retrieval.score(index, retrieval.query_terms(one, words(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("shelf#" in x and " = " in x for x in filters)
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "docno" in x]
    shelves = {r["shelf"] for r in index.blocks.select("shelf").distinct().collect()}
    assert len(shelves) > 10


def test_index_is_read_again_after_the_catalog_forgot_it(spark):
    from corpusloom.session import new_path

    docs, asked = generated(spark, 50)
    folder, t = new_path(spark, "index"), words(F.col("text"))
    first = retrieval.search(retrieval.write_index(docs, t, folder), asked, t).collect()
    retrieval.forget_index(spark, folder)
    assert retrieval.search(retrieval.read_index(spark, folder), asked, t).collect() == first
    assert not [x for x in spark.catalog.listTables("default") if x.name.startswith("corpusloom")]
