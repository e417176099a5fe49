"""Queries over the driver's tables, with the SQL that checks them.

Queries run over their whole tables. Integers are given as BIGINT, so that
results of different engines have one schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analysis, counts, facts, links, papers, titles
from corpusloom.functions.text import let, words
from corpusloom.operators import islands, judging, metrics, retrieval, review, tasks
from corpusloom.plans import oracle
from corpusloom.session import new_path
from corpusloom.sources import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """All integer columns as BIGINT."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# -- retrieval


_indexes: dict[tuple, retrieval.Index] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: what tells whether it has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


def _index(spark: SparkSession, sf_dir: str, fresh: bool = False, slice_docs: int = retrieval.SLICE_DOCS) -> retrieval.Index:
    """The index of all documents by their words; it is built once for each state of the table."""
    key = (spark.sparkContext.applicationId, id(spark), _files(spark, f"{sf_dir}/documents.parquet"), slice_docs)
    if fresh or key not in _indexes:
        folder = new_path(spark, "index")
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), "text")
        _indexes[key] = retrieval.write_index(docs, words(F.col("text")), folder, slice_docs=slice_docs)
    return _indexes[key]


def _run(spark: SparkSession, sf_dir: str, model: str, depth: int = 10) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.search(_index(spark, sf_dir), asked, words(F.col("text")), model, depth, digits=6)


for _model in retrieval.MODELS:
    query(oracle.ranked(_model), f"{_model.replace('-', '_')}_top10")(lambda spark, sf_dir, model=_model: longs(_run(spark, sf_dir, model)))


for _model in retrieval.MODELS:
    query(oracle.ranked(_model, 1000), f"{_model.replace('-', '_')}_top1000")(lambda spark, sf_dir, model=_model: longs(_run(spark, sf_dir, model, 1000)))


def _run_pruned(spark: SparkSession, sf_dir: str, model: str, depth: int) -> DataFrame:
    """As ``_run``, over small slices, of which those that can't matter are left out."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    index = _index(spark, sf_dir, slice_docs=32)
    return retrieval.rank(retrieval.top(index, retrieval.query_terms(asked, words(F.col("text"))), model, depth), depth, 6)


for _model in ("bm25", "pl2", "dlh"):  # a bound that is the weight itself, and two of their own; tests have all ten
    query(oracle.ranked(_model), f"{_model.replace('-', '_')}_top10_pruned")(lambda spark, sf_dir, model=_model: longs(_run_pruned(spark, sf_dir, model, 10)))


@query(oracle.TOKENIZE)
def tokenize_docs(spark, sf_dir):
    tokens = words(F.col("text"))
    return longs(table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct")))


@query(oracle.INDEX_STATS)
def index_stats(spark, sf_dir):
    """Builds the index anew, whatever other queries have kept."""
    index = _index(spark, sf_dir, fresh=True)
    terms = index.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))
    return index.stats.select("n", "total", F.round("avdl", 6).alias("avdl")).crossJoin(terms)  # one row each


@query()
def stemmed_bm25_top10(spark, sf_dir):
    """Ten documents of each language, or of those that name none (""), by figures of their own; stems where there is an analysis, words elsewhere."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("doc_id").alias("docno"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").crossJoin(docs.select("lang").distinct())  # languages are few
    tokens = analysis.tokens_by_language(F.col("text"), F.col("lang"))
    return longs(retrieval.retrieve(docs, asked, tokens, tokens, depth=10, part="lang"))


@query(oracle.POOL)
def pool_topk(spark, sf_dir):
    pools = judging.pool(judging.union_runs([_run(spark, sf_dir, m) for m in ("bm25", "tf-idf")]), 5)
    return pools.select("qid", F.array_join("docnos", ",").alias("docnos"), F.size("docnos").cast("long").alias("size"))


#: Items whose texts are broadcast to the documents' windows, and their bytes; more of them are joined by a shuffle.
MAX_BROADCAST_ITEMS, MAX_BROADCAST_BYTES = 20_000, 32 << 20
#: Words that items are looked for by, as part of the plan; with more of them every window is hashed.
MAX_ANCHORS = 10_000


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, docno, rel: of all documents those that hold the whole text of an item, by its words, whatever a run found."""
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), words(F.col("text")).alias("_w"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words(F.col("text")).alias("_q")).filter(F.size("_q") > 0)
    line = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    firsts = asked.withColumn("_n", F.least(F.size("_q"), F.lit(10))).select("qid", "_n", F.xxhash64(F.slice(hashed(F.col("_q")), 1, F.col("_n"))).alias("_h"), line(F.col("_q")).alias("_q"))
    lengths = {r[0]: (r[1], r[2]) for r in firsts.groupBy("_n").agg(F.count("*"), F.sum(F.octet_length("_q"))).collect()}  # ten at most
    none = F.array().cast("array<struct<_n:int,_h:bigint>>")
    # documents' words are looked up among the longest word of each item's beginning; only windows around those found are hashed
    longest = F.array_max(F.transform(F.slice("_q", 1, F.least(F.size("_q"), F.lit(10))), lambda x: F.struct(F.char_length(x).alias("n"), F.xxhash64(x).alias("h"))))["h"]
    found = [r[0] for r in asked.select(longest.alias("h")).distinct().limit(MAX_ANCHORS + 1).collect()]
    near = (lambda w, i: F.get(w, i).isin(found)) if len(found) <= MAX_ANCHORS else (lambda w, i: F.lit(True))
    around = lambda w, at, n: F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - n + 1, F.lit(0)), F.least(i, F.size(w) - n)))))
    hashed_at = lambda w, at, n: F.when(F.size(w) >= n, F.transform(around(w, at, n), lambda i: F.struct(F.lit(n).alias("_n"), F.xxhash64(F.slice(w, i + 1, n)).alias("_h")))).otherwise(none)
    places = lambda w: F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: near(w, i))).otherwise(F.array().cast("array<int>"))
    starts = let(F.col("_w"), lambda w: let(places(w), lambda at: F.concat(*[hashed_at(w, at, n) for n in sorted(lengths)]))) if lengths else none
    small = F.broadcast if sum(n for n, _ in lengths.values()) <= MAX_BROADCAST_ITEMS and sum(b for _, b in lengths.values()) <= MAX_BROADCAST_BYTES else lambda df: df
    met = docs.select("docno", hashed(F.col("_w")).alias("_w")).select("docno", F.explode(starts).alias("_s")).select("docno", "_s.*").join(small(firsts), ["_n", "_h"]).distinct()
    held = met.join(docs.select("docno", line(F.col("_w")).alias("_d")), "docno").filter(F.contains("_d", "_q"))
    return held.select("qid", "docno", F.lit(1).alias("rel")).distinct()


@query(oracle.NDCG)
def ndcg_at_10(spark, sf_dir):
    """Every item that some document holds is judged, also if the run finds none of them."""
    return judging.ndcg(_run(spark, sf_dir, "bm25"), _holders(spark, sf_dir)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(oracle.HISTOGRAM)
def label_histogram(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return judging.label_histogram(judged, "lang", "quality")


@query(oracle.ACCURACY)
def accuracy_constant(spark, sf_dir):
    truths = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("antrag"), F.col("quality").alias("result"))
    return judging.accuracy(truths.select("antrag", F.lit(1).alias("result")), truths).select(F.round("accuracy", 9).alias("accuracy"))


@query(oracle.ID_CHECK)
def set_ops(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return metrics.mismatched_ids(labels, docs)


# -- documents and pages


@query(oracle.ROUTING)
def language_routing(spark, sf_dir):
    status = F.when(F.col("lang").isin(*web.LANGUAGES), F.concat(F.lit("written-"), F.col("lang"))).otherwise("excluded")
    return table(spark, sf_dir, "documents").groupBy(status.alias("status")).count().withColumnRenamed("count", "n")


@query(oracle.LANGUAGE)
def language_detection(spark, sf_dir):
    found = web.detect_language(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("language"))


@query(oracle.PROJECTION)
def doc_projection(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    heading = F.trim(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("<urn:uuid:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), "url", F.lit("en").alias("language"), title.alias("title"), heading.alias("content"))
    return web.project_documents(rows)


@query()
def html_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("body"), F.lit("utf-8").alias("charset"))
    return web.main_content(pages).select("page_id", "title", F.char_length("content").cast("long").alias("n_chars"), "failure")


# -- tasks


def _task_shapes(spark, sf_dir):
    """Orders as tasks: line items are participants; every seventh claims no teams."""
    people = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    teams = F.col("o_custkey") % 7
    return table(spark, sf_dir, "orders").join(people, "o_orderkey", "left").select(F.col("o_orderkey").alias("task_id"), F.coalesce("n", F.lit(0)).alias("n"), teams.alias("teams"), "o_orderpriority", "o_orderstatus", "o_orderdate")


def _with_counts(spark, sf_dir):
    """The shapes as task records, joined with the counts that their overviews claim."""
    rows = _task_shapes(spark, sf_dir)
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    people = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))
    records = rows.select("task_id", people.alias("participants"), F.struct(level.alias("confidence")).alias("provenance"), F.struct((F.col("o_orderstatus") == "F").alias("is_umbrella")).alias("overview"))
    return tasks.join_counts(records, rows.select("task_id", "teams", F.lit(None).cast("long").alias("runs")))


_COUNTED = {"task_id": "task_id", "counts.notebook_papers": "n", "counts.teams_claimed_in_overview": "teams", "counts.ratio": "ratio", "counts.coverage_ratio": "rounded"}


def _counted(df: DataFrame) -> DataFrame:
    return longs(df.select(*[F.col(c).alias(n) for c, n in _COUNTED.items()]))


@query(oracle.COVERAGE)
def task_coverage(spark, sf_dir):
    return _counted(_with_counts(spark, sf_dir))


@query(oracle.SELECT)
def corpus_select(spark, sf_dir):
    return _counted(tasks.select_corpus(_with_counts(spark, sf_dir)))


def _order_tasks(items: DataFrame) -> DataFrame:
    """Tasks are orders; their documents are the parts of their items, of which one is often in several tasks."""
    rows = items.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("pdf_url"))).alias("participants"), F.count("*").alias("n"))
    return rows.select(
        F.concat(F.lit("t"), (F.col("l_orderkey") % 1000).cast("string")).alias("task_id"), "participants", F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("pdf_url")).alias("overview"),
        F.struct((F.col("n") / (1 + F.col("l_orderkey") % 3)).alias("coverage_ratio")).alias("counts"),
    )


@query(oracle.VIOLATIONS)
def corpus_violations(spark, sf_dir):
    return tasks.violations(_order_tasks(table(spark, sf_dir, "lineitem"))).distinct()


@query(oracle.REPORT)
def venue_year_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parent_venue"), F.year("o_orderdate").alias("year"))
    return longs(tasks.venue_year_report(rows))


@query(oracle.ARGMAX)
def weighted_overlap_argmax(spark, sf_dir):
    """Parts of a brand as papers of a section; those of size 1 are its overviews."""
    rows = table(spark, sf_dir, "part").select(F.lit("P").alias("parent_venue"), F.lit(2000).alias("year"), F.col("p_brand").alias("volume"), F.lit(0).alias("section_no"), F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_name", "p_type").alias("title"), "p_size")
    found = tasks.best_overview(rows.filter("p_size > 1"), rows.filter("p_size = 1"))
    return found.select(F.col("volume").alias("brand"), F.col("position").alias("part"), "overview")


# -- islands, searches, facts


@query(oracle.SESSIONS)
def islands_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    rows = table(spark, sf_dir, "events").withColumn("_new", gap > 1_800_000_000)
    found = islands.islands(rows, ["user_id"], ["ts", "event_id"], F.col("_new"))
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(oracle.SEARCH)
def line_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("filename"), "text")
    return longs(review.search(docs, oracle.SEARCH_QUERY, 20, case="lang").withColumnRenamed("document", "doc_id"))


@query(oracle.DATES)
def date_checks(spark, sf_dir):
    left = F.date_format("o_orderdate", "d.M.yyyy")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", facts.compare_dates(left, F.lit("<="), F.lit("1995-06-17")).alias("c"))
    return rows.select("o_orderkey", F.col("c.passed").alias("passed"), F.col("c.expression").alias("expression"))


@query(oracle.SUMS)
def decimal_sums(spark, sf_dir):
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(money).alias("total"), F.collect_list(money).alias("amounts"))
    expected = F.col("total") + ((F.col("l_orderkey") % 4 - 1) * F.lit("0.01").cast("decimal(3,2)"))  # off by a cent or two for most
    checked = totals.select("l_orderkey", facts.sum_amounts(F.col("amounts"), expected).alias("s"))
    return checked.select("l_orderkey", F.col("s.total").cast("double").alias("total"), F.col("s.difference").cast("double").alias("difference"), F.col("s.passed").alias("passed"))


# -- metrics


def _turn_pairs(spark, sf_dir):
    """Every turn of a conversation with the one before it."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("hypothesis"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("reference", F.lag("hypothesis").over(w)).withColumn("at", F.row_number().over(w)).filter("at > 1")
    return pairs.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "hypothesis", "reference")


@query(oracle.NGRAMS)
def ngram_overlap(spark, sf_dir):
    cut = _turn_pairs(spark, sf_dir).select("id", words(F.col("hypothesis")).alias("h"), words(F.col("reference")).alias("r"))
    return longs(metrics.overlap(cut, "h", "r", 4))


@query(oracle.CHRF)
def chrf_corpus(spark, sf_dir):
    return metrics.chrf(_turn_pairs(spark, sf_dir)).select(F.round("chrf", 6).alias("chrf"))


@query(oracle.BLEU)
def bleu_corpus(spark, sf_dir):
    return metrics.bleu(_turn_pairs(spark, sf_dir)).select(F.round("bleu", 6).alias("bleu"))


@query(oracle.ROUGE)
def rouge_unstemmed(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir)
    one, two = (metrics.rouge_n(pairs, n, stems=False).select("id", F.round("rouge", 9).alias(f"rouge{n}")) for n in (1, 2))
    return one.join(two, "id")


@query()
def rouge_scores(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir)
    return metrics.rouge_n(pairs, 1).withColumnRenamed("rouge", "rouge1").join(metrics.rouge_n(pairs, 2).withColumnRenamed("rouge", "rouge2"), "id").join(metrics.rouge_l(pairs).withColumnRenamed("rouge", "rougel"), "id")


# -- functions of titles and papers: the cases whose answers are known, dealt over the rows of part


def _dealt(spark, sf_dir, cases, schema: str):
    """id (the part's key) and one case for each row of part; cases are few and fixed."""
    known = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"place long, {schema}")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(cases)).alias("place"))
    return rows.join(F.broadcast(known), "place").drop("place")


def _cases(spark, sf_dir, cases, column):
    return _dealt(spark, sf_dir, [(a,) for a, _ in cases], "input string").select("id", column(F.col("input")).alias("output"))


for _name, _cases_of, _column in (
    ("title_keys", oracle.TITLE_KEYS, titles.normalize_title),
    ("title_words", oracle.TITLE_WORDS, lambda c: F.array_join(F.array_sort(titles.title_tokens(c)), " ")),
    ("venue_names", oracle.VENUES, titles.venue),
    ("task_names", oracle.TASK_NAMES, titles.task_name),
    ("team_names", oracle.TEAMS, titles.team_name),
    ("task_numbers", oracle.NUMBERS, titles.task_number),
    ("slugs", oracle.SLUGS, titles.slugify),
    ("team_counts", oracle.TEAM_COUNTS, lambda c: counts.first_count(counts.opening(c), counts.TEAM_PATTERNS).cast("string")),
    ("run_counts", oracle.RUN_COUNTS, lambda c: counts.run_count(c).cast("string")),
    ("code_urls", oracle.CODE_URLS, lambda c: F.array_join(F.transform(links.code_links(c)["code"], lambda x: F.concat_ws("=", x["url"], x["evidence"].cast("string"))), " ")),
    ("third_party_urls", oracle.THIRD_PARTY, lambda c: links.is_third_party(c).cast("string")),
    ("paper_titles", oracle.PAPERS_TITLES, papers.title),
    ("paper_abstracts", oracle.PAPERS_ABSTRACTS, papers.abstract),
    ("english_tokens", oracle.ENGLISH, lambda c: F.array_join(analysis.tokens(c, "en"), " ")),
    ("german_tokens", oracle.GERMAN, lambda c: F.array_join(analysis.tokens(c, "de"), " ")),
    ("parsed_dates", oracle.PARSED_DATES, lambda c: facts.parse_date(c).cast("string")),
):
    query(oracle.expected(_cases_of), _name)(lambda spark, sf_dir, c=_cases_of, f=_column: _cases(spark, sf_dir, c, f))


@query(oracle.TABLES)
def md_tables(spark, sf_dir):
    docs = _dealt(spark, sf_dir, [(oracle.TABLE_TEXT,)], "text string").withColumnRenamed("id", "doc")
    return longs(islands.markdown_tables(docs, "doc", "text").select("doc", "table_no", F.size(papers.table_rows(F.col("lines"))).alias("n_rows"), F.array_join("lines", "/").alias("lines")))


@query(oracle.REGIONS)
def table_regions(spark, sf_dir):
    """Every part is a page of each of the ruled documents."""
    ruled = spark.createDataFrame([(oracle.RULED_PAGES,)], "docs array<struct<doc:string,page:int,lines:array<struct<x1:double,x2:double,y1:double,y2:double>>>>")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.lit(0).alias("one")).join(F.broadcast(ruled.withColumn("one", F.lit(0))), "one")  # one row
    pages = rows.select("page", F.explode("docs").alias("d")).select("d.doc", "page", "d.lines")
    return longs(islands.table_regions(islands.rules(pages)))


@query(oracle.DECISIONS)
def conversation_decisions(spark, sf_dir):
    answers = _dealt(spark, sf_dir, [(c, a) for c, a, *_ in oracle.ANSWERS], "case_id string, answer string")
    keyed = answers.withColumn("case_key", F.concat_ws("/", "case_id", F.col("id").cast("string")))
    own = keyed.withColumn("answer", F.replace("answer", F.concat(F.lit('"antrag": "'), F.col("case_id"), F.lit('"')), F.concat(F.lit('"antrag": "'), F.col("case_key"), F.lit('"'))))
    found = review.parse_decisions(own, "case_key")
    return found.select(F.split_part("case_key", F.lit("/"), F.lit(2)).cast("long").alias("id"), F.split_part("case_key", F.lit("/"), F.lit(1)).alias("case_id"), "result", "begruendung", "problem")


@query(oracle.POLICY)
def policy_lookup(spark, sf_dir):
    """The rules about each part's topic."""
    topics = F.element_at(F.array(*map(F.lit, oracle.TOPICS)), (F.col("p_partkey") % len(oracle.TOPICS) + 1).cast("int"))
    return longs(review.lookup_policies(table(spark, sf_dir, "part").withColumn("topic", F.concat_ws(" ", "p_type", topics)), "topic").select("p_partkey", "key", "score"))
