"""Queries that run functions of one row, and small operators, over rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import counts, facts, links, papers, titles
from corpusloom.operators import islands, judging, tasks
from corpusloom.plans.registry import longs, query, table
from corpusloom.sources import sinks, web

_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_PART = "p_brand || ': ' || p_name || ' -- ' || p_type"


def _part_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(": "), "p_name", F.lit(" -- "), "p_type").alias("title"))


@query(f"SELECT p_partkey, {_KEY.format(_PART)} AS key, trim(regexp_replace(lower({_PART}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, url_encode({_PART}) AS file FROM part")
def part_keys(spark, sf_dir):
    title = F.col("title")
    return _part_title(spark, sf_dir).select("p_partkey", titles.normalize_title(title).alias("key"), titles.slugify(title).alias("slug"), sinks.quoted_name(title).alias("file"))


@query("""SELECT o_orderkey, (CASE WHEN teams BETWEEN 1 AND 999 THEN teams END)::VARCHAR AS teams, (CASE WHEN a BETWEEN 1 AND 999 AND b BETWEEN 1 AND 999 THEN a + b WHEN a BETWEEN 1 AND 999 THEN a WHEN b BETWEEN 1 AND 999 THEN b END)::VARCHAR AS runs,
(CASE WHEN teams BETWEEN 1 AND 999 AND NOT 30.0 / teams > 1.5 THEN teams END)::VARCHAR AS kept
FROM (SELECT o_orderkey, o_custkey % 1300 AS teams, o_orderkey % 1100 AS a, o_custkey % 40 AS b FROM orders)""")
def claimed_counts(spark, sf_dir):
    """Counts that overviews claim, in three wordings, some of them no plausible numbers; kept where 30 papers don't speak against them."""
    teams = (F.col("o_custkey") % 1300).cast("string")
    wording = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("There were "), teams, F.lit(" participating teams."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("We received results from "), teams, F.lit(" teams."))).otherwise(F.concat(F.lit("A total of "), teams, F.lit(" teams took part.")))
    runs = F.concat((F.col("o_orderkey") % 1100).cast("string"), F.lit(" runs for Task 1 and "), (F.col("o_custkey") % 40).cast("string"), F.lit(" runs for Task 2"))
    text = F.concat(wording, F.lit("\n"), runs, F.lit("\n2. Task\n7 participating teams"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    found = {"teams": counts.first_count(counts.opening(F.col("text")), counts.TEAM_PATTERNS), "runs": counts.run_count(F.col("text")), "kept": counts.team_count(F.col("text"), F.lit(30))}
    return rows.select("o_orderkey", *[c.cast("string").alias(name) for name, c in found.items()])


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS read FROM orders")
def read_dates(spark, sf_dir):
    """Dates in three forms that can be read, and one that can't."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "d.M.yyyy")).when(k == 2, F.date_format(day, "dd.MM.yy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), facts.parse_date(shown).cast("string").alias("read"))


@query("""SELECT p_partkey, 'size=' || (p_size < 25) || ' day=' || (p_partkey % 28 + 1 >= 15) AS results,
array_to_string(list_sort(list_distinct(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type) || ' widget', ' ')))), ' ') AS shared, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_type) || ' widget', ' ')), lambda x: NOT list_contains(string_split(lower(p_name), ' '), x))), ' ') AS lacking FROM part""")
def part_facts(spark, sf_dir):
    """Named comparisons of dates, overlaps and missing fields; case doesn't matter."""
    start = lambda n: F.concat(n.cast("string"), F.lit(".1.2026"))
    size, day = F.col("p_size").cast("int"), F.col("p_partkey") % 28 + 1
    one = lambda name, left, operator, right: F.struct(F.lit(name).alias("name"), left.alias("left"), F.lit(operator).alias("operator"), right.alias("right"))
    # sizes as days from the first of 2026, so that they make dates
    by_size = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), size), "yyyy-MM-dd")
    compared = facts.compare_all(F.array(one("size", by_size, "<", F.lit("2026-01-26")), one("day", start(day), ">=", F.lit("15.01.2026"))))
    left, right = F.split("p_name", " "), F.split(F.concat("p_type", F.lit(" Widget")), " ")
    results = F.transform(compared, lambda c: F.concat_ws("=", c["name"], c["passed"].cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(results, " ").alias("results"), F.array_join(facts.overlap(left, right), " ").alias("shared"), F.array_join(facts.missing(left, right), " ").alias("lacking"))


@query("""WITH x AS (SELECT p_partkey, (p_size * 97)::BIGINT AS chars, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 9 END AS pages FROM part),
y AS (SELECT *, CASE WHEN pages > 0 THEN round(chars / pages, 1) END AS per_page FROM x),
z AS (SELECT *, list_filter([CASE WHEN per_page < 200 THEN 'only ' || per_page || ' chars/page' END, CASE WHEN chars < 2000 THEN 'only ' || chars || ' chars extracted in total' END, CASE WHEN pages IS NULL THEN 'page count could not be determined' END], lambda f: f IS NOT NULL) AS flags FROM y)
SELECT p_partkey, array_to_string(flags, '; ') AS flags, len(flags) > 0 AND p_partkey % 2 = 1 AS needs_ocr FROM z""")
def text_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("long").alias("chars"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 9).alias("pages"))
    flags = papers.quality_flags(F.col("chars"), F.col("pages"))
    return rows.select("p_partkey", F.array_join(flags, "; ").alias("flags"), papers.needs_ocr(flags, F.col("p_partkey") % 2 == 0).alias("needs_ocr"))


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_name || chr(10) || chr(10) || p_type END AS summary, '![](figures/' || 'x/img_' || p_partkey || '.png) ![](other.png)' AS figures, 'paper_' || p_partkey AS stem,
CASE p_partkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' WHEN 2 THEN 'unverified' END AS class FROM part""")
def paper_fields(spark, sf_dir):
    k = F.col("p_partkey")
    modes = F.when(k % 3 == 0, papers.summary(F.col("p_name"), F.col("p_type"), "title")).when(k % 3 == 1, papers.summary(F.col("p_name"), F.col("p_type"), "abstract")).otherwise(papers.summary(F.col("p_name"), F.col("p_type")))
    figures = papers.figure_links(F.concat(F.lit("![](img_"), k.cast("string"), F.lit(".png) ![](other.png)")), "figures/x")
    stem = links.pdf_stem(F.concat(F.lit("http://host/a/paper."), k.cast("string"), F.lit(".pdf?x=1#y")))
    status = F.when(k % 4 == 0, "200").when(k % 4 == 1, F.when(k % 8 == 1, "404").otherwise("unreachable")).when(k % 4 == 2, "429").otherwise("500")
    return table(spark, sf_dir, "part").select("p_partkey", modes.alias("summary"), figures.alias("figures"), stem.alias("stem"), links.link_class(status).alias("class"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, trunc((l_quantity - 8) * 150 / 72)::INT) AS "left", greatest(0, trunc((l_quantity - 12) * 150 / 72)::INT) AS top, least(300, trunc((l_quantity * 3 + 8) * 150 / 72)::INT) AS "right", least(200, trunc((l_quantity * 2 + 8) * 150 / 72)::INT) AS bottom FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, "left"::BIGINT AS "left", top::BIGINT AS top, "right"::BIGINT AS "right", bottom::BIGINT AS bottom FROM b WHERE "right" > "left" AND bottom > top""")
def crop_pixels(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    regions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("x0"), (q * 3).alias("x1"), (q - 4).alias("y0"), (q * 2).alias("y1"))
    return longs(islands.crop_boxes(regions, F.lit(300), F.lit(200)).drop("x0", "x1", "y0", "y1"))


@query("""WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey, l_quantity > 15 AS bar FROM lineitem),
y AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM x WHERE bar),
z AS (SELECT l_orderkey, run, min(pos) AS first, count(*) AS n, string_agg('| ' || l_partkey || ' |', '/' ORDER BY pos) AS lines FROM y GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS table_no, n AS n_rows, lines FROM z""")
def order_tables(spark, sf_dir):
    """Orders as texts, of which items of a larger quantity are rows of tables."""
    line = F.when(F.col("l_quantity") > 15, F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" |"))).otherwise("text")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", line.alias("line"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))
    found = islands.markdown_tables(texts, "l_orderkey", "text")
    return longs(found.select("l_orderkey", "table_no", F.size(papers.table_rows(F.col("lines"))).alias("n_rows"), F.array_join("lines", "/").alias("lines")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_records(spark, sf_dir):
    """Of each user the last event, as the last of a document's records in a manifest counts."""
    return tasks.last_records(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS state FROM part UNION ALL SELECT p_partkey + 1000000000, 'new' FROM part WHERE p_size > 40")
def upserted(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    new = part.filter("p_size > 25").select("p_partkey", F.lit("new").alias("state")).unionByName(part.filter("p_size > 40").select((F.col("p_partkey") + 1_000_000_000).alias("p_partkey"), F.lit("new").alias("state")))
    return tasks.upsert(part.select("p_partkey", F.lit("old").alias("state")), new, "p_partkey")


@query("""SELECT value FROM (SELECT 'topic' || chr(9) || '0' || chr(9) || '1' || chr(9) || '2' || chr(9) || '3' || chr(9) || 'total' AS value UNION ALL
SELECT lang || chr(9) || count(*) FILTER (quality = 0) || chr(9) || count(*) FILTER (quality = 1) || chr(9) || count(*) FILTER (quality = 2) || chr(9) || count(*) FILTER (quality = 3) || chr(9) || count(*) FROM labels JOIN documents USING (doc_id) GROUP BY lang)""")
def label_report(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("qid")), "doc_id")
    return sinks.histogram_lines(judging.label_histogram(judged, "qid", "quality"))


@query("SELECT (doc_id % 10) || ' 0 ' || doc_id || ' ' || quality AS value FROM labels")
def judgement_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("qid"), F.lit(0).alias("iter"), F.col("doc_id").alias("docno"), F.col("quality").alias("rel"), F.col("doc_id").alias("at"))
    return sinks.qrels_lines(rows)


@query("SELECT 'measure {' || chr(10) || '  key: \"share of good\"' || chr(10) || '  value: \"' || printf('%.6f', avg(quality)) || '\"' || chr(10) || '}' AS value FROM labels")
def measure_block(spark, sf_dir):
    return sinks.prototext(table(spark, sf_dir, "labels").agg(F.lit("share of good").alias("key"), F.avg("quality").alias("value")).select("key", "value"))


_DETECTED = "WITH found AS ({0}) SELECT lang, count(*) AS n, count(*) FILTER (language = lang) AS n_right FROM documents JOIN found USING (doc_id) GROUP BY lang"


def _detected_sql() -> str:
    from corpusloom.plans import oracle

    return _DETECTED.format(oracle.LANGUAGE)


@query(_detected_sql())
def language_accuracy(spark, sf_dir):
    """How often the language that a text's words tell is the one that its row names."""
    right = F.coalesce(web.detect_language(F.col("text")) == F.col("lang"), F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
