"""SQL for DuckDB that gives what the registered queries give, and cases whose answers are known."""

from __future__ import annotations

from corpusloom.functions.titles import TITLE_STOPWORDS
from corpusloom.operators.review import POLICIES
from corpusloom.sources.web import PROFILES

_TOKENS = r"regexp_extract_all(lower({}), '\p{{L}}+')"
_FORMULAS = {
    "bm25": "log2((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * (9.0 * qtf / (8.0 + qtf))",
    "tf-idf": "qtf * 1.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avdl)) * log2(n / df + 1)",
    "dirichlet-lm": "qtf * (log2(1 + tf / (2500.0 * cf / total)) + log2(2500.0 / (dl + 2500.0)))",
    "hiemstra-lm": "qtf * log2(1 + 0.15 * tf * total / (0.85 * cf * dl))",
    "pl2": "qtf * (tfn * log2(tfn / (cf / n)) + (cf / n - tfn) * log2(exp(1.0)) + 0.5 * log2(2 * pi() * tfn)) / (tfn + 1)",
    "dph": "CASE WHEN tf < dl THEN qtf * (1 - tf / dl) * (1 - tf / dl) / (tf + 1) * (tf * log2(tf * (avdl / dl) * (n / cf)) + 0.5 * log2(2 * pi() * tf * (1 - tf / dl))) ELSE 0 END",
    "dlh": "CASE WHEN tf < dl THEN qtf * (tf * log2(tf * (avdl / dl) * (n / cf)) + (dl - tf) * log2(1 - tf / dl) + 0.5 * log2(2 * pi() * tf * (1 - tf / dl))) / (tf + 0.5) ELSE 0 END",
    "lgd": "qtf * log2((df / n + tfn) / (df / n))",
    "dfic": "CASE WHEN tf > e THEN qtf * log2(1 + (tf - e) * (tf - e) / e) ELSE 0 END",
    "dfiz": "CASE WHEN tf > e THEN qtf * log2(1 + (tf - e) / sqrt(e)) ELSE 0 END",
}


def _ctes(name: str, model: str, depth: int = 10) -> str:
    return f"""{name}_s AS (SELECT qid, docno, round(sum({_FORMULAS[model]}), 6) AS score FROM joined GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS rank FROM {name}_s) WHERE rank <= {depth})"""


_JOINED = rf"""WITH d AS (SELECT doc_id AS docno, {_TOKENS.format("text")} AS tok FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(tok))::DOUBLE AS total, avg(len(tok)) AS avdl FROM d),
post AS (SELECT term, docno, dl, count(*)::DOUBLE AS tf FROM (SELECT docno, len(tok)::DOUBLE AS dl, unnest(tok) AS term FROM d) GROUP BY 1, 2, 3),
terms AS (SELECT term, count(*)::DOUBLE AS df, sum(tf) AS cf FROM post GROUP BY 1),
q AS (SELECT qid, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS qid, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
joined AS (SELECT *, tf * log2(1 + avdl / dl) AS tfn, cf * dl / total AS e FROM q JOIN post USING (term) JOIN terms USING (term) CROSS JOIN stats)"""


def ranked(model: str, depth: int = 10) -> str:
    return f"{_JOINED},\n{_ctes('r', model, depth)}\nSELECT qid, docno, rank, score FROM r"


TOKENIZE = f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)"
INDEX_STATS = f"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM d)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT n, total, avdl, terms, postings, max_df FROM (SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(avg(len(t)), 6) AS avdl FROM d),
(SELECT count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS max_df FROM df)"""
POOL = f"""{_JOINED},
{_ctes("a", "bm25")},
{_ctes("b", "tf-idf")},
u AS (SELECT DISTINCT qid, docno FROM (SELECT qid, docno, rank FROM a UNION ALL SELECT qid, docno, rank FROM b) WHERE rank <= 5)
SELECT qid, string_agg(docno::VARCHAR, ',' ORDER BY docno) AS docnos, count(*) AS size FROM u GROUP BY 1"""
NDCG = f"""{_JOINED},
{_ctes("r", "bm25")},
dw AS (SELECT docno, ' ' || array_to_string(tok, ' ') || ' ' AS w FROM d), bw AS (SELECT item_id AS qid, ' ' || array_to_string({_TOKENS.format("text")}, ' ') || ' ' AS w FROM benchmark),
j AS (SELECT DISTINCT qid, docno FROM dw JOIN bw ON contains(dw.w, bw.w) WHERE trim(bw.w) <> ''),
best AS (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY docno) AS place FROM j),
i AS (SELECT qid, sum(1 / log2(place + 1)) AS i FROM best WHERE place <= 10 GROUP BY 1), g AS (SELECT qid, sum(1 / log2(rank + 1)) AS g FROM r JOIN j USING (qid, docno) GROUP BY 1)
SELECT qid, round(coalesce(g, 0) / i, 6) AS ndcg FROM i LEFT JOIN g USING (qid)"""
HISTOGRAM = "SELECT lang, count(*) FILTER (quality = 0) AS c0, count(*) FILTER (quality = 1) AS c1, count(*) FILTER (quality = 2) AS c2, count(*) FILTER (quality = 3) AS c3, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY 1"
ACCURACY = "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS accuracy FROM labels"
ID_CHECK = "SELECT doc_id AS id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"
ROUTING = "SELECT CASE WHEN lang IN ('de', 'en') THEN 'written-' || lang ELSE 'excluded' END AS status, count(*) AS n FROM documents GROUP BY 1"
_COUNTS = ", ".join("struct_pack(n := len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in ws.split()) + f"))), l := '{k}')" for k, ws in PROFILES.items())
LANGUAGE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(substring(text, 1, 10000)), '\p{{L}}+') AS t FROM documents), c AS (SELECT doc_id, list_sort([{_COUNTS}], 'DESC')[1] AS best FROM d)
SELECT doc_id, CASE WHEN best.n > 0 THEN best.l END AS language FROM c"""
PROJECTION = r"""SELECT page_id::VARCHAR AS doc_id, url, 'en' AS language, title, content, concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(content, '')) AS text
FROM (SELECT page_id, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS content FROM pages)"""
_TASKS = "t AS (SELECT o_orderkey AS task_id, coalesce(n, 0) AS n, o_custkey % 7 AS teams, o_orderpriority, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_RATIO = "CASE WHEN teams <> 0 THEN n::DOUBLE / teams END"
COVERAGE = f"WITH {_TASKS} SELECT task_id, n, teams, {_RATIO} AS ratio, printf('%.3f', {_RATIO})::DOUBLE AS rounded FROM t"
SELECT = f"""WITH {_TASKS} SELECT task_id, n, teams, {_RATIO} AS ratio, printf('%.3f', {_RATIO})::DOUBLE AS rounded FROM t ORDER BY ({_RATIO}) IS NULL, ({_RATIO}) DESC,
CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderstatus = 'F', n DESC, task_id LIMIT 50"""
VIOLATIONS = """WITH i AS (SELECT * FROM lineitem), t AS (SELECT l_orderkey, 't' || (l_orderkey % 1000) AS task_id, count(*)::DOUBLE / (1 + l_orderkey % 3) AS ratio FROM i GROUP BY 1),
u AS (SELECT 't' || (l_orderkey % 1000) AS task_id, l_partkey::VARCHAR AS url FROM i UNION ALL SELECT task_id, 'o' || l_orderkey FROM t)
SELECT DISTINCT 'duplicate task_id' AS rule, task_id AS subject FROM t GROUP BY task_id HAVING count(*) > 1
UNION ALL SELECT 'pdf_url in several tasks', url FROM u GROUP BY url HAVING count(DISTINCT task_id) > 1
UNION ALL SELECT DISTINCT 'coverage_ratio out of bounds', task_id FROM t WHERE ratio NOT BETWEEN 0 AND 1.5"""
REPORT = "SELECT o_orderpriority AS parent_venue, year(o_orderdate)::BIGINT AS year, count(*) AS tasks FROM orders GROUP BY 1, 2"
ARGMAX = rf"""WITH p AS (SELECT p_brand AS brand, p_partkey AS part, p_size, unnest(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(p_name || ' ' || p_type, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in TITLE_STOPWORDS)})))) AS token FROM part),
o AS (SELECT brand, part AS overview, token, count(*) OVER (PARTITION BY brand, token) AS n FROM p WHERE p_size = 1),
s AS (SELECT p.brand, p.part, overview, sum(CASE WHEN n <= 20 THEN (232792560 // n)::DECIMAL(38, 9) ELSE (232792560 / n)::DECIMAL(38, 9) END) AS score FROM p JOIN o USING (brand, token) WHERE p_size > 1 GROUP BY 1, 2, 3),
b AS (SELECT *, max(score) OVER (PARTITION BY brand, part) AS top FROM s)
SELECT brand, part, min(overview) AS overview FROM b WHERE score = top GROUP BY 1, 2 HAVING count(*) = 1"""
SESSIONS = """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2"""
SEARCH_QUERY = "thing a1 der that x"
_TERMS = ["thing", "a1", "der", "that"]
_FOLD = "replace(lower(l), 'ß', 'ss')"
_SCORE = " + ".join(f"((length({_FOLD}) - length(replace({_FOLD}, '{t}', ''))) // {len(t)})" for t in _TERMS)
SEARCH = rf"""WITH x AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
n AS (SELECT *, lag(l) OVER w AS before, lead(l) OVER w AS after FROM x WINDOW w AS (PARTITION BY lang, doc_id ORDER BY line)),
s AS (SELECT lang, doc_id, line, {_SCORE} AS score, concat_ws(' ', nullif(trim(before), ''), nullif(trim(l), ''), nullif(trim(after), '')) AS snippet FROM n)
SELECT lang, score::BIGINT AS score, doc_id, line::BIGINT AS line, snippet FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id, line) AS k FROM s WHERE score > 0) WHERE k <= 20"""
DATES = "SELECT o_orderkey, o_orderdate::DATE <= DATE '1995-06-17' AS passed, strftime(o_orderdate, '%Y-%m-%d') || ' <= 1995-06-17' AS expression FROM orders"
SUMS = "SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS total, ((1 - l_orderkey % 4) * 0.01)::DOUBLE AS difference, l_orderkey % 4 <> 3 AS passed FROM lineitem GROUP BY 1"
_PAIRS = """tp AS (SELECT conv_id || '-' || turn AS id, text, lag(text) OVER w AS before, row_number() OVER w AS place FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT id, text FROM tp WHERE place > 1), r AS (SELECT id, before AS text FROM tp WHERE place > 1), k AS (SELECT id FROM h JOIN r USING (id))"""


def _grams(side: str, tokens: str, order: int) -> str:
    return f"""{side}t AS (SELECT id, {tokens} AS t FROM {side} JOIN k USING (id)),
{side}g AS (SELECT id, n, gram, count(*) AS c FROM (SELECT id, n, unnest([array_to_string(t[i:i + n - 1], chr(31)) FOR i IN range(1, len(t) - n + 2)]) AS gram FROM {side}t, (SELECT unnest(range(1, {order + 1})) AS n)) GROUP BY 1, 2, 3)"""


def _overlap(tokens: str, order: int) -> str:
    return f"""WITH {_PAIRS}, {_grams("h", tokens, order)}, {_grams("r", tokens, order)},
o AS (SELECT id, n, sum(least(coalesce(hg.c, 0), coalesce(rg.c, 0)))::BIGINT AS matched, sum(coalesce(hg.c, 0))::BIGINT AS in_hypothesis, sum(coalesce(rg.c, 0))::BIGINT AS in_reference FROM hg FULL JOIN rg USING (id, n, gram) GROUP BY 1, 2)"""


NGRAMS = _overlap(_TOKENS.format("text"), 4) + "\nSELECT id, n::BIGINT AS n, matched, in_hypothesis, in_reference FROM o"
CHRF = _overlap(r"string_split(regexp_replace(text, '\s+', '', 'g'), '')", 6) + """,
a AS (SELECT n, sum(matched) AS m, sum(in_hypothesis) AS h, sum(in_reference) AS r FROM o GROUP BY 1), p AS (SELECT avg(m / h) AS p, avg(m / r) AS q FROM a WHERE h > 0 AND r > 0)
SELECT round(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM p"""
_ROUGE_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
ROUGE = _overlap(_ROUGE_WORDS, 2) + """,
f AS (SELECT id, n, CASE WHEN matched > 0 THEN 2.0 * matched / (in_hypothesis + in_reference) ELSE 0 END AS f FROM o)
SELECT id, round(coalesce(max(f) FILTER (n = 1), 0), 9)::DOUBLE AS rouge1, round(coalesce(max(f) FILTER (n = 2), 0), 9)::DOUBLE AS rouge2 FROM k LEFT JOIN f USING (id) GROUP BY 1"""
_BLEU_WORDS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(text, chr(10), ' ') || ' ', '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"""
BLEU = _overlap(_BLEU_WORDS, 4) + """,
a AS (SELECT n, sum(matched)::DOUBLE AS m, sum(in_hypothesis)::DOUBLE AS t FROM o GROUP BY 1 HAVING sum(in_hypothesis) > 0),
b AS (SELECT n, m, t, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM a),
l AS (SELECT (SELECT sum(len(t)) FROM ht)::DOUBLE AS hl, (SELECT sum(len(t)) FROM rt)::DOUBLE AS rl)
SELECT round((CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1.0 END) * exp(avg(ln(CASE WHEN m = 0 THEN 100.0 / (pow(2.0, zeros) * t) ELSE 100.0 * m / t END))), 6) AS bleu FROM b, l GROUP BY hl, rl"""


def _text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def expected(cases: list[tuple[str, str | None]]) -> str:
    """The known answers, dealt over the rows of part."""
    return "SELECT p_partkey AS id, output FROM part JOIN (VALUES " + ", ".join(f"({i}, {_text(b)})" for i, (_, b) in enumerate(cases)) + f") AS v(place, output) ON p_partkey % {len(cases)} = place"


TITLE_KEYS = [("CheckThat!-2023", "checkthat 2023"), ("CheckThat! 2023", "checkthat 2023"), ("  A–B ", "a b")]
TITLE_WORDS = [("Overview of GeoLifeCLEF 2023", "2023 geo life"), ("PlantCLEF: a Plant Challenge", "plant")]
VENUES = [
    ("LifeCLEF - Biodiversity Identification", "LifeCLEF"),
    ("Overview of Biomedical Question Answering (BioASQ)", "BioASQ"),
    ("BioASQ: Large-scale Indexing", "BioASQ"),
    ("Touch Lab: Arguments", "Touch"),
    ("PAN Lab on Digital Text Forensics", "PAN"),
    ("Living Labs", "Living Labs"),
]
TASK_NAMES = [
    ("Overview of the Authorship Verification Task at PAN 2023", "Authorship Verification"),
    ("Overview of the Eloquent Lab: Task 2 on HalluciGen", "HalluciGen"),
    ("Extended Abstract of Plant Search.", "Plant Search"),
    ("Overview of", "Overview of"),
]
TEAMS = [
    ("UNSL's participation at eRisk 2021", "UNSL"),
    ("Team XYZ at PAN 2023: Styles", "XYZ"),
    ("ABC@PAN: Finding Authors", "ABC@PAN"),
    ("A Comparative Study of Models at PAN", None),
    ("Finding Authors", None),
]
NUMBERS = [("Overview of Task 1", "1"), ("Task2: Plants", "2"), ("Tasks", None)]
SLUGS = [("CheckThat! Lab -- 2023", "checkthat-lab-2023"), ("--x--", "x")]
TEAM_COUNTS = [
    ("98 teams registered for the lab, and we received results from 20 teams.", "20"),
    ("A total of 12 teams took part.", "12"),
    ("CENTRE 2019 teams up with others.", None),
    ("In the lab 31 teams registered.", None),
    ("There were 17 participating teams.\n1. Introduction\n2. Task 1\nHere 5 participating teams.", "17"),
]
RUN_COUNTS = [
    ("37 runs for Task 1, 48 runs for Task 2, and 20 runs for Task 3", "105"),
    ("67 runs for Task 1, 50 runs for Task 2, and 11 runs for the pilot task", "128"),
    ("Each team could submit up to 5 runs.", None),
    ("There were 41 valid runs.", "41"),
]
CODE_URLS = [
    ("Our code is available at https://github.com/team/repo. See https://github.com/huggingface/transformers.", "https://github.com/team/repo=true"),
    ("We used https://gitlab.com/a/b, thanks.", "https://gitlab.com/a/b=false"),
    ("None here.", ""),
    (("Words. " * 60) + "\nReferences\nhttps://github.com/cited/tool", ""),
    ("See\nReferences\n" + "https://github.com/early/x " + ("words " * 60), "https://github.com/early/x=false"),
]
THIRD_PARTY = [("https://github.com/huggingface/transformers", "true"), ("https://huggingface.co/bert-base-uncased", "true"), ("https://github.com/our-team/system", "false"), ("https://example.org/x", "false")]
PAPERS_TITLES = [("# A *Title* Here\n\ntext", "A Title Here"), ("no title", None)]
PAPERS_ABSTRACTS = [
    ("# T\n\n## Abstract\nWe do inter-\nesting things.\n\n## 1. Introduction\nNo.", "We do interesting things."),
    ("# T\n\n**Abstract.** One line.\n**Keywords** none", "One line."),
    ("# T\nAbstract: Here.\nMore.\nCopyright 2020", "Here. More."),
    ("# T\n\nNothing.", None),
]
ENGLISH = [("The foxes are running quickly.", "fox run quick"), ("Cats, dogs, and 123 birds!", "cat dog bird"), ("They aren't walking.", "walk")]
GERMAN = [("Die Füchse laufen sehr schnell.", "fuchs lauf schnell"), ("Katzen laufen.\nHunde sprangen.", "katz lauf hund sprang"), ("Größere Häuser und schöne Gärten.", "gross haus schon gart")]
PARSED_DATES = [("2026-10-20", "2026-10-20"), ("1.3.2026", "2026-03-01"), ("01.03.26", "2026-03-01"), ("1.3.70", "1970-03-01"), ("20/10/2026", None)]
TABLE_TEXT = "| a | b |\n|---|---|\n| 1 | 2 |\ntext\n| alone\ntext\n| c | d |\n| 3 | 4 |"
TABLES = "SELECT p_partkey AS doc, table_no, n_rows, lines FROM part, (VALUES ('a', 1::BIGINT, 2::BIGINT, '| a | b |/|---|---|/| 1 | 2 |'), ('a', 2, 2, '| c | d |/| 3 | 4 |')) AS v(d, table_no, n_rows, lines)"
RULED_PAGES = [
    ("a", 1, [(100.0, 445.0, 131.0, 131.0), (100.0, 445.0, 160.0, 160.0), (100.0, 445.0, 255.0, 255.0), (100.0, 156.0, 700.0, 700.0)]),
    ("b", 1, [(100.0, 445.0, 100.0, 100.0), (100.0, 445.0, 140.0, 140.0), (100.0, 445.0, 600.0, 600.0), (100.0, 445.0, 640.0, 640.0)]),
    ("c", 1, [(100.0, 445.0, 100.0, 100.0)]),
]
REGIONS = "SELECT doc, p_partkey AS page, index, x0, x1, y0, y1 FROM part, (VALUES ('a', 1::BIGINT, 1::BIGINT, 100.0::DOUBLE, 445.0::DOUBLE, 131.0::DOUBLE, 255.0::DOUBLE), ('b', 1, 1, 100, 445, 100, 140), ('b', 1, 2, 100, 445, 600, 640)) AS v(doc, p, index, x0, x1, y0, y1)"
ANSWERS = [
    ("c1", 'So: {"antrag": "c1", "result": "abgelehnt", "begruendung": " Zu spät. "} Ende', "abgelehnt", "Zu spät.", None),
    ("c2", '```json\n{"antrag": "c2", "result": "angenommen", "begruendung": "Gut"}\n```', "angenommen", "Gut", None),
    ("c3", "abgelehnt", None, None, "no JSON object"),
    ("c4", '{"antrag": "c1", "result": "abgelehnt", "begruendung": "x"}', "abgelehnt", "x", "another case"),
    ("c5", '{"antrag": "c5", "result": "vielleicht", "begruendung": "x"}', "vielleicht", "x", "invalid result"),
    ("c6", '{"antrag": "c6", "result": "abgelehnt", "begruendung": " "}', "abgelehnt", "", "no reason"),
]
DECISIONS = "SELECT p_partkey AS id, case_id, result, begruendung, problem FROM part JOIN (VALUES " + ", ".join(f"({i}, {_text(c)}, {_text(r)}, {_text(b)}, {_text(p)})" for i, (c, _, r, b, p) in enumerate(ANSWERS)) + f") AS v(place, case_id, result, begruendung, problem) ON p_partkey % {len(ANSWERS)} = place"
#: Words that topics end with, in turn.
TOPICS = ("Stipendium", "Rechnung Kosten", "Ausland A1 ausland", "x", "Die der private Reise", "all")
_RULES = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in POLICIES.items())
POLICY = f"""WITH rules(key, policy) AS (VALUES {_RULES}), t AS (SELECT p_partkey, p_type || ' ' || [{", ".join(map(_text, TOPICS))}][(p_partkey % {len(TOPICS)} + 1)::INT] AS topic FROM part),
w AS (SELECT p_partkey, unnest(list_filter(regexp_extract_all(lower(topic), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)) AS term FROM t),
s AS (SELECT p_partkey, key, sum((length(lower(key || ' ' || policy)) - length(replace(lower(key || ' ' || policy), term, ''))) // length(term))::BIGINT AS score FROM w, rules GROUP BY 1, 2)
SELECT p_partkey, key, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, key) AS place FROM s WHERE score > 0) WHERE place <= 4"""
