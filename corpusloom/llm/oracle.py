"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Rows of documents with a null text count as empty ones where the contract says so.
OP1 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(list_transform(range(1, len(x) + 1), lambda i: {'pos': i, 'line': x[i]})) AS l
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
), content AS (
  SELECT doc_id, source, l.pos AS pos, l.line AS line, trim(l.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS c FROM lines
), spread AS (
  SELECT c, min({'doc': doc_id, 'pos': pos}) AS first FROM content WHERE c <> '' GROUP BY c HAVING count(DISTINCT source) >= 10
), judged AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND first <> {'doc': doc_id, 'pos': pos} AS gone FROM content LEFT JOIN spread USING (c)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS w FROM docs, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS t(i)
), first AS (
  SELECT w, min(doc_id) AS owner FROM windows GROUP BY w HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM windows JOIN first USING (w) WHERE owner < doc_id
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run
), rest AS (
  SELECT doc_id, run, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS b FROM spans
  UNION ALL
  SELECT doc_id, 0, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY run) AS h FROM rest JOIN docs USING (doc_id) GROUP BY doc_id
), figures AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(f.n_removed, 0) AS n_removed, coalesce(f.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN figures f USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

#: For pages like those of the tables, whose article is an article element with headings and paragraphs.
OP3 = r"""
WITH parts AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS x FROM pages
), marked AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(h1|p)>', chr(0), 'g') AS x FROM parts
), plain AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS x FROM marked
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split(x, chr(0)), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS blocks FROM plain
)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM blocks
"""

_WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4 = rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, {_WORDS4} AS w FROM benchmark
), lengths AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0
), known AS (
  SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS win FROM lengths, unnest(range(1, len(w) - m + 2)) AS t(i)
), sizes AS (
  SELECT DISTINCT m FROM known
), docs AS (
  SELECT doc_id, {_WORDS4} AS w FROM documents
), windows AS (
  SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win FROM docs, sizes, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(i)
), hits AS (
  SELECT doc_id, i, windows.m AS m, item_id FROM windows JOIN known ON windows.m = known.m AND windows.win = known.win
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + m)) AS t(k) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_SPACE = r"\x20\x09-\x0D"
FIGURES = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM docs, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i)
), repeated AS (
  SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1
), again AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM windows JOIN repeated USING (doc_id, win), unnest(range(i, i + 5)) AS t(k) GROUP BY doc_id
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM docs LEFT JOIN again USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures
"""

OP9 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared_n >= 75 * (x.n + y.n - shared_n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), least AS (
  SELECT doc_id, least(doc_id, min(other)) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_WORDS11 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_WORDS11} AS w FROM documents
), totals AS (
  SELECT count(*) FILTER (len(w) > 0) AS total_n, sum(len(w))::BIGINT AS total_l FROM docs
), counts AS (
  SELECT d, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY d, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(total_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM counts, totals GROUP BY term
), asked AS (
  SELECT row, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS row, item_id, unnest({_WORDS11}) AS term FROM benchmark) GROUP BY row, item_id, term
), scores AS (
  SELECT row, item_id, d, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total_n) // total_l))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY row, item_id, d, doc_id
), ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""

OP12 = OP9.replace(">= 75 *", ">= 80 *").replace(", coalesce(component_id, d.doc_id) = d.doc_id AS kept", "")

#: The checksum goes byte by byte over a table that a rule makes.
OP13 = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i))
), runs AS (
  SELECT doc_id, word, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word FROM documents WHERE text IS NOT NULL
  ) WHERE length(word) >= 5 GROUP BY doc_id, word
), hashed AS MATERIALIZED (
  SELECT doc_id, word, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(b), 2), lambda i: 16 * instr('0123456789ABCDEF', b[i]) + instr('0123456789ABCDEF', b[i + 1]) - 17)), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM (SELECT doc_id, word, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)) AS b, crc FROM runs, bits)
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(word, 1, (h % length(word))::INTEGER) || substring(word, (h % length(word))::INTEGER + 2) ELSE word END AS word, times FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cuts AS MATERIALIZED (
  SELECT DISTINCT word, n, p, substring(word, 1, p) || substring(word, p + 2) AS rest FROM words, unnest(range(length(word))) AS t(p)
), pairs AS MATERIALIZED (
  SELECT x.word AS word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cuts c ON w.word = c.rest
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cuts c ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, min({'n': -other_n, 'word': other}) AS top FROM pairs GROUP BY word
), near AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.word END AS form, CASE WHEN -top.n >= 2 * n THEN -top.n END AS form_n FROM words LEFT JOIN best USING (word)
), forms AS MATERIALIZED (
  SELECT word, form FROM near WHERE form IS NOT NULL
), ways AS (
  SELECT word, form AS root, 1 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM ways w JOIN forms f ON f.word = w.root
), last AS (
  SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM near LEFT JOIN last USING (word)
"""

ORACLE = {
    "op1_line_dedup": OP1,
    "op2_substring_dedup": OP2,
    "op3_html_extraction": OP3,
    "op4_decontamination": OP4,
    "quality_figures": FIGURES,
    "op9_near_dedup": OP9,
    "op11_lexical_search": OP11,
    "op12_jaccard_join": OP12,
    "op13_spelling_variants": OP13,
}
