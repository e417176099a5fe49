import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tasks
from corpusloom.sources import files, sinks, web


def record(kind, url, http, n):
    body = http if isinstance(http, bytes) else http.encode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


PAGE = "<html><head><title>Seite &amp; mehr</title><script>x<y</script></head><body><nav>Menü</nav><p>Das ist ein Text, der nicht leer ist und auf Deutsch.</p><div class='comments'>nein</div></body></html>"


def test_warc_to_documents(spark, tmp_path):
    ok = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + PAGE
    zipped = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"<title>T</title><p>This is the text of an English page and it is not long.</p>")
    odd = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: zz\r\n\r\nx"
    data = [record("request", "u", "GET / HTTP/1.1\r\n\r\n", 0), record("response", "u1", ok, 1), record("response", "u2", zipped, 2), record("response", "u3", "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nx", 3), record("response", "u4", odd, 4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    docs, counts = web.build_documents(web.read_warc(spark, str(tmp_path / "in")))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got["1"]["language"] == "de" and got["1"]["title"] == "Seite & mehr" and "Menü" not in got["1"]["text"] and "nein" not in got["1"]["text"]
    assert got["1"]["text"].startswith("Seite & mehr\n\nDas ist") and got["2"]["language"] == "en"
    assert {r["status"]: r["count"] for r in counts.collect()} == {"processed": 4, "written-de": 1, "written-en": 1, "failed": 1}
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/language=de")).count() == 1


TOC = """<h3><span class="CEURSESSION">Lab A: X</span></h3><ul><li><a href="p1.pdf"><span class="CEURTITLE">First
 title</span></a> <span class="CEURAUTHOR">A B</span>, <span class="CEURAUTHOR">C</span></li><li>no title</li><li><a href="p3.pdf"><span class="CEURTITLE">Third</span></a></li></ul><h3>Other</h3><ul><li>x</li></ul>"""


def test_contents_and_bibliography(spark):
    pages = spark.createDataFrame([(TOC, "http://v/")], "html string, base_url string")
    got = web.read_contents(pages).collect()
    assert [(r["section"], r["position"], r["title"], r["authors"], r["pdf_url"]) for r in got] == [("Lab A: X", 1, "First title", ["A B", "C"], "http://v/p1.pdf"), ("Lab A: X", 3, "Third", [], "http://v/p3.pdf")]
    entry = '<ul><li class="entry inproceedings"><span itemprop="author"><span itemprop="name">A B</span></span><span class="title">First title.</span></li></ul>'
    assert [tuple(r) for r in web.read_bibliography(spark.createDataFrame([(entry,)], "html string")).collect()] == [("First title", ["A B"], 0)]


def test_runs_qrels_and_round_trips(spark, tmp_path):
    (tmp_path / "r/x").mkdir(parents=True)
    (tmp_path / "r/run.txt").write_text("1 Q0 a 1 3.0 test\n")
    (tmp_path / "r/x/run.txt.gz").write_bytes(gzip.compress(b"1 Q0 b 1 2.5 test\n"))
    (tmp_path / "r/x/other.txt").write_text("1 Q0 z 1 2.5 test\n")
    got = files.runs(spark, str(tmp_path / "r"))
    assert sorted(r["docno"] for r in got.collect()) == ["a", "b"]
    sinks.write_run(got.drop("tag"), str(tmp_path / "out"), "t")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 Q0 a 1 3.0 t", "1 Q0 b 1 2.5 t"]
    (tmp_path / "q").write_text("1 0 a 3\n")
    assert [tuple(r) for r in files.qrels(spark, str(tmp_path / "q")).collect()] == [("1", 0, "a", 3)]
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError):
        files.runs(spark, str(tmp_path / "e"))


def test_strict_summaries(spark, tmp_path):
    def read(*lines):
        (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
        return files.summaries(spark, str(tmp_path / "s.jsonl"))

    good = json.dumps({"id": "a", "summary": "x"})
    assert read(good, json.dumps({"id": "b", "summary": "y"})).count() == 2
    for bad, message in (("{", "2: invalid JSON"), ('{"id": 3, "summary": "x"}', "2: 'id'"), ('{"id": "c", "summary": " "}', "2: 'summary'"), (good, "2: duplicate id 'a'")):
        with pytest.raises(ValueError, match=message):
            read(good, bad)


def test_papers_and_cases(spark, tmp_path):
    for i in ("1", "2"):
        (tmp_path / f"p/{i}").mkdir(parents=True)
        (tmp_path / f"p/{i}/paper.txt.md").write_text("# T")
    assert sorted(r["id"] for r in files.papers(spark, str(tmp_path / "p")).collect()) == ["1", "2"]
    (tmp_path / "c/case-1").mkdir(parents=True)
    (tmp_path / "c/case-1/a.pdf").write_bytes(b"xx")
    (tmp_path / "c/case-1/b.txt").write_bytes(b"x")
    assert [tuple(r) for r in files.case_files(spark, str(tmp_path / "c")).collect()] == [("case-1", "a.pdf", 2)]
    assert files.case_files(spark, str(tmp_path / "c"), only_pdf=False).count() == 2


def test_pool_file(spark, tmp_path):
    pools = spark.createDataFrame([("10", ["a"]), ("2", ["b", "c"])], "qid string, docnos array<string>")
    text = sinks.pool_json(pools).first()[0]
    assert json.loads(text) == {"10": ["a"], "2": ["b", "c"]} and text.index('"10"') < text.index('"2"')
    (tmp_path / "pool.json").write_text(text)
    assert {r["qid"]: r["docnos"] for r in sinks.cached_pool(spark, str(tmp_path / "pool.json")).collect()} == {"10": ["a"], "2": ["b", "c"]}
    assert sinks.cached_pool(spark, str(tmp_path / "none.json")) is None


def test_prototext_and_names(spark):
    rows = spark.createDataFrame([("BLEU", 12.3456789)], "key string, value double")
    assert sinks.prototext(rows).first()[0] == 'measure {\n  key: "BLEU"\n  value: "12.345679"\n}'
    assert spark.range(1).select(sinks.quoted_name(F.lit("a b/c"))).first()[0] == "a%20b%2Fc"


def test_landing_table_and_manifest_order(spark, tmp_path):
    known = spark.createDataFrame([("u1", "x")], "url string, body string")
    fetched = spark.createDataFrame([("u1", "new", 200), ("u2", "y", 200), ("u3", "z", 404)], "url string, body string, http_status int")
    assert {r["url"]: (r["status"], r["body"]) for r in web.landing_table(fetched, known).collect()} == {"u1": ("cached", "x"), "u2": ("fetched", "y"), "u3": ("failed", None)}
    (tmp_path / "m.jsonl").write_text('{"pdf_url": "a", "chars": 1}\n{"pdf_url": "a", "chars": 2}\n')
    assert [r["chars"] for r in tasks.last_records(files.manifest(spark, str(tmp_path / "m.jsonl"))).collect()] == [2]


def test_volumes(spark):
    assert files.volumes(spark).count() == 8 and files.volumes(spark, "3497").first()["year"] == 2023


def test_line_numbers_do_not_hang_on_how_a_file_is_split(spark, tmp_path):
    import random

    r = random.Random(2)
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 7)):
        (tmp_path / name).write_text("".join("x" * r.choice((0, 1, 50, 900)) + f"-{i}\n" for i in range(n)).removesuffix("\n" if name == "b.jsonl" else "none"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("200k", "10k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = files.numbered_lines(spark, str(tmp_path)).collect()
            assert len(got) == 3007
            assert all(r["value"].rsplit("-", 1)[1] == str(r["line_no"] - 1) for r in got)
            (tmp_path / "s.jsonl").write_text("".join('{"id": "%d", "summary": "s"}\n' % i for i in range(2000)) + '{"id": "3", "summary": "s"}\n')
            with pytest.raises(ValueError, match=r":2001: duplicate id '3'"):
                files.summaries(spark, str(tmp_path / "s.jsonl"))
            (tmp_path / "s.jsonl").unlink()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_pools_are_written_by_any_number_of_tasks(spark, tmp_path):
    import json

    pools = spark.range(500).selectExpr("cast(id as string) as qid", "array(cast(id * 2 as string), 'q\"x') as docnos")
    for n in (1, 50):
        sinks.write_pool(pools.repartition(n), str(tmp_path / f"p{n}"))
        text = "".join(p.read_text() for p in sorted((tmp_path / f"p{n}").glob("part-*")))
        assert json.loads(text) == {str(i): [str(2 * i), 'q"x'] for i in range(500)} and list(json.loads(text)) == sorted(map(str, range(500)))
        assert sinks.cached_pool(spark, str(tmp_path / f"p{n}")).count() == 500
    for indent in (None, 0, 2):
        (tmp_path / "other.json").write_text(json.dumps({"a": ["1", "2"], "b": []}, indent=indent) + "\n")
        assert {r["qid"]: r["docnos"] for r in sinks.cached_pool(spark, str(tmp_path / "other.json")).collect()} == {"a": ["1", "2"], "b": []}
