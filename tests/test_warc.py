"""The data source of web archives: ranges of any length, gzip members and plain heads, filters, malformed tails."""

import gzip
import random

import pytest

from corpusloom.sources import warc


def record(i, kind="response", mime="text/html", body=None):
    body = body if body is not None else f"<p>page {i}</p>".encode() * (1 + i % 50)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + mime.encode() + b"; charset=utf-8\r\n\r\n" + body
    block = http if kind == "response" else b"about: this\r\n"
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://host/{i}\r\nContent-Type: {'application/http; msgtype=response' if kind == 'response' else 'application/warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive(path, zipped, n=60, tail=b""):
    r = random.Random(7)
    tricky = b"text\r\nWARC/1.0\r\nWARC-Type: response\r\nnot a head of its own " + warc.MAGIC + b"\0\0\0\0\0\0 and more"
    made = [record(i, "response" if i % 5 else "warcinfo", ("text/html", "image/png")[i % 7 == 0], tricky if i == 13 else r.randbytes(3000) if i == 21 else None) for i in range(n)]
    path.write_bytes((b"".join(map(gzip.compress, made)) if zipped else b"".join(made)) + tail)
    return made


@pytest.mark.parametrize("zipped", [True, False])
def test_every_record_is_read_once_for_any_length_of_ranges(tmp_path, zipped):
    made = archive(tmp_path / "a.warc", zipped)
    path, size = str(tmp_path / "a.warc"), (tmp_path / "a.warc").stat().st_size
    whole = [(at, h["warc-record-id"], b) for at, h, b in warc.records(path, 0, size)]
    assert [x[1] for x in whole] == [f"<urn:uuid:{i}>" for i in range(len(made))]
    r = random.Random(1)
    for length in (1, 7, 100, 333, 1000, 5000, size, *[r.randrange(1, size) for _ in range(10)]):
        parts = [x for a in range(0, size, length) for x in warc.records(path, a, min(a + length, size))] if length > 5 or not zipped else whole
        assert [(at, h["warc-record-id"], b) for at, h, b in parts] == whole if parts is not whole else True


@pytest.mark.parametrize("zipped", [True, False])
def test_several_tasks_read_what_one_reads(spark, tmp_path, zipped):
    archive(tmp_path / "a.warc.gz", zipped)
    archive(tmp_path / "b.warc.gz", zipped, 10)
    one, many = warc.read(spark, str(tmp_path)), warc.read(spark, f"{tmp_path}/*.warc.gz", 700)
    assert many.rdd.getNumPartitions() > 8
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert rows(one) == rows(many) and len(rows(one)) == 70
    got = many.filter("warc_type = 'response' and content_type in ('text/html')")
    assert {x["warc_type"] for x in got.collect()} == {"response"} and got.count() == sum(1 for n in (60, 10) for i in range(n) if i % 5 and i % 7)
    assert "EqualTo(warc_type" not in got._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("isnotnull", "")


@pytest.mark.parametrize("zipped", [True, False])
def test_malformed_tails_are_named(spark, tmp_path, zipped):
    cut = (gzip.compress(record(99)) if zipped else record(99))[:-30]
    archive(tmp_path / "a.warc", zipped, 5, cut)
    rows = warc.read(spark, str(tmp_path / "a.warc")).collect()
    assert len(rows) == 6 and rows[-1]["error"].startswith("malformed tail") and rows[-1]["archive"].endswith("a.warc")
    with pytest.raises(Exception, match="no archives"):
        warc.read(spark, str(tmp_path / "none*")).collect()
