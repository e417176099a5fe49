"""Web archives and pages: records, documents, tables of contents, bibliographies."""

from __future__ import annotations

import gzip
import html as entities
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import cut, ship
from corpusloom.sources import content

RESPONSE = "record_id string, url string, content_type string, charset string, body binary, error string"
PAPER = "section string, section_no int, position int, title string, authors array<string>, pdf_url string"
ENTRY = "title string, authors array<string>, ord int"
LANGUAGES = ("de", "en")
DETECT_CHARS = 10_000


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _members(data: bytes) -> Iterator[bytes]:
    """Contents of the members of a gzip file, or the data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data.lstrip(b"\0")


def _decoded(body: bytes, head: dict[str, str]) -> bytes:
    if "chunked" in head.get("transfer-encoding", "").lower():
        out, stream = [], io.BytesIO(body)
        while size := int(stream.readline().split(b";")[0].strip() or b"0", 16):
            out.append(stream.read(size))
            stream.readline()
        body = b"".join(out)
    for kind in reversed([k.strip().lower() for k in head.get("content-encoding", "").split(",")]):
        if kind in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif kind == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
        elif kind not in ("", "identity"):
            raise LookupError(f"content encoding {kind}")
    return body


def response(head: dict[str, str], block: bytes, kinds: set[str] | None = None) -> tuple[str | None, str | None, bytes | None, str | None]:
    """Content type, charset, body and error of a record's HTTP response; nothing of other records. Bodies of other content types than ``kinds`` aren't decoded."""
    if head.get("warc-type") != "response" or not head.get("content-type", "").startswith("application/http"):
        return None, None, None, None
    top, _, body = block.partition(b"\r\n\r\n")
    http = _headers(top)
    kind, _, rest = http.get("content-type", "").partition(";")
    kind = kind.strip().lower() or None
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", rest, re.I)
    charset = found[1] if found else None
    if kinds is not None and kind not in kinds:
        return kind, charset, None, None
    try:
        return kind, charset, _decoded(body, http), None
    except (LookupError, ValueError, OSError, zlib.error) as e:
        return kind, charset, None, f"{type(e).__name__}: {e}"


def responses(data: bytes) -> Iterator[tuple]:
    """Response records of a WARC file. One that can't be decoded has its error instead of a body."""
    for part in _members(data):
        at = 0
        while (start := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", start)
            if end < 0:
                return
            head = _headers(part[start:end])
            at = end + 4 + int(head.get("content-length", "0"))
            block = part[end + 4 : at]
            if head.get("warc-type") == "response" and head.get("content-type", "").startswith("application/http"):
                yield head.get("warc-record-id"), head.get("warc-target-uri"), *response(head, block)


def archives(spark: SparkSession, path: str) -> list[str]:
    """Names of the files that a path or glob names, sorted."""
    try:
        return sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of all archives that a path or glob names, one task for a file; none are an error.

    An archive is one value here, so it must have less than 2 GB.
    """
    ship(spark)
    if not archives(spark, path):
        raise ValueError(f"no archives at {path}")
    names = ["record_id", "url", "content_type", "charset", "body", "error"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for row in responses(data.as_py()):
                    rows.append(row)
                    if len(rows) == 100:
                        yield pa.record_batch([pa.array(c, pa.binary() if n == "body" else pa.string()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.binary() if n == "body" else pa.string()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(work, RESPONSE)


def main_content(records: DataFrame, body: str = "body", charset: str = "charset", terminated: bool = False) -> DataFrame:
    """``records`` with title, content and failure: the lines of the element that holds most of the page's prose (see ``sources.content``).

    The body is read as its charset, else as UTF-8. Errors are kept apart, not raised. References without a semicolon,
    such as those of text that was cut off, are decoded as HTML has it; ``terminated`` leaves them as they are.
    """
    ship(records.sparkSession)
    unescape = content.unescape_terminated if terminated else entities.unescape
    schema = T.StructType([*records.schema.fields, *[T.StructField(n, T.StringType()) for n in ("title", "content", "failure")]])
    i, j = records.columns.index(body), records.columns.index(charset)

    def one(data: bytes | None, name: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            page = content.parse((data or b"").decode(name or "utf-8", "replace"), unescape)
            return page.title, "\n".join(content.densest(page)), None
        except (LookupError, UnicodeError, ValueError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(a.as_py(), b.as_py()) for a, b in zip(batch.column(i), batch.column(j), strict=True)]
            yield pa.record_batch([*batch.columns, *[pa.array([g[k] for g in got], pa.string()) for k in range(3)]], names=schema.names)

    return records.mapInArrow(work, schema)


#: Common words that few other languages share; a text's language is the one whose words it holds most of.
PROFILES = {
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen",
    "en": "the of and to in is that it for was on are as with be by at this have from or had not but what all were when we there can an your which their said if do",
    "fr": "le la les de des et est en un une du dans que qui pour pas sur au par avec il ce ne se sont plus ou aux cette mais comme son nous vous",
    "es": "el la los las de y en que un una del por con no se su para es al lo como más pero sus le ha me si sin sobre este ya entre cuando",
    "it": "il di che la e in un è per una con non del si le da come sono dei al della più anche ma nel alla",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als maar bij door naar dan nog wel",
    "pt": "o a os as de e do da em um uma que para com não por mais dos como mas foi ao ele das tem à seu sua ou",
}


def detect_language(text: Column) -> Column:
    """Language of the first 10,000 characters by their common words; null if there are none."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, DETECT_CHARS)), F.lit(r"\p{L}+"), F.lit(0))
    counts = F.array(*[F.struct(F.size(F.filter(words, _among(w.split()))).alias("n"), F.lit(k).alias("language")) for k, w in PROFILES.items()])
    best = F.array_max(F.transform(counts, lambda x: F.struct(x["n"].alias("n"), x["language"].alias("language"))))
    return F.when(best["n"] > 0, best["language"])


def _among(words: list[str]):
    return lambda w: w.isin(words)


def project_documents(rows: DataFrame, record_id: str = "record_id") -> DataFrame:
    """doc_id, url, language, title, content, text: the text is title and content, as far as there are any."""
    bare = F.regexp_replace(F.regexp_replace(record_id, "^<urn:uuid:", ""), ">$", "")
    parts = F.filter(F.array("title", "content"), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.select(bare.alias("doc_id"), "url", "language", "title", "content", F.array_join(parts, "\n\n").alias("text"))


def build_documents(records: DataFrame, languages: tuple[str, ...] = LANGUAGES, terminated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents in the wanted languages, and how many records were processed, written (by language), excluded and failed.

    Records are read once: what they give is kept in the shared folder. Only HTML pages are parsed; ``terminated`` as in ``main_content``.
    """
    html = F.coalesce(F.col("content_type") == "text/html", F.lit(False))
    parsed = main_content(records.withColumn("body", F.when(html, F.col("body"))), terminated=terminated).withColumn("content", F.trim("content")).withColumn("language", detect_language(F.col("content")))
    failed = F.coalesce(F.col("error"), F.col("failure")).isNotNull()
    status = F.when(~html, None).when(failed, "failed").when(F.col("language").isin(*languages), F.concat(F.lit("written-"), F.col("language"))).otherwise("excluded")
    named = cut(parsed.withColumn("status", status).drop("body"), "pages")
    counts = named.filter("status is not null").groupBy("status").count()
    processed = named.agg(F.count("*").alias("count")).select(F.lit("processed").alias("status"), "count")
    return project_documents(named.filter(F.col("status").startswith("written"))), counts.unionByName(processed)


class _Tree(HTMLParser):
    """A small element tree: nodes are [tag, attributes, children], texts are strings."""

    VOID = content.VOID

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            for i in range(len(self.path) - 1, 0, -1):
                if self.path[i][0] in ("ul", "ol"):
                    break
                if self.path[i][0] == "li":
                    del self.path[i:]
                    break
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in self.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        self.path[-1][2].append(data)


def _walk(node) -> Iterator[list]:
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from _walk(child)


def _text(node) -> str:
    return " ".join("".join(x if isinstance(x, str) else _text(x) for x in node[2]).split()) if node else ""


def _classes(node) -> set[str]:
    return set((node[1].get("class") or "").split())


def contents_papers(page: str, base: str) -> Iterator[tuple]:
    """Papers of a table of contents: section, section_no, position, title, authors, pdf_url.

    Each heading with a session mark is followed by a list. Positions count all
    its items; items without title or link are left out.
    """
    flat = list(_walk(_Tree(page).root))
    number = 0
    for i, node in enumerate(flat):
        if node[0] not in ("h1", "h2", "h3", "h4"):
            continue
        mark = next((n for n in _walk(node) if n[0] == "span" and "CEURSESSION" in _classes(n)), None)
        listed = next((n for n in flat[i + 1 :] if n[0] == "ul"), None) if mark else None
        if listed is None:
            continue
        items = [c for c in listed[2] if not isinstance(c, str) and c[0] == "li"]
        for position, item in enumerate(items, 1):
            inner = list(_walk(item))
            title = next((_text(n) for n in inner if n[0] == "span" and "CEURTITLE" in _classes(n)), "")
            link = next((n[1]["href"] for n in inner if n[0] == "a" and n[1].get("href")), None)
            if title and link:
                authors = [_text(n) for n in inner if n[0] == "span" and "CEURAUTHOR" in _classes(n)]
                yield _text(mark), number, position, title, authors, base + link
        number += 1


def bibliography_entries(page: str) -> Iterator[tuple]:
    """title, authors, ord: entries of a bibliography page."""
    for i, node in enumerate(n for n in _walk(_Tree(page).root) if n[0] == "li" and {"entry", "inproceedings"} <= _classes(n)):
        inner = list(_walk(node))
        title = next((_text(n) for n in inner if n[0] == "span" and "title" in _classes(n)), "").removesuffix(".")
        people = [n for n in inner if n[0] == "span" and n[1].get("itemprop") == "author"]
        yield title, [_text(m) for p in people for m in _walk(p) if m[0] == "span" and m[1].get("itemprop") == "name"], i


def _rows_of(pages: DataFrame, extract, columns: list[str], schema: str) -> DataFrame:
    ship(pages.sparkSession)
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in extract(*values)]
            if rows:
                yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return pages.select(*columns).mapInArrow(work, schema)


def read_contents(pages: DataFrame, html: str = "html", base: str = "base_url") -> DataFrame:
    return _rows_of(pages, contents_papers, [html, base], PAPER)


def read_bibliography(pages: DataFrame, html: str = "html") -> DataFrame:
    return _rows_of(pages, bibliography_entries, [html], ENTRY)


def landing_table(fetched: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """A cache of fetched pages: what was known stays, of the rest only status 200 is stored."""
    old = known.select(key, "body", F.lit("cached").alias("status"))
    new = fetched.join(known.select(key), key, "left_anti").select(key, F.when(F.col("http_status") == 200, F.col("body")).alias("body"), F.when(F.col("http_status") == 200, "fetched").otherwise("failed").alias("status"))
    return old.unionByName(new)


__all__ = ["build_documents", "detect_language", "landing_table", "main_content", "project_documents", "read_bibliography", "read_contents", "read_warc"]
