"""Web archives as a Spark data source: ``spark.read.format("warc")``.

An archive is read in byte ranges, each by a task of its own. A range begins with the first record
that starts in it and ends with the record that starts before its end, whatever that one's
length: in a gzip file at members, in a plain one at record heads. So every record is
read once, for any length of ranges. Filters on ``warc_type`` and ``content_type`` are taken by
the source, so that bodies of other records are neither decoded nor handed over.

Columns: record_id, warc_type, url, content_type and charset (of the HTTP response), body, error, archive, at (the byte where
the record, or its gzip member, starts). A record that can't be decoded has an error instead of a body, and so has
what follows the last whole record of a file, its malformed tail.

Files are reached by pyarrow, or by open() for plain paths. What pyarrow doesn't know goes through ``web.read_warc``, which takes
whole files from Spark's own readers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "record_id string, warc_type string, url string, content_type string, charset string, body binary, error string, archive string, at bigint"
#: Bytes of a range, of a piece that is read at a time, and of a record's head at most.
RANGE, PIECE, HEAD = 64 << 20, 1 << 20, 1 << 20
#: Rows and bytes of bodies that are handed over at a time.
ROWS, BYTES = 200, 16 << 20
MAGIC = b"\x1f\x8b\x08"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class _File:
    """A file that is read forward in pieces from any place; ``data`` is what is at hand, from byte ``base``."""

    def __init__(self, path: str, at: int):
        from corpusloom.sources.open import open_random

        self.file, self.base, self.data, self.ended = open_random(path), at, b"", False
        self.file.seek(at)

    def more(self) -> bool:
        piece = b"" if self.ended else self.file.read(PIECE)
        self.ended = not piece
        self.data += piece
        return bool(piece)

    def drop(self, at: int) -> None:
        """Forget what lies before byte ``at``."""
        self.data, self.base = self.data[at - self.base :], at


class Tail(Exception):
    """What is left of a file is no whole record."""


def _member(file: _File, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and where it ends. With ``most``, no more than its first bytes, and no end."""
    d, out, next_at = zlib.decompressobj(31), [], at - file.base
    got = 0
    while True:
        piece = file.data[next_at : next_at + PIECE]
        if not piece:
            if not file.more():
                raise Tail("a gzip member isn't complete")
            continue
        out.append(d.decompress(piece))
        got += len(out[-1])
        next_at += len(piece)
        if d.eof:
            return b"".join(out), file.base + next_at - len(d.unused_data)
        if most is not None and got >= most:
            return b"".join(out)[:most], -1


def _first_member(file: _File, start: int, end: int) -> int | None:
    """Where the first member that starts in [start, end) does. The mark of a member may also stand in compressed data: only one that opens as a record counts."""
    at = start
    while at < end:
        while at - file.base + len(MAGIC) > len(file.data) and file.more():
            pass
        found = file.data.find(MAGIC, at - file.base)
        if found < 0:
            at = file.base + max(len(file.data) - len(MAGIC) + 1, at - file.base)
            if at >= end or not file.more():
                return None
            continue
        at = file.base + found
        if at >= end:
            return None
        try:
            if _member(file, at, 5)[0].startswith(b"WARC/"):
                return at
        except (zlib.error, Tail):
            pass
        at += 1
    return None


_START = re.compile(rb"(?:^|\n)WARC/\d+\.\d+\r?\n")


def _head_end(data: bytes, at: int) -> int:
    """Where a head ends that starts at ``at``; -1 if it doesn't."""
    found = re.compile(rb"\r?\n\r?\n").search(data, at, at + HEAD)
    return found.end() if found else -1


def headers(block: bytes) -> dict[str, str]:
    """Named fields of a head; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in re.split(r"\r?\n", block.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _plain_record(file: _File, at: int) -> tuple[dict[str, str], bytes, int]:
    """Head, block and end of the record at ``at`` of a plain file."""
    while (end := _head_end(file.data, at - file.base)) < 0:
        if len(file.data) - (at - file.base) > HEAD or not file.more():
            raise Tail("a record's head isn't complete")
    head = headers(file.data[at - file.base : end])
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Tail("a record has no length")
    while len(file.data) < end + int(length):
        if not file.more():
            raise Tail("a record isn't complete")
    return head, file.data[end : end + int(length)], file.base + end + int(length)


def _first_head(file: _File, start: int, end: int) -> int | None:
    """Where the first record head of a plain file that starts in [start, end) does, by its mark and fields."""
    at = start
    while at < end:
        found = _START.search(file.data, at - file.base)
        if found is None:
            at = max(at, file.base + len(file.data) - 16)
            if not file.more():
                return None
            continue
        at = file.base + found.end() - len(found[0].lstrip(b"\n"))
        if at >= end:
            return None
        while _head_end(file.data, at - file.base) < 0 and len(file.data) - (at - file.base) < HEAD and file.more():
            pass
        head = headers(file.data[at - file.base : max(_head_end(file.data, at - file.base), 0)])
        if "warc-type" in head and head.get("content-length", "").isdigit():
            return at
        at += 1
    return None


def records(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, head and block of the records of a file that start in [start, end). Raises Tail where what follows is none."""
    probe = _File(path, 0)
    probe.more()
    zipped = probe.data.startswith(MAGIC[:2])
    file = _File(path, max(start - 1, 0) if not zipped else start)  # a head stands at a line's beginning
    at = (start if start == 0 else _first_member(file, start, end)) if zipped else (0 if start == 0 else _first_head(file, start - 1, end))
    if not zipped and at is not None and at < start:
        at = _first_head(file, start, end)
    while at is not None and at < end:
        if zipped:
            while len(file.data) <= at - file.base and file.more():
                pass
            rest = file.data[at - file.base :]
            if not rest:
                return
            if rest[:1] == b"\0":  # padding between members
                at += len(rest) - len(rest.lstrip(b"\0"))
                continue
            try:
                content, after = _member(file, at)
            except zlib.error as e:
                raise Tail(f"a gzip member is damaged: {e}") from e
            inner = 0
            while (found := _START.search(content, inner)) is not None:
                top = found.end() - len(found[0].lstrip(b"\n"))
                stop = _head_end(content, top)
                head = headers(content[top:stop]) if stop > 0 else {}
                length = int(head.get("content-length", "-1")) if head.get("content-length", "").isdigit() else -1
                if length < 0 or stop + length > len(content):
                    raise Tail("a record isn't complete")
                yield at, head, content[stop : stop + length]
                inner = stop + length
            at = after
        else:
            while at - file.base >= len(file.data) and file.more():
                pass
            while (blank := file.data[at - file.base : at - file.base + 1]) in (b"\r", b"\n"):
                at += 1
                if at - file.base >= len(file.data):
                    file.more()
            if not blank:
                return
            if at >= end:
                return
            head, block, after = _plain_record(file, at)
            yield at, head, block
            at = after
        file.drop(at)


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], length: int):
        self.paths, self.length = paths, length
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and lists over the two columns that a record's heads tell."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("warc_type", "content_type"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Range]:
        from corpusloom.sources.open import size_of

        out = []
        for path in self.paths:
            size = size_of(path)
            out += [Range(path, a, min(a + self.length, size), size) for a in range(0, size, self.length)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[5] or b"")
            if len(rows) >= ROWS or held >= BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, part: Range) -> Iterator[tuple]:
        from corpusloom.sources.web import response

        types, kinds = self.wanted.get("warc_type"), self.wanted.get("content_type")
        try:
            for at, head, block in records(part.path, part.start, part.end):
                if types is not None and head.get("warc-type") not in types:
                    continue
                kind, charset, body, error = response(head, block, kinds)
                if kinds is None or kind in kinds:
                    yield head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), kind, charset, body, error, part.path, at
        except Tail as e:
            if types is None and kinds is None:
                yield None, None, None, None, None, None, f"malformed tail: {e}", part.path, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    fields = [f.strip().split(" ") for f in SCHEMA.split(",")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


class WarcSource(DataSource):
    """Options: path (a file, a folder or a glob), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        from corpusloom.sources.open import matching

        paths = matching(self.options["path"])
        if not paths:
            raise ValueError(f"no archives at {self.options['path']}")
        return WarcReader(paths, int(self.options.get("rangebytes", RANGE)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed down."""
    from corpusloom.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("rangeBytes", str(range_bytes)).load(path)
