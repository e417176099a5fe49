"""Token ids as binary shards.

A store is a folder of shard files and an index table. Documents lie in
ascending order of their ids, shard after shard. Each document's ids are a
frame of their own, compressed by zstandard with one dictionary that all frames
share, so that a short document is read by one seek and still shrinks well.

A shard file::

    8 bytes   magic "CLTOKEN1"
    32 bytes  SHA-256 of the dictionary
    frames    one for each document: its ids as little-endian unsigned 32-bit integers
    index     a Parquet table: doc, offset, n_bytes, n_tokens
    8 bytes   length of the index, little-endian
    8 bytes   magic again

The dictionary is trained on a bounded sample: the documents with the smallest
hashes, ``SAMPLE_DOCS`` of them, ``SAMPLE_CHARS`` characters of each, from a
place that a hash chooses. It only affects sizes; every document is encoded whole.

Defined cases: a null text counts as empty and has only the end id; null ids
come first; rows of one id are ordered by their texts' hashes; repeated rows
are each stored; an empty table gives a store without shards; other columns
don't enter the store.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import row_keys, ship
from corpusloom.llm.files import open_random, written_whole

MAGIC = b"CLTOKEN1"
HEAD = len(MAGIC) + 32
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 4000, 64 * 1024
LEVEL = 3
#: Bytes of word parts and their ids that a worker remembers; a full memory is emptied, and results don't depend on it.
REMEMBER = 150 << 20
#: What an entry takes besides the characters of its part; parts longer than LONG_PART aren't remembered.
ENTRY, LONG_PART = 170, 1000
CHUNK_CHARS = 1_000_000


def _of_kind(kind: str) -> str:
    """Latin-1 characters of a Unicode category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind)


#: How the tokenizer parts a text in lower case: letters, contractions, single digits, runs of other marks.
_PART = re.compile(rf"[{_of_kind('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('N')}]|[^\t-\r \x85\xa0{_of_kind('L')}{_of_kind('N')}]+")
#: Bytes as the characters that stand for them in byte-level vocabularies.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip(_PLAIN, _PLAIN, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


#: What a tokenizer file must say for its texts to be parted here.
_KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _parts_as_known(path: str) -> bool:
    """Whether a tokenizer file normalises and parts texts as this module does; others go through the whole tokenizer."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normalizer, splitter = said.get("normalizer") or {}, (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        normalizer.get("normalizers") == _KNOWN_NORMALIZER
        and len(splitter) == 2
        and splitter[0] == _KNOWN_SPLIT
        and _KNOWN_BYTES.items() <= splitter[1].items()
        and not said.get("post_processor")
        and all("<|" in t["content"] for t in said.get("added_tokens") or [])
    )


class WordMemory:
    """Ids of whole texts from remembered ids of their parts.

    The tokenizer parts a text before it encodes, and each part on its own. For
    texts of Latin-1 characters the parts are found here, and each distinct one is
    given to the tokenizer's model once. All other texts, and those that may hold special
    tokens, go through the whole tokenizer, and so do all texts where the file parts them
    in another way.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_part = _parts_as_known(path)
        self.remember, self.known, self.held = remember, {}, 0

    def _learn(self, parts: set[str]) -> None:
        tokenize, known = self.tokenizer.model.tokenize, self.known
        for p in parts:
            shown = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTES)
            known[p] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(shown)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        split, odd = [], []
        for i, t in enumerate(texts):
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                odd.append(i)
                split.append(())
                continue
            if not self.by_part or "<|" in t:
                odd.append(i)
                split.append(())
            else:
                split.append(_PART.findall(t.lower()))
        new = set().union(*split).difference(self.known)
        size = sum(map(len, new)) * 2 + len(new) * ENTRY
        if self.held + size > self.remember:
            self.known, self.held = {}, 0
            new = set().union(*split)
            size = sum(map(len, new)) * 2 + len(new) * ENTRY
        self._learn(new)
        self.held += size
        get = self.known.__getitem__
        out = [b"".join(map(get, parts)) for parts in split]
        for p in [p for p in new if len(p) > LONG_PART]:
            del self.known[p]
        if odd:
            run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for i, e in zip(odd, run([texts[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_memories: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    if path not in _memories:
        _memories[path] = WordMemory(path)
    return _memories[path]


def runs(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with some ``most`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary for the samples; too few of them serve as they are."""
    samples = [s for s in samples if len(s) > 8]
    if sum(map(len, samples)) > 20 * size and len(samples) >= 50:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    def __init__(self, out, dictionary: bytes, level: int = LEVEL):
        self.out, self.at, self.rows = out, HEAD, []
        self.press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        out.write(MAGIC + hashlib.sha256(dictionary).digest())

    def add(self, doc, ids: bytes) -> tuple[int, int, int]:
        frame = self.press.compress(ids)
        self.out.write(frame)
        row = (self.at, len(frame), len(ids) // 4)
        self.rows.append((doc, *row))
        self.at += len(frame)
        return row

    def close(self, kind: pa.DataType) -> None:
        names = ["doc", "offset", "n_bytes", "n_tokens"]
        columns = list(zip(*self.rows, strict=True)) or [[], [], [], []]
        index = pa.table([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)
        buffer = io.BytesIO()
        pq.write_table(index, buffer)
        self.out.write(buffer.getvalue() + struct.pack("<Q", buffer.tell()) + MAGIC)


class Shard:
    """A shard for reading: all documents in order, or one by its place."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = open_random(path)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(16, size - 16)
        if head[:8] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a whole token shard")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        (n,) = struct.unpack("<Q", tail[:8])
        self.index = pq.read_table(pa.BufferReader(self.file.read_at(n, size - 16 - n)))
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, offset: int, n_bytes: int) -> bytes:
        return self.press.decompress(self.file.read_at(n_bytes, offset))

    def document(self, place: int) -> np.ndarray:
        row = self.index.slice(place, 1).to_pylist()[0]
        return np.frombuffer(self.ids(row["offset"], row["n_bytes"]), dtype="<u4")

    def __iter__(self) -> Iterator[tuple[object, int, bytes]]:
        for batch in self.index.to_batches(max_chunksize=10_000):
            for doc, offset, n_bytes, n_tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield doc, n_tokens, self.ids(offset, n_bytes)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shards/shard-{shard:06d}.bin"


def write_store(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc: str = "doc_id", end_id: int = 2) -> bytes:
    """Encode every text and write the store; returns the dictionary.

    ``tokenizer`` is a file of the tokenizers library. The store has
    ``shards/``, ``index`` (Parquet: shard, place, doc, offset, n_bytes, n_tokens) and
    ``dictionary`` (Parquet, one row).
    """
    spark = docs.sparkSession
    ship(spark)
    k1, k2 = row_keys(doc, text)
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    dictionary = train_dictionary([b + struct.pack("<I", end_id) for b in memory(tokenizer).encode(_sample(rows))])
    kind = pa.schema([("doc", _arrow(rows.schema["doc"].dataType))]).field("doc").type
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType), *[T.StructField(n, T.LongType()) for n in ("offset", "n_bytes", "n_tokens")]])
    end = struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with written_whole(shard_path(folder, shard)) as out:
            writer, place = ShardWriter(out, dictionary), 0
            for batch in _chain(first, batches):
                names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in runs(texts):
                    got = [writer.add(n, ids + end) for n, ids in zip(names[a:b], memory(tokenizer).encode(texts[a:b]), strict=True)]
                    cols = zip(*got, strict=True)
                    yield pa.record_batch([pa.array([shard] * len(got), pa.int64()), pa.array(range(place, place + len(got)), pa.int64()), pa.array(names[a:b], kind), *[pa.array(c, pa.int64()) for c in cols]], names=schema.names)
                    place += len(got)
            writer.close(kind)

    placed = rows.repartitionByRange("doc", "k1", "k2").sortWithinPartitions("doc", "k1", "k2").select("doc", "text")
    placed.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{folder}/index")
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")
    return dictionary


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _chain(first, rest):
    yield first
    yield from rest


def _sample(rows: DataFrame) -> list[str]:
    keys = [r[0] for r in rows.select("k1").orderBy("k1").limit(SAMPLE_DOCS).collect()]
    if not keys:
        return []
    start = F.pmod(F.xxhash64(F.lit(3), "k2"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    cut = F.substr("text", (start + 1).cast("int"), F.lit(SAMPLE_CHARS))
    picked = rows.filter(F.col("k1") <= keys[-1]).select(cut.alias("text"), "k1").orderBy("k1").limit(SAMPLE_DOCS)
    return [r[0] for r in picked.collect()]


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document, from the shard files: doc, start, n_tokens, ids_crc32, dictionary_sha256, shard, place.

    ``start`` counts the ids of all documents before it in the store.
    """
    ship(spark)
    index = spark.read.parquet(f"{folder}/index")
    dictionary, digest = (lambda r: (bytes(r[0]), r[1]))(spark.read.parquet(f"{folder}/dictionary").first())
    totals = {r["shard"]: r["n"] for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each task that wrote
    starts, at = {}, 0
    for shard in sorted(totals):
        starts[shard], at = at, at + totals[shard]
    schema = T.StructType([T.StructField("doc", index.schema["doc"].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")], T.StructField("dictionary_sha256", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("place", T.LongType())])
    kind = _arrow(index.schema["doc"].dataType)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got, place = [], 0
                for doc, n, ids in Shard(shard_path(folder, shard), dictionary):
                    if n * 4 != len(ids):
                        raise ValueError(f"shard {shard}: a document of {n} tokens has {len(ids)} bytes")
                    got.append((doc, start, n, zlib.crc32(ids), digest, shard, place))
                    start, place = start + n, place + 1
                    if len(got) >= 10_000:
                        yield _batch(got, kind, schema.names)
                        got = []
                yield _batch(got, kind, schema.names)

    tasks = spark.createDataFrame(sorted(starts.items()), "shard long, start long")
    return tasks.repartition(max(1, len(starts)), "shard").mapInArrow(read, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
