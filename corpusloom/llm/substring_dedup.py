"""Removal of byte strings that an earlier document has: suffix-array dedup.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. What would be one suffix array over the corpus is
many small ones here, of only such text as can repeat:

1. Texts go to block files, some 16 MB each, which all later steps read.
2. Every window of LENGTH bytes has a key that depends on nothing but its bytes: the
   least hash of its K-byte strings. Neighbouring windows mostly share it. Keys
   found in one document only are dropped; whatever repeats keeps its keys.
3. A run of windows with one key that is left is a segment. Segments meet by key, equal ones
   of a block as one. So equal windows meet wherever they come from, and a
   passage that a third of all documents hold arrives once for each block.
4. There the distinct segments of keys with several get a Burrows-Wheeler transform.
   Intervals of suffixes are extended backwards, breadth first: the boundaries found at step
   n are those of common prefixes of n bytes, in increasing order. The search starts from
   a table of all strings of 21 bytes (7 or 14 in very large sets) and ends at LENGTH, where what no boundary parts is
   equal windows. Each such set has a smallest document, and so have the windows of a key's only segment.
5. Blocks get these back, mark their bytes and report.

Keys with very many blocks, such as those of set phrases, are divided further by a second hash
(``HOT_BLOCKS``), so that no task gets all of their surroundings.

Defined cases: a null text counts as empty; ids are integers, a null id counts
as larger than all others; rows of one id don't take from each other; repeated
rows are each reported; texts shorter than LENGTH stay whole; an empty table
gives an empty result; other columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, new_path, ship
from corpusloom.llm.files import open_random, written_whole
from corpusloom.llm.hashing import U, byte_runs, inverses, mix, powers

LENGTH = 50
K = 20
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 16
#: Bytes of distinct segments in one transform; a key's segments aren't parted.
TRANSFORM_BYTES = 300_000
#: A key in more blocks than this (32 GB of text or more) is divided by a second hash.
HOT_BLOCKS = 2000
#: Symbols of 9 bits (a byte or a separator) in the first sort key.
PACKED = 7
MISSING = np.iinfo(np.int64).max


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: their lengths, then their bytes."""
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    return _zstd()[0].compress(b"".join([sizes.tobytes(), *[a.tobytes() for a in arrays]]))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """Arrays of these kinds, as they were packed."""
    raw, at, out = _zstd()[1].decompress(data), 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(raw, np.int64, len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


# -- step 1: blocks


def _write_blocks(folder: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            whole = pa.Table.from_batches(held)
            with written_whole(f"{folder}/{name}") as out:
                pq.write_table(whole, out, compression="zstd", use_dictionary=False)
            return pa.record_batch([pa.array([name]), pa.array([size], pa.int64())], names=["block", "n_bytes"])

        held, size = [], 0
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            docs = batch.column(0).fill_null(MISSING)
            lengths = [len(x.as_buffer()) + 16 if x.is_valid else 16 for x in texts]
            for a, b in byte_runs(lengths, BLOCK_BYTES // 4):
                held.append(pa.record_batch([docs.slice(a, b - a), texts.slice(a, b - a)], names=["doc", "text"]))
                size += sum(lengths[a:b])
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return work


def _read_block(folder: str, name: str) -> tuple[np.ndarray, list[bytes]]:
    with open_random(f"{folder}/{name}") as f:
        t = pq.read_table(f)
    return t.column("doc").to_numpy(), t.column("text").to_pylist()


def _runs(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Runs of some CHUNK_BYTES of pieces, and of each piece its text's place and where it starts there.

    Long texts come in pieces that share LENGTH - 1 bytes, so that each window is in one of them.
    """
    pieces, row, at, size = [], [], [], 0
    for i, t in enumerate(texts):
        for p in range(0, max(1, len(t) - LENGTH + 1), CHUNK_BYTES):
            pieces.append(t if len(t) < CHUNK_BYTES + LENGTH else t[p : p + CHUNK_BYTES + LENGTH - 1])
            row.append(i)
            at.append(p)
            size += len(pieces[-1])
            if size >= CHUNK_BYTES:
                yield pieces, np.array(row), np.array(at)
                pieces, row, at, size = [], [], [], 0
    if pieces:
        yield pieces, np.array(row), np.array(at)


# -- steps 2 and 3: keys and segments


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``_hashes`` has the hash of any range."""
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data) + 1)[1:], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of segments."""
    return mix((sums[end] - sums[start]) * inverses(len(sums))[start] + (end - start - LENGTH + 1).astype(U) * U(0xFF51AFD7ED558CCD))


def _strings(sums: np.ndarray, k: int) -> np.ndarray:
    """A number for each string of k bytes; it orders them, and isn't mixed."""
    return (sums[k:] - sums[:-k]) * inverses(len(sums) - k)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: span - width], x[width - span :]) if span < width else x


class Segments:
    """Segments of a run of texts: of each its text (row), start, number of windows and key.

    ``base`` is the key before the division of those in ``hot``, which has numbers as ``least`` has them.
    """

    def __init__(self, texts: list[bytes], hot: np.ndarray | None = None, length: int = LENGTH, k: int = K):
        self.data = data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        if not (sizes >= length).any():
            self.row = self.start = self.n = np.zeros(0, np.int64)
            self.key = self.base = self.least = np.zeros(0, U)
            return
        self.sums = sums = _sums(data)
        least = key = _least(_strings(sums, k), length - k + 1)
        if hot is not None and len(hot):
            inside = np.isin(least, hot)
            if inside.any():
                second = _least(mix(_strings(sums, 24)), length - 24 + 1)
                key = np.where(inside, mix(least + second * U(0xD1342543DE82EF95)), least)
        new = np.empty(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[0] = True
        new[begin[:-1][sizes >= length]] = True
        first = np.flatnonzero(new)
        row = np.searchsorted(begin, first, side="right") - 1
        n = np.minimum(np.append(first[1:], len(key)), begin[row + 1] - length + 1) - first
        whole = n > 0  # windows over the end of a text are none
        self.row, self.start, self.n = row[whole], first[whole], n[whole]
        self.least = least[self.start]
        self.base = mix(self.least)
        self.key = self.base if key is least else mix(key[self.start])

    def hashes(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        start = self.start[i]
        return _hashes(self.sums, start, start + self.n[i] + LENGTH - 1) if len(start) else np.zeros(0, U)


def _scaled(key: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each key; it grows with the key."""
    return ((key >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _tag(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 40 further bits of a key. Two keys with one tag only cost time."""
    return _scaled(key, buckets), key & U((1 << 40) - 1)


def _tags_out(tag: np.ndarray, flag: np.ndarray) -> bytes:
    return (tag & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (tag >> U(32)).astype(np.uint8).tobytes() + np.packbits(flag).tobytes()


def _tags_in(n: list[int], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tags and flags of several rows, joined."""
    if not n:
        return np.zeros(0, U), np.zeros(0, bool)
    low = np.frombuffer(b"".join([d[: 4 * k] for k, d in zip(n, data, strict=True)]), np.uint32).astype(U)
    high = np.frombuffer(b"".join([d[4 * k : 5 * k] for k, d in zip(n, data, strict=True)]), np.uint8).astype(U)
    size = np.array(n, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join([d[5 * k :] for k, d in zip(n, data, strict=True)]), np.uint8))
    whole = (size + 7) // 8 * 8
    return low | high << U(32), bits[_ranges(np.cumsum(whole) - whole, size)].astype(bool)


def _keys(folder: str, buckets: int):
    """Of each block and bucket: its keys, and whether more than one of its documents has them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            docs, texts = _read_block(folder, name)
            keys, rows = [], []
            for pieces, of, _ in _runs(texts):
                s = Segments(pieces)
                keys.append(s.key)
                rows.append(of[s.row])
            key, row = np.concatenate(keys), np.concatenate(rows)
            if not len(key):
                continue
            order = np.argsort(key)
            key, doc = key[order], docs[row[order]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            bucket, tag = _tag(key[first], buckets)
            ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            data = [_tags_out(tag[a:b], several[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([pa.array(bucket[ends[:-1]]), pa.array([name] * len(data)), pa.array((ends[1:] - ends[:-1]).astype(np.int64)), pa.array(data, pa.binary())], names=["bucket", "block", "n", "data"])

    return work


def _back(order: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[order] = x
    return out


def _repeated(hot_blocks: int):
    """Of each bucket and block: the tags that occur in more than one document, and which of them are hot."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, block, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(bucket, []).append((block, n, data))
        for bucket, parts in held.items():
            tag, several = _tags_in([n for _, n, _ in parts], [d for _, _, d in parts])
            of = np.repeat(np.arange(len(parts)), [n for _, n, _ in parts])
            order = np.argsort(tag)
            t = tag[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            times = np.diff(np.append(first, len(t)))
            good = (times > 1) | (np.maximum.reduceat(several[order], first) > 0)
            good, hot = np.repeat(good, times), np.repeat(times > hot_blocks, times)
            good, hot = _back(order, good), _back(order, hot)
            pick = np.flatnonzero(good)
            hot, of_picked = hot[pick], of[pick]
            ends = np.searchsorted(of_picked, np.arange(len(parts) + 1))
            rows = [(bucket, parts[i][0], int(b - a), _tags_out(tag[pick[a:b]], hot[a:b])) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "n", "data"])

    return work


class _Known:
    """Sorted numbers in which others are looked up, first by their low bits."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.low = numbers, np.zeros(1 << 20, dtype=bool)
        self.low[self._low(numbers)] = True

    def _low(self, x: np.ndarray) -> np.ndarray:
        return (x & U(len(self.low) - 1)).view(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are known, and where."""
        i = np.flatnonzero(self.low[self._low(x)])
        if not len(i):
            return i, i
        at = np.minimum(np.searchsorted(self.numbers, x[i]), len(self.numbers) - 1)
        same = self.numbers[at] == x[i]
        return i[same], at[same]


class _Wanted:
    """Which keys of a block are repeated, and which of them hot."""

    def __init__(self, rows: list[dict], buckets: int):
        self.buckets = buckets
        tags, is_hot = _tags_in([r["n"] for r in rows], [r["data"] for r in rows])
        tags = tags | np.repeat(np.array([r["bucket"] for r in rows], dtype=U), [r["n"] for r in rows]) << U(40)
        self.tags, self.hot = _Known(np.sort(tags)), _Known(np.sort(tags[is_hot]))

    def find(self, key: np.ndarray, hot: bool = False) -> np.ndarray:
        """Which of the keys are repeated, or hot."""
        bucket, tag = _tag(key, self.buckets)
        return (self.hot if hot else self.tags).find(tag | bucket.astype(U) << U(40))[0]

    def segments(self, texts: list[bytes]) -> Segments:
        """Segments of the texts, hot keys divided."""
        s = Segments(texts)
        if len(self.hot.numbers) and len(hot := self.find(s.base, hot=True)):
            s = Segments(texts, np.unique(s.least[hot]))
        return s


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _send(folder: str, buckets: int, tasks: int):
    """Distinct wanted segments of each block, by key: task, block, n, data."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _block_rows(batches):
            wanted = _Wanted(rows, buckets)
            docs, texts = _read_block(folder, name)
            parts, base, content = [], 0, []
            for pieces, of, _ in _runs(texts):
                s = wanted.segments(pieces)
                i = wanted.find(s.base)
                if len(i):
                    parts.append((s.key[i], s.hashes(i), docs[of[s.row[i]]], s.start[i] + base, s.n[i] + LENGTH - 1))
                    content.append(s.data)
                    base += len(s.data)
            if not parts:
                continue
            key, hashed, doc, start, size = (np.concatenate(c) for c in zip(*parts, strict=True))
            data = np.concatenate(content)
            order = np.argsort(hashed)
            hashed, doc = hashed[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
            low, high, one = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), order[first]
            by = np.argsort(key[one])
            low, high, one = low[by], high[by], one[by]
            key, start, size = key[one], start[one], size[one]
            task = _scaled(key, tasks)
            ends = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            out = []
            for a, b in zip(ends, ends[1:], strict=False):
                flat = data[_ranges(start[a:b], size[a:b])]
                out.append((int(task[a]), name, int(b - a), _pack(key[a:b], low[a:b], low[a:b] != high[a:b], size[a:b].astype(np.uint32), flat)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["task", "block", "n", "data"])

    return work


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = size.astype(np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


# -- step 4: the transform


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of ``s`` in the order of their first ``depth`` symbols at least, and which start another string of as many symbols as is told, ``depth`` - 1 at most."""
    n = len(s)
    padded = np.concatenate([s.astype(U), np.zeros(PACKED, dtype=U)])
    key = np.zeros(n, dtype=U)
    for i in range(PACKED):
        key = key << U(9) | padded[i : i + n]
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    table, told, known = new, PACKED, PACKED
    while known < depth and not new.all():
        rank = np.cumsum(new).astype(U)
        bits = 21 if rank[-1] < 1 << 21 else 32
        rank = _back(order, rank)
        key = rank
        for i in range(1, 64 // bits):  # so many ranks in one key
            key = key << U(bits)
            key[: max(0, n - i * known)] |= rank[i * known :]
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        known *= 64 // bits
        if known < depth:
            table, told = new, known
    return order, table, told


def equal_windows(s: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``s``, and where in it sets of suffixes with a common prefix of ``length`` symbols start.

    Backward extension over the Burrows-Wheeler transform, all intervals of a
    length at once. An interval of suffixes with a common prefix w gives, for
    every symbol c before them, the interval of cw: from where c's first occurrence in it
    maps to, to where its last does. Its end is a boundary of common
    prefixes one longer. A boundary that is known already was found by a shorter
    one, and its interval isn't followed, so that each boundary is visited once.
    """
    order, table, told = suffix_order(s, length + 1)
    n = len(s)
    before = s[order - 1]  # position -1 is the separator at the end
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, dtype=np.int32)
    to[by_symbol] = np.arange(n, dtype=np.int32)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following, previous = np.full(n, n, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    boundary = np.append(table, True)  # prefixes shorter than those of the table
    edges = np.flatnonzero(boundary).astype(np.int32)
    low, high = edges[:-1], edges[1:]
    for _ in range(told + 1, length + 1):
        if not len(low):
            break
        size = high - low
        at = _ranges(low, size)
        last = np.sort(to[at[following[at] >= np.repeat(high, size)]])
        first = np.sort(to[at[previous[at] < np.repeat(low, size)]])
        high = last + 1
        fresh = ~boundary[high]
        low, high = first[fresh], high[fresh]
        boundary[high] = True
    return order, np.flatnonzero(boundary[:-1])


def smallest_owner(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every byte of segments that lie one after the other: the smallest document with the window that starts there.

    Places without a whole window have MISSING.
    """
    n = len(size)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    s = np.zeros(len(data) + n, dtype=np.uint16)
    place = np.arange(len(data)) + np.repeat(np.arange(n), size)
    s[place] = data.astype(np.uint16) + 1
    owner = np.full(len(s), MISSING)
    whole = np.arange(len(data)) - np.repeat(starts, size) <= np.repeat(size - length, size)
    owner[place[whole]] = np.repeat(doc, size)[whole]
    order, first = equal_windows(s, length)
    least = np.minimum.reduceat(owner[order], first)
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(s))))
    out[owner == MISSING] = MISSING
    return out[place]


def _answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block, of its segments with an earlier owner: hash, owners as runs."""
    names, parts = [], []
    for _, block, _, data in _block_rows(batches):
        key, low, several, size, flat = _unpack(data, U, np.int64, np.bool_, np.uint32, np.uint8)
        size = size.astype(np.int64)
        end = np.cumsum(size)
        parts.append((np.full(len(key), len(names)), key, low, several, size, _hashes(_sums(flat), end - size, end), flat))
        names.append(block)
    if not parts:
        return
    of, key, low, several, size, hashed, data = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    begin = np.cumsum(size) - size
    order = np.lexsort((hashed, key))
    k, h = key[order], hashed[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
    times = np.diff(np.append(first, len(order)))
    one = order[first]  # a row for each distinct segment
    size, hashed, begin, earliest = size[one], hashed[one], begin[one], np.minimum.reduceat(low[order], first)
    of_key = np.flatnonzero(np.concatenate([[True], k[first][1:] != k[first][:-1], [True]]))
    compared = np.flatnonzero(np.repeat(np.diff(of_key) > 1, np.diff(of_key)))  # no others have their key: nothing to tell apart
    floor, ceil = earliest.copy(), earliest.copy()
    kept, at = [], 0
    of_key = np.flatnonzero(np.concatenate([[True], np.diff(k[first[compared]]) != 0, [True]])) if len(compared) else np.zeros(1, np.int64)
    bytes_to = np.concatenate([[0], np.cumsum(size[compared])])
    while at < len(of_key) - 1:  # whole keys, up to the bytes of a transform
        to = int(np.searchsorted(bytes_to[of_key], bytes_to[of_key[at]] + TRANSFORM_BYTES, side="right")) - 1
        to = max(at + 1, to)
        rows = compared[of_key[at] : of_key[to]]
        least = smallest_owner(data[_ranges(begin[rows], size[rows])], size[rows], earliest[rows])
        windows = size[rows] - LENGTH + 1
        least = least[_ranges(np.cumsum(size[rows]) - size[rows], windows)]
        starts = np.cumsum(windows) - windows
        floor[rows], ceil[rows] = np.minimum.reduceat(least, starts), np.maximum.reduceat(least, starts)
        uneven = np.flatnonzero(floor[rows] < ceil[rows])
        kept.append(least[_ranges(starts[uneven], windows[uneven])])
        at = to
    windows = np.where(floor < ceil, size - LENGTH + 1, 0)
    starts, owners = np.cumsum(windows) - windows, np.concatenate([*kept, np.zeros(0, np.int64)])
    which = np.repeat(np.arange(len(one)), times)
    need = several[order] | (floor[which] < low[order])
    rows, which = order[need], which[need]
    by = np.argsort(of[rows], kind="stable")
    rows, which = rows[by], which[by]
    ends = np.searchsorted(of[rows], np.arange(len(names) + 1))
    for name, a, b in zip(names, ends, ends[1:], strict=False):
        if b > a:
            w = which[a:b]
            even = windows[w] == 0
            u, w = w[~even], w[even]
            found = _pack(hashed[w], floor[w], hashed[u], windows[u], owners[_ranges(starts[u], windows[u])])
            yield pa.record_batch([pa.array([name]), pa.array([found], pa.binary())], names=["block", "data"])


# -- step 5: the report


def _report(folder: str, buckets: int, with_text: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows, answers in _block_rows(batches):
            wanted = _Wanted(rows or [], buckets)
            docs, texts = _read_block(folder, name)
            got = [_unpack(x, U, np.int64, U, np.int64, np.int64) for x in answers or []]
            none = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            plain, owner, mixed, windows, owners = (np.concatenate(c) for c in zip(*(got or none), strict=True))
            hashed, begin = np.concatenate([plain, mixed]), np.cumsum(windows) - windows
            owner, begin = np.append(owner, np.zeros(len(mixed), np.int64)), np.append(np.full(len(plain), -1), begin)
            order = np.argsort(hashed)
            known = _Owners(_Known(hashed[order]), owner[order], begin[order], owners)
            long: list = []  # what goes of a text that comes in pieces
            for pieces, of, at in _runs(texts):
                row, start, end = _gone(pieces, docs[of], wanted, known)
                size = np.array([len(x) for x in pieces])
                shift = (at - np.cumsum(size) + size)[row]
                start, end = start + shift, end + shift  # in the texts
                ends = np.searchsorted(row, np.arange(len(pieces) + 1)).tolist()
                whole = []
                for j, (i, p) in enumerate(zip(of.tolist(), at.tolist(), strict=True)):
                    runs, n = (start[ends[j] : ends[j + 1]], end[ends[j] : ends[j + 1]]), len(texts[i])
                    if len(pieces[j]) < n:
                        long = [*long, runs] if p else [runs]
                        if p + len(pieces[j]) < n:
                            continue
                        start_of, end_of = (np.concatenate(c) for c in zip(*long, strict=True))
                        runs = _joined(np.zeros(len(start_of), np.int64), start_of, end_of)[1:]
                    whole.append((docs[i], texts[i], *runs))
                if whole:
                    yield _figures(whole, with_text)

    return work


class _Owners(NamedTuple):
    """Sorted hashes of segments, and their owners: one (where begin is -1), or from ``begin`` on in ``owners``."""

    hashed: _Known
    owner: np.ndarray
    begin: np.ndarray
    owners: np.ndarray


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs that some ranges cover, by row; rows lie one after the other."""
    if not len(row):
        return row, start, end
    order = np.argsort(start, kind="stable")
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], (start[1:] > reach[:-1]) | (row[1:] != row[:-1]), [True]])
    first = np.flatnonzero(new)
    return row[first[:-1]], start[first[:-1]], reach[first[1:] - 1]


def _gone(texts: list[bytes], docs: np.ndarray, wanted: _Wanted, known: _Owners) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that go: their texts, and where they start and end in the joined texts."""
    s = wanted.segments(texts)
    i, at = known.hashed.find(s.hashes())
    doc, even = docs[s.row[i]], known.begin[at] < 0
    hit = i[even & (known.owner[at] < doc)]
    i, at, doc = i[~even], at[~even], doc[~even]
    earlier = known.owners[_ranges(known.begin[at], s.n[i])] < np.repeat(doc, s.n[i])
    window, row = _ranges(s.start[i], s.n[i])[earlier], np.repeat(s.row[i], s.n[i])[earlier]
    start = np.concatenate([s.start[hit], window])
    end = np.concatenate([s.start[hit] + s.n[hit] + LENGTH - 1, window + LENGTH])
    return _joined(np.concatenate([s.row[hit], row]), start, end)


def _figures(whole: list[tuple[int, bytes, np.ndarray, np.ndarray]], with_text: bool) -> pa.RecordBatch:
    rows = []
    for doc, text, start, end in whole:
        kept, removed = text, 0
        if len(start):
            removed = int((end - start).sum())
            kept = b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)])
        rows.append((None if doc == MISSING else int(doc), len(text), removed, len(start), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, text: str = "text", doc: str = "doc_id", with_text: bool = True, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Of every row: doc, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept, the remaining bytes.

    ``kept`` is binary, for a removed run may begin or end within a character.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = new_path(spark, "blocks")
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    blocks = cut(rows.mapInArrow(_write_blocks(folder), "block string, n_bytes long"), "block-index")
    n_blocks, n_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = min(max(1, n_blocks), 10_000)
    tasks = max(shuffle, n_bytes // (64 << 20))
    buckets = 4 * tasks
    keys = blocks.select("block").repartition(spread).mapInArrow(_keys(folder, buckets), "bucket long, block string, n long, data binary")
    repeated = cut(keys.repartition(tasks, "bucket").mapInArrow(_repeated(hot_blocks), "bucket long, block string, n long, data binary"), "repeated")
    n_repeated = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    transforms = max(shuffle, n_repeated * 70 // (12 << 20))
    per_block = repeated.repartition(spread, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "data")).alias("rows"))
    sent = per_block.mapInArrow(_send(folder, buckets, transforms), "task long, block string, n long, data binary")
    answers = sent.repartitionById(transforms, F.col("task").cast("int")).mapInArrow(_answer, "block string, data binary")
    per_block_answers = answers.repartition(spread, "block").groupBy("block").agg(F.collect_list("data").alias("answers"))
    work = blocks.select("block").repartition(spread, "block").join(per_block, "block", "left").join(per_block_answers, "block", "left").select("block", "rows", "answers")
    out = work.mapInArrow(_report(folder, buckets, with_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
