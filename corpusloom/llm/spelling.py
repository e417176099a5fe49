"""Spelling variants: words one edit apart, by forward and reversed dictionaries.

Two words that differ by one code point, the shorter of length L, agree in the
first L div 2 code points or in the last L - L div 2: the edit leaves a half
intact. So every word is filed under its beginning (the sorted dictionary) and under
its end (the reversed one), each time as the shorter word of a pair and as the longer
one. Words of one block share their half, and the edit lies in the rest of them, a range of places.

Blocks with more than BLOCK_ROWS words are subdivided: of the range, again, a half is intact,
so each of their words goes into two smaller blocks, until these are small enough or
the range is one place. Blocks lie together in a partition, in order, and are
scanned by numpy in runs of blocks: words without the code point at one place of
the range meet where they are equal, and a longer word without one meets the shorter ones. What meets is
verified byte by byte. Words that meet at one place are all near each other, so
that their number and the two largest of them tell each word's answer: pairs are never made.

A pair belongs to the place where the two first differ, which lies in the range of exactly one block,
so that no pair counts twice.

Defined cases: a null or empty text has no words; rows with a null id count with
an empty id; repeated rows count each; an empty table gives an empty result; words
may be of any length; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, lower_ascii, ship
from corpusloom.llm.hashing import U, inverses, mix, powers

#: Letters of words, once A-Z are a-z. All of them are single bytes in ISO 8859-1.
RUN = r"[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a block that are left together, and their bytes.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 16 << 20
#: Bytes of words that are scanned at a time, or one block, and that are compared at a time.
SCAN_BYTES, SAME_BYTES = 2 << 20, 1 << 20
#: One in so many words of a document loses a code point.
SLIPS = 97


def slipped(doc: Column, word: Column, slips: int = SLIPS) -> Column:
    """The word, or where a checksum of document and word says so, the word without one code point."""
    h = F.crc32(F.encode(F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("")), word), "UTF-8"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(slips)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """word, n: the words of all texts, counted where they are read before they travel."""
    runs = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(RUN), F.lit(0))
    words = docs.select(F.col(doc).alias("doc"), F.explode(runs).alias("word"))
    if slips:
        words = words.filter(F.char_length("word") >= min_length).select(slipped(F.col("doc"), F.col("word"), slips).alias("word"))
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _block_key() -> list[Column]:
    """What words of one block share: the shorter length and the intact beginning and end, of ``a`` and ``b`` code points."""
    tail = F.when(F.col("b") > 0, F.substr("word", F.char_length("word") - F.col("b") + 1)).otherwise("")
    of = [F.col("short"), F.col("a"), F.col("b"), F.substr("word", F.lit(1), F.col("a")), tail]
    return [F.xxhash64(F.lit(seed), *of).alias(name) for seed, name in ((11, "k1"), (12, "k2"))]


def filed(words: DataFrame) -> DataFrame:
    """word, n, short, a, b and the block's key: every word under its beginning and its end, as the shorter and as the longer one."""
    short = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("short")
    half = F.floor(F.col("short") / 2).cast("int")
    ends = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (F.col("short") - half).alias("b")))
    rows = words.select("word", "n", short).withColumn("x", F.explode(ends)).select("word", "n", "short", "x.a", "x.b")
    return rows.select("*", *_block_key())


def subdivided(rows: DataFrame) -> DataFrame:
    """The rows, each in two blocks: the first or the second half of the range is intact."""
    half = F.floor((F.col("short") - F.col("a") - F.col("b")) / 2).cast("int")
    halves = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("short") - F.col("a") - half).alias("b")))
    return rows.withColumn("x", F.explode(halves)).select("word", "n", "short", "x.a", "x.b").select("*", *_block_key())


def blocks(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows as by ``filed``, of blocks with at least two words, none with more than ``block_rows`` unless its range is one place."""
    rows, done = filed(words), []
    while True:
        rows = cut(rows, "filed")
        sizes = cut(rows.groupBy("k1", "k2", "short", "a", "b").agg(F.count("*").alias("rows"), F.sum(F.char_length("word")).alias("bytes"), F.count(F.when(F.char_length("word") == F.col("short"), 1)).alias("shorter")).filter("rows > 1 and shorter > 0"), "sizes")
        large = ((F.col("rows") > block_rows) | ((F.col("bytes") > BLOCK_BYTES) & (F.col("rows") > 2))) & (F.col("short") - F.col("a") - F.col("b") > 1)
        key = sizes.select("k1", "k2", large.alias("large"))
        placed = cut(rows.join(key, ["k1", "k2"]), "placed")
        done.append(placed.filter("not large").drop("large"))
        if sizes.filter(large).isEmpty():
            break
        rows = subdivided(placed.filter("large").drop("large", "k1", "k2"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _spans(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _same(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from x and from y are equal, for each of them; read in bounded pieces."""
    out = np.ones(len(x), dtype=bool)
    ends = np.cumsum(length)
    start = 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SAME_BYTES, side="right")))
        n = length[start:stop]
        step = _spans(n)
        differ = data[np.repeat(x[start:stop], n) + step] != data[np.repeat(y[start:stop], n) + step]
        row = np.repeat(np.arange(stop - start), n)
        out[start:stop][row[differ]] = False
        start = stop
    return out


class _Near:
    """Of each row how many near words it has met, and the best of them: largest n, then first in order."""

    def __init__(self, n: np.ndarray, order: np.ndarray):
        self.rank = np.empty(len(n), dtype=np.int64)  # 0: the best of all rows
        self.rank[np.lexsort((order, -n))] = np.arange(len(n))
        self.count, self.best = np.zeros(len(n), dtype=np.int64), np.full(len(n), len(n), dtype=np.int64)
        self.by_rank = np.argsort(self.rank)

    def meet(self, row: np.ndarray, other: np.ndarray, number=1) -> None:
        np.add.at(self.count, row, number)
        np.minimum.at(self.best, row, self.rank[other])


def scan(words: list[bytes], n: np.ndarray, short: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of whole blocks: how many near words each has in its block, and the row of the best (or the number of rows)."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
    start = np.cumsum(size) - size
    order = np.empty(len(words), dtype=np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    near = _Near(n, order)
    # sums over each word alone, so that no block's hash hangs on what stands before it
    power, back = powers(int(size.max()) + 2), inverses(int(size.max()) + 2)
    at = _spans(size)
    value = (data[:-1].astype(U) + U(1)) * power[at]
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(value, dtype=U)])
    whole = sums[start + size] - sums[start]
    salt = mix(block.astype(U) + U(0x51ED270B))

    def without(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The hash of each row's word without the code point at ``place``."""
        before = sums[start[row] + place] - sums[start[row]]
        return before + (whole[row] - before - value[start[row] + place]) * back[1]

    is_short = size == short
    # one code point replaced: rows of the shorter length, at every place of the range
    rows = np.flatnonzero(is_short)
    places = np.maximum(short[rows] - a[rows] - b[rows], 0)
    row, place = np.repeat(rows, places), _spans(places) + np.repeat(a[rows], places)
    key = mix(without(row, place) + salt[row] + mix(place.astype(U)))
    _replaced(near, data, start, size, row, place, key)
    # one code point more: the longer rows, without each code point that is the last of its kind in a row, against the shorter ones
    rows = np.flatnonzero(~is_short)
    places = np.maximum(short[rows] - a[rows] - b[rows] + (b[rows] == 0), 0)
    row, place = np.repeat(rows, places), _spans(places) + np.repeat(a[rows], places)
    last = (place == size[row] - 1) | (data[start[row] + place] != data[start[row] + place + 1])
    row, place = row[last], place[last]
    _inserted(near, data, start, size, row, place, mix(without(row, place) + salt[row]), np.flatnonzero(is_short), mix(whole + salt))
    best = np.where(near.best < len(words), near.by_rank[np.minimum(near.best, len(words) - 1)], len(words))
    return near.count, best


def _replaced(near: _Near, data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
    by = np.argsort(key, kind="stable")
    row, place, key = row[by], place[by], key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    members = np.diff(np.append(first, len(key)))
    keep = members[group] > 1
    row, place, group = row[keep], place[keep], group[keep]
    if not len(row):
        return
    # the group's two best: each word's best near word is the first of them, or the second for the first itself
    by = np.lexsort((near.rank[row], group))
    row, place, group = row[by], place[by], group[by]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    members = np.diff(np.append(first, len(row)))
    head = np.repeat(first, members)
    h = row[head]
    good = (size[h] == size[row]) & _same(data, start[h], start[row], place) & _same(data, start[h] + place + 1, start[row] + place + 1, size[row] - place - 1)
    if not good.all():  # two hashes that met by chance: their groups are told apart by the words themselves
        bad = np.unique(group[~good])
        wrong = np.isin(group, bad)
        _one_by_one(near, data, start, size, row[wrong], place[wrong], group[wrong])
        row, group = row[~wrong], group[~wrong]
        if not len(row):
            return
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        members = np.diff(np.append(first, len(row)))
        head = np.repeat(first, members)
    second = np.repeat(first + 1, members)
    other = np.where(np.arange(len(row)) == head, row[second], row[head])
    near.meet(row, other, np.repeat(members - 1, members))


def _one_by_one(near: _Near, data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, place: np.ndarray, group: np.ndarray) -> None:
    groups: dict[tuple, list[int]] = {}
    for r, p, g in zip(row.tolist(), place.tolist(), group.tolist(), strict=True):
        word = data[start[r] : start[r] + size[r]].tobytes()
        groups.setdefault((g, p, word[:p], word[p + 1 :]), []).append(r)
    for rows in groups.values():
        if len(rows) > 1:
            first, second = sorted(rows, key=lambda r: near.rank[r])[:2]
            near.meet(np.array(rows), np.array([second if r == first else first for r in rows]), len(rows) - 1)


def _inserted(near: _Near, data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray, place: np.ndarray, key: np.ndarray, shorts: np.ndarray, whole: np.ndarray) -> None:
    if not len(row) or not len(shorts):
        return
    by = shorts[np.argsort(whole[shorts], kind="stable")]
    known = whole[by]
    low, high = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
    many = high - low
    pick = np.repeat(low, many) + _spans(many)  # words are distinct, so more than one is a chance meeting
    x, y, p = by[pick], np.repeat(row, many), np.repeat(place, many)
    good = (size[x] + 1 == size[y]) & _same(data, start[x], start[y], np.minimum(p, size[x])) & _same(data, start[x] + np.minimum(p, size[x]), start[y] + p + 1, np.maximum(size[y] - p - 1, 0))
    near.meet(x[good], y[good])
    near.meet(y[good], x[good])


def _scan_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of blocks: word, n, short, a, b, k1, k2."""

    def answer(rows: pa.Table) -> pa.RecordBatch:
        n, short, a, b, k1, k2 = (rows.column(c).to_numpy() for c in ("n", "short", "a", "b", "k1", "k2"))
        block = np.cumsum(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        words = rows.column("word").to_pylist()
        count, best = scan([w.encode("latin-1") for w in words], n, short.astype(np.int64), a.astype(np.int64), b.astype(np.int64), block)
        met = np.flatnonzero(count)
        return pa.record_batch([pa.array([words[i] for i in met], pa.string()), pa.array(count[met]), pa.array(n[best[met]]), pa.array([words[i] for i in best[met]], pa.string())], names=["word", "met", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(0).nbytes
        if size < SCAN_BYTES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
        edge = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        if len(edge):
            yield answer(rows.slice(0, edge[-1] + 1))
            rows = rows.slice(edge[-1] + 1).combine_chunks()
        held, size = rows.to_batches(), rows.column("word").nbytes
    if held and sum(map(len, held)):
        yield answer(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n_near, best_n, best: of every word of ``words`` (word, n) with a near one."""
    ship(words.sparkSession)
    rows = blocks(words, block_rows).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    met = rows.select("word", "n", "short", "a", "b", "k1", "k2").mapInArrow(_scan_blocks, "word string, met long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("met").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms (word, form) lead to, of words with a form, by doubling pointers.

    n at least doubles with every step, so that the way is short.
    """
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = cut(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, text: str = "text", doc: str = "doc_id", times: int = 2, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``form`` is the near word of largest n, if that is at least ``times`` the word's own; ``root`` what forms lead to.
    Other options are those of ``vocabulary``. Results don't depend on ``block_rows``.
    """
    words = cut(vocabulary(docs, text, doc, **options), "words")
    told = F.col("best_n") >= times * F.col("n")
    known = words.join(near_words(words, block_rows), "word", "left")
    near = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(told, F.col("best")).alias("form"), F.when(told, F.col("best_n")).alias("form_n")), "near")
    last = roots(near.filter("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
