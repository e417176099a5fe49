"""Near-duplicate groups by SuperMinHash, banding, verification and union.

Signatures: each shingle's hash seeds a random permutation of the signature's
places, and the shingle's rank there is its value. So the values at one level
of all permutations go to different places, which makes the estimate less scattered than
independent hashes do, and a document whose places are all taken needs no
further level: most stop after two or three.

Documents with equal shingle sets are one node from then on, whatever their
number. Nodes that share a band of their signatures are candidates. A bucket isn't
turned into pairs of all its members: each member is compared with one centre,
on full sets, and whatever the links join is one component. Buckets whose
members then lie in one component are done. What the others hold is divided
further, by conditions that every link meets, until what is left is done too:

- By size. Linked sets differ in size by a quarter at most, and share no more
  than each of them has of shingles that others have too. Each member joins the
  cells (bucket, its size class, a partner's size class) in which it can have a link.
- By rare shingles. Two linked sets share one of their rarest shingles, of
  as many as the overlap leaves to spare: if they share none of these, too few
  are left. Members meet by (shingle, two size classes).

Groups of one component need no more comparisons. In the others, members outside of the
largest component are compared with those that the places of the shared shingle allow;
where they are many, EACH of them at a time, and what is then still apart goes
through the same again. No step emits more rows than a multiple of its input, and nothing
is capped.

A link of similarity 0.75 shares no band with probability (1 - 0.75 ** ROWS) ** BANDS,
5 in a million; of 0.8, 5 in a hundred million.

Defined cases: a null or empty text, or one of white space, has no shingles and
is linked with nothing; rows with a null id likewise, and they stay; rows that
share an id are one node, whose texts all count; repeated rows get one answer each; an
empty table gives an empty result; extra columns pass through ``dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, fresh, scratch, ship, spread_join
from corpusloom.llm.hashing import U, byte_runs, mix, shingle_sets

ROWS, BANDS = 4, 32
PLACES = ROWS * BANDS
SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Ids that are broadcast to pick documents; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Members that all others of their group are compared with at a time.
EACH = 64


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A row for each set: the least (level, value) of each place, as one number. Empty sets keep the largest."""
    full = np.iinfo(U).max
    out = np.full((len(sets), places), full, dtype=U)
    if not sets or not any(map(len, sets)):
        return out
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    x = mix(h + U(0x9E3779B97F4A7C15))
    at = ((x >> U(32)) * U(places) >> U(32)).astype(np.int64)
    np.minimum.at(flat, row * places + at, x & U(0xFFFFFFFF))
    left = np.flatnonzero((out == full).any(axis=1) & (sizes > 0))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in byte_runs(sizes[left].tolist(), 100_000):
        _further_levels(flat, h, at, [(r, ends[r], ends[r + 1]) for r in left[a:b].tolist()], places)
    return out


def _further_levels(flat: np.ndarray, h: np.ndarray, first: np.ndarray, rows: list[tuple[int, int, int]], places: int) -> None:
    """Levels from 1 of the rows whose places aren't all taken, until they are."""
    full = np.iinfo(U).max
    pick = np.concatenate([np.arange(a, b) for _, a, b in rows])
    row = np.concatenate([np.full(b - a, r) for r, a, b in rows])
    h, first, each = h[pick], first[pick], np.arange(len(pick))
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(pick), 1))
    order[each, first], order[each, 0] = 0, first  # the swap of level 0
    for level in range(1, places):
        open_rows = np.unique(row)
        open_rows = open_rows[(flat.reshape(-1, places)[open_rows] == full).any(axis=1)]
        if not len(open_rows):
            return
        keep = np.isin(row, open_rows)
        if not keep.all():
            h, row, order = h[keep], row[keep], order[keep]
            each = np.arange(len(h))
        x = mix(h + U(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
        swap = level + ((x >> U(32)) * U(places - level) >> U(32)).astype(np.int64)
        at = order[each, swap].astype(np.int64)
        order[each, swap] = order[:, level]
        order[:, level] = at
        np.minimum.at(flat, row * places + at, (x & U(0xFFFFFFFF)) | U(level << 32))


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Of each signature a hash for each of its bands, different from band to band."""
    n, places = signature.shape
    bands = signature.reshape(n, places // rows, rows)
    key = np.arange(1, places // rows + 1, dtype=U)[None, :] * U(0xC2B2AE3D27D4EB4F)
    for k in range(rows):
        key = mix(key + bands[:, :, k] * U(0x9FB21C651E98DF25))
    return key


def _set_hash(s: np.ndarray, seed: int) -> int:
    return int(mix(s ^ U(seed)).sum(dtype=U)) if len(s) else 0


_SIGNED = "doc long, n long, s1 long, s2 long, bands array<long>"


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    raw = batch.column(column).cast(pa.binary()).to_pylist()
    raw = [x or b"" for x in raw]
    for a, b in byte_runs([len(x) + 1 for x in raw]):
        yield a, raw[a:b]


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in _texts(batch, 1):
            sets = list(shingle_sets(texts, SHINGLE))
            keys = band_keys(signatures(sets)).view(np.int64)
            n = np.array([len(s) for s in sets])
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1)))
            hashes = [np.array([_set_hash(s, seed) for s in sets], dtype=U).view(np.int64) for seed in (0x1234567, 0xABCDEF987)]
            yield pa.record_batch([batch.column(0).slice(a, len(texts)), pa.array(n), *map(pa.array, hashes), bands], names=["doc", "n", "s1", "s2", "bands"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in _texts(batch, 1):
            sets = list(shingle_sets(texts, SHINGLE))
            yield pa.record_batch([batch.column(0).slice(a, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "items"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair, the size of the intersection and of the union."""
    for batch in batches:
        both, last = [], (None, None)
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.as_buffer(), y.as_buffer()
            a = last[1] if last[0] is not None and x.equals(last[0]) else np.frombuffer(x, dtype=U)
            last = (x, a)
            b = np.frombuffer(y, dtype=U)
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(long, short)
            at[at == len(long)] = 0
            n = int((long[at] == short).sum())
            both.append((n, len(a) + len(b) - n))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([n for n, _ in both], pa.int64()), pa.array([m for _, m in both], pa.int64())], names=["a", "b", "both", "all"])


def verify(pairs: DataFrame, sets: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Pairs a, b with the exact sizes of intersection and union of their sets: a, b, both, all.

    A centre with very many partners has them dealt over several tasks.
    """
    pairs = cut(pairs, "pairs")
    small = F.broadcast if pairs.count() <= max_broadcast else lambda df: df
    centres = cut(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")).join(small(pairs.groupBy("a").agg(F.count("*").alias("rows"))), "a"), "centres")
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("y")).join(small(pairs), "b")
    rows = spread_join(right, centres, ["a"], "rows").select("a", "b", "x", "y")
    return cut(rows.mapInArrow(_compare, "a long, b long, both long, all long"), "compared")


def links(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("both") * 100 >= F.col("all") * PERCENT).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, of every node with an edge.

    Each round, a node takes the smallest label among its neighbours', then its
    label's label. Labels meet in few rounds, as links mostly are stars. A node
    with very many neighbours, or followers, has them dealt over several tasks.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("rows")), "labels")
    while True:
        heard = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], "rows").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = cut(labels.join(heard, "node").select("node", F.least("label", "heard").alias("next"), F.col("label").alias("old"), "rows"), "steps")
        moved = step.filter(F.col("node") != F.col("next")).select(F.col("node").alias("next"), F.col("next").alias("above"))
        up = cut(step.groupBy("next").agg(F.count("*").alias("followers")).join(moved, "next"), "above")
        labels = cut(spread_join(step, up, ["next"], "followers", "left").select("node", F.coalesce("above", "next").alias("label"), "rows", "old"), "labels")
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")


def _pick(docs: DataFrame, ids: DataFrame, max_broadcast: int) -> DataFrame:
    """Rows of ``docs`` (doc, text) with an id among ``ids`` (doc)."""
    few = ids.limit(max_broadcast + 1).count() <= max_broadcast
    return docs.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def _of_mixed(rows: DataFrame, on: list[str], sides: bool = False) -> DataFrame:
    """The rows (with doc, label) of groups that hold more than one component and, with ``sides``, members for either side."""
    which = [F.max("low").alias("_low"), F.max("high").alias("_high")] if sides else []
    groups = rows.groupBy(*on).agg(F.min("label").alias("_first"), F.max("label").alias("_last"), F.count("*").alias("_rows"), *which).filter("_first < _last")
    if sides:
        groups = groups.filter("_low and _high")
    return spread_join(rows, cut(groups.select(*on, "_rows"), "mixed"), on, "_rows").drop("_rows")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's centre, its smallest id, with those of its other members that aren't too large or too small for a link: a, b."""
    n, m = F.col("n"), F.col("centre.n")
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return buckets.filter((F.col("doc") != F.col("centre.doc")) & fits).select(F.col("centre.doc").alias("a"), F.col("doc").alias("b")).distinct()


def _explode_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, items in zip(batch.column(0), batch.column(1), strict=True):
            values = np.frombuffer(items.as_buffer(), dtype=np.int64)
            for at in range(0, len(values), 1 << 20):
                part = values[at : at + (1 << 20)]
                yield pa.record_batch([pa.array(np.full(len(part), doc.as_py())), pa.array(part)], names=["doc", "item"])


def _shared_items(members: DataFrame, sets: DataFrame) -> DataFrame:
    """doc, item, found: the shingles of members that some other member has too, and how many have each."""
    rows = sets.join(members.select("doc").distinct(), "doc", "left_semi").mapInArrow(_explode_sets, "doc long, item long")
    known = cut(rows.groupBy("item").agg(F.count("*").alias("found")).filter("found > 1"), "known")
    return cut(spread_join(rows, known, ["item"], "found"), "shared")


#: How wide size classes are, for cells of buckets and for those of shingles; small sizes are classes of their own.
WIDE, NARROW = 20, 100


def _size_class(n: Column, width: int) -> Column:
    """Classes are 1 / width of the size wide."""
    larger = width + F.floor(F.log(n / width) / math.log(1 + 1 / width) + 1e-9)
    return F.when(n < width, n).otherwise(larger).cast("int")


def _class_start(size_class: Column, width: int) -> Column:
    """No set of the class is smaller."""
    larger = F.floor(F.exp((size_class - width) * math.log(1 + 1 / width)) * width)
    return F.when(size_class < width, size_class).otherwise(larger).cast("long")


def _smallest_partner(n: Column) -> Column:
    return F.greatest(F.ceil(n * PERCENT / 100 - 1e-9), F.lit(1))


def _cells(members: DataFrame, shared: Column) -> DataFrame:
    """A row for each member and size class in which it may have a partner, if ``shared`` of its shingles are found elsewhere."""
    n, most = F.col("n"), F.least(F.col("n") * 100 / PERCENT, shared * (100 + PERCENT) / PERCENT - F.col("n"))
    able = members.filter(shared * 100 >= n * PERCENT)
    bottom, top = _size_class(_smallest_partner(n), WIDE), _size_class(F.greatest(F.floor(most), F.lit(1)), WIDE)
    return able.withColumn("own", _size_class(n, WIDE)).withColumn("other", F.explode(F.sequence(bottom, F.greatest(top, bottom)))).select(*members.columns, "other", *_sides())


def _sides() -> list[Column]:
    own, other = F.col("own"), F.col("other")
    return [F.least(own, other).alias("c1"), F.greatest(own, other).alias("c2"), (own <= other).alias("low"), (own >= other).alias("high")]


def _prefixes(wanted: DataFrame, shared: DataFrame) -> DataFrame:
    """item, c1, c2 and members: the rarest shingles of which linked sets share one.

    ``wanted`` has, of each doc, n, n_shared, label and the size classes in which it needs partners (other).
    """
    n = F.col("n")
    fine = F.sequence(_size_class(_class_start(F.col("other"), WIDE), NARROW), _size_class(_class_start(F.col("other") + 1, WIDE), NARROW))
    pick = wanted.withColumn("other", F.explode(fine)).groupBy("doc", "n", "n_shared", "label").agg(F.collect_set("other").alias("others"), F.min("other").alias("least"))  # 60 classes at most
    order = Window.partitionBy("doc", "n").orderBy("found", "item")
    least = lambda other: F.greatest(_class_start(other, NARROW), _smallest_partner(n))
    spare = lambda other: (n - F.col("place")) * (100 + PERCENT) >= (n + least(other)) * PERCENT
    rows = shared.join(pick, "doc").withColumn("place", n - F.col("n_shared") + F.row_number().over(order) - 1).filter(spare(F.col("least")))
    rows = rows.withColumn("other", F.explode("others")).filter(spare(F.col("other"))).withColumn("own", _size_class(n, NARROW))
    return rows.select("item", "doc", "n", "label", "place", *_sides())


_GROUP, _MEMBER = ["item", "c1", "c2"], ["doc", "n", "label", "place", "low", "high"]


def _allowed(low: str, high: str) -> Column:
    """Whether the places of a shared shingle leave enough of both sets for a link."""
    need = (F.col(f"{low}.n") + F.col(f"{high}.n")) * PERCENT
    return ((F.col(f"{low}.n") - F.col(f"{low}.place")) * (100 + PERCENT) >= need) & ((F.col(f"{high}.n") - F.col(f"{high}.place")) * (100 + PERCENT) >= need)


def _groups(rows: DataFrame) -> DataFrame:
    """Of each group: how many rows it has (m), the largest component (main) and its rows (k)."""
    by_label = rows.groupBy(*_GROUP, "label").agg(F.count("*").alias("k"))
    return cut(by_label.groupBy(*_GROUP).agg(F.sum("k").alias("m"), F.max("k").alias("k"), F.max_by("label", F.struct("k", "label")).alias("main")), "groups")


def _settle(rows: DataFrame, compared: DataFrame, sets: DataFrame, relabel, each: int) -> None:
    """Compare what may still be linked in the groups of rare shingles.

    Of each pair at least one is outside of the group's largest component. Some ``each`` of those
    a group are compared with all its members and leave it, until it has one component.
    ``relabel`` takes further comparisons and gives back the labels of all nodes.
    """
    rows, turn = cut(_of_mixed(rows, _GROUP, sides=True), "prefixes"), 0
    while not rows.isEmpty():
        groups, member = _groups(rows), F.struct(*_MEMBER)
        chosen = (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil((F.col("m") - F.col("k")) / each)) == 0)
        placed = cut(spread_join(rows, groups, _GROUP, "m").withColumn("chosen", chosen), "placed")
        x, y = placed.select(*_GROUP, member.alias("x")), placed.filter("chosen").select(*_GROUP, member.alias("y"))
        pairs = spread_join(x, y, _GROUP, "m", counts=groups).filter((F.col("x.label") != F.col("y.label")) & ((F.col("x.low") & F.col("y.high")) | (F.col("x.high") & F.col("y.low"))) & _allowed("x", "y"))
        pairs = pairs.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
        labels = relabel(verify(pairs.join(compared, ["a", "b"], "left_anti"), sets))
        left = placed.filter(F.col("m") - F.col("k") > each).filter("not chosen").drop("label")
        left = left.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        rows, turn = cut(_of_mixed(left.select(*_GROUP, *_MEMBER), _GROUP, sides=True), "prefixes"), turn + 1


def groups(docs: DataFrame, text: str = "text", doc: str = "doc_id", max_broadcast: int = MAX_BROADCAST, each: int = EACH) -> DataFrame:
    """Of every row: doc, n_shingles, component_id and kept.

    ``component_id`` is the smallest id that links lead to. Ids are integers.
    Results don't depend on ``max_broadcast`` and ``each``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(_sign, _SIGNED), "signed")
    full = signed.filter("n > 0 and doc is not null")
    nodes = cut(full.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.count("*").alias("rows")), "nodes")
    with scratch(docs.sparkSession):
        labels = cut(_labels(rows, full, nodes, max_broadcast, each), "labels", inner=False)
    named = cut(nodes.select("s1", "s2", "node", "rows").join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("component"), "rows"), "components")
    known = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc"))
    out = _of_sets(signed, named).select("doc", F.col("n").alias("n_shingles"), known.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))


def _labels(rows: DataFrame, full: DataFrame, nodes: DataFrame, max_broadcast: int, each: int) -> DataFrame:
    """node, label: the component of every node with a link."""
    every = nodes.select(F.explode("bands").alias("key"), F.col("node").alias("doc"), "n")
    shared = every.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("centre"), F.count("*").alias("rows")).filter("rows > 1")
    buckets = cut(spread_join(every, cut(shared, "keys"), ["key"], "rows").drop("rows"), "buckets")
    sets = cut(_pick(rows, buckets.select("doc").distinct(), max_broadcast).mapInArrow(_sets, "doc long, items binary"), "sets")
    compared = [verify(_stars(buckets), sets, max_broadcast)]
    same_id = _of_sets(full, nodes.select("s1", "s2", "node", "rows")).select(F.col("doc").alias("a"), F.col("node").alias("b")).filter("a != b")
    repeated = full.groupBy("doc").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).filter("x != y").select(F.col("doc").alias("a"))
    extra = cut(same_id.join(repeated, "a", "left_semi"), "extra")  # an id with several texts joins their nodes
    found: list[DataFrame] = []

    def relabel(more: DataFrame | None = None) -> DataFrame:
        if more is not None:
            compared.append(more)
        if more is None or not links(more).isEmpty():
            found.append(components(reduce(DataFrame.unionByName, map(links, compared), extra)))
        return found[-1]

    named = buckets.join(relabel().withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("label", "doc").alias("label"))
    members = cut(_of_mixed(named, ["key"]), "unresolved")
    if not members.isEmpty():
        cell = ["key", "c1", "c2"]
        members = cut(_of_mixed(_cells(members, F.col("n")), cell, sides=True).select("key", "doc", "n", "label").distinct(), "unresolved")
        shared = _shared_items(members, sets)
        figures = members.join(shared.groupBy("doc").agg(F.count("*").alias("n_shared")), "doc")
        wanted = cut(_of_mixed(_cells(figures, F.col("n_shared")), cell, sides=True).select("doc", "other", "n", "n_shared", "label").distinct(), "cells")
        _settle(_prefixes(wanted, shared), compared[0], sets, relabel, each)
    return found[-1]


def _of_sets(signed: DataFrame, told: DataFrame) -> DataFrame:
    """Rows with what is told of their set (by s1, s2; rows counts those that have it); a third of all rows may have one set, or none."""
    s1 = F.when(F.col("n") > 0, F.col("s1")).otherwise(F.xxhash64("doc")).alias("s1")
    return spread_join(signed.select("doc", "n", s1, "s2"), told, ["s1", "s2"], "rows", "left").drop("rows")


def dedup(docs: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the near duplicates of documents with smaller ids; columns stay as they are."""
    (gone,) = fresh(docs, "gone")
    dropped = groups(docs, text, doc, **options).filter("not kept").select(F.col("doc").alias(gone)).distinct()
    return docs.join(dropped, docs[doc].cast("long") == dropped[gone], "left_anti")
