"""Ranked lexical search as a blocked sparse matrix product.

Item-term multiplicities (a row for each item) are multiplied with term-document
impacts, which are 64-bit integers. Documents come in blocks. A block's postings are
put in order of terms; each item's row is then the sum of the posting rows of its
terms (Gustavson's row merging, with a dense accumulator of one block). A task keeps
the best documents of each item over all its blocks and emits these only, and the
best of all tasks are what is left.

Texts are tokenised once for each group of items: of a document, its number of terms and the
frequencies of those terms that some item asks for are kept. Items go in groups of at most
MAX_ITEMS rows and about MAX_BYTES bytes of text, so that what travels to the tasks is bounded; every group
meets all documents.

Defined cases: a null or empty text has no term, counts for nothing and is never
ranked; an item without terms, or whose terms no document has, gets no rows;
rows with a null id are ranked, after others of equal score; repeated documents
are ranked each for itself, and so are repeated items; an empty table gives
an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, ship
from corpusloom.llm.hashing import byte_runs

#: What stands between terms, once A-Z are a-z.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DEPTH = 20
#: Items that are scored together, and bytes of their texts.
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20
#: Documents of one block of the product.
BLOCK = 8192
#: The part of a document's length in its impact, of 100.
SLOPE = 25


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of all texts, in order, and to which text each of them belongs. Terms may be empty at a text's ends."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), NOT_TERM)
    return pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)


def _counts(words: pa.Array) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document: doc, n (terms) and the numbers and frequencies of those of ``words`` that it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            for a, b in byte_runs(pc.binary_length(texts).to_pylist(), 4 << 20):
                of, terms = _terms(texts.slice(a, b - a))
                real = pc.binary_length(terms).to_numpy() > 0
                n = np.bincount(of[real], minlength=b - a)
                at = pc.fill_null(pc.index_in(terms, value_set=words), -1).to_numpy().astype(np.int64)
                hit = real & (at >= 0)
                pair, tf = np.unique(of[hit].astype(np.int64) * len(words) + at[hit], return_counts=True)
                ends = np.searchsorted(pair, np.arange(b - a + 1) * len(words)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(len(words), 1), tf)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n), *lists], names=["doc", "n", "terms", "tfs"])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """weight * ((1000000000 * tf) div (1000 * tf + 12 * m)), m by the document's length n against the mean."""
    fits = int(n.max(initial=0)) * SLOPE * documents < 2**63
    share = n * SLOPE * documents // length if fits else np.array([int(x) * SLOPE * documents // length for x in n], dtype=np.int64)
    m = 100 - SLOPE + share
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class _Best:
    """The best documents of each item so far, by score and then id; a null id comes last."""

    def __init__(self, items: int, depth: int):
        self.depth = depth
        self.score = np.zeros((items, depth), dtype=np.int64)  # 0: no document
        self.doc = np.zeros((items, depth), dtype=np.int64)
        self.null = np.ones((items, depth), dtype=bool)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        at = np.flatnonzero(score > max(0, self.score[item, -1] - 1))  # equals of the last count: their ids may be smaller
        if len(at) > self.depth:
            at = at[score[at] >= np.partition(score[at], -self.depth)[-self.depth]]
        if len(at):
            s, d, o = (np.concatenate([old[item], new[at]]) for old, new in ((self.score, score), (self.doc, doc), (self.null, null)))
            order = np.lexsort((d, o, -s))[: self.depth]
            self.score[item], self.doc[item], self.null[item] = s[order], d[order], o[order]

    def rows(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score)
        doc = pa.array(self.doc[item, place], mask=self.null[item, place])
        return pa.record_batch([pa.array(item.astype(np.int64)), doc, pa.array(self.score[item, place])], names=["item", "doc", "score"])


def _product(starts: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, length: int, depth: int) -> Callable:
    """Best documents of each item, of all blocks of a task. Items are rows of a sparse matrix: starts, terms, times."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                yield batch.slice(at, BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(starts) - 1, depth)
        for block in blocks(batches):
            null = block.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = block.column(0).fill_null(0).to_numpy()
            n, lists = block.column(1).to_numpy(), block.column(2)
            size = pc.list_value_length(lists).to_numpy()
            of, term, tf = np.repeat(np.arange(len(block)), size), lists.flatten().to_numpy(), block.column(3).flatten().to_numpy().astype(np.int64)
            value = impacts(tf, n[of], weights[term], documents, length)
            order = np.argsort(term, kind="stable")
            of, value = of[order], value[order]
            first = np.searchsorted(term[order], np.arange(len(weights) + 1))
            total = np.zeros(len(block), dtype=np.int64)
            for item in range(len(starts) - 1):
                total[:] = 0
                for k in range(starts[item], starts[item + 1]):
                    a, b = first[terms[k]], first[terms[k] + 1]
                    total[of[a:b]] += value[a:b] * times[k]  # a document stands once in a term's row
                best.add(item, total, doc, null)
        yield best.rows()

    return run


def _items(items: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """row (a number of its own), item, text of every item, and the number of groups they go in."""
    numbered = cut(items.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    rows, size = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return numbered, max(-(-rows // MAX_ITEMS), -(-size // MAX_BYTES), 1)


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", depth: int = DEPTH) -> DataFrame:
    """item, rank, doc_id, score: the ``depth`` best documents of every item, as ``item``, rank (from 1), ``doc`` and score.

    Ids of documents are integers. Equal scores go by ascending id.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    numbered, groups = _items(items, item, item_text)
    found = None
    for group in range(groups):
        some = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == group).select("row", "text").toArrow().combine_chunks()  # bounded, see above
        part = _ranked(rows, some, depth)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return top.join(numbered.select("row", "item"), "row").select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")


def _ranked(rows: DataFrame, some: pa.Table, depth: int) -> DataFrame:
    """row, doc, score: what each task found best for the items ``some`` (row, text)."""
    spark = rows.sparkSession
    of, terms = _terms(some["text"].cast(pa.large_string()).combine_chunks()) if len(some) else (np.zeros(0, dtype=np.int64), pa.array([], pa.large_string()))
    real = pc.binary_length(terms).to_numpy() > 0
    of, terms = of[real].astype(np.int64), terms.filter(pa.array(real))
    words = terms.unique()
    pair, times = np.unique(of * max(len(words), 1) + pc.index_in(terms, value_set=words).to_numpy().astype(np.int64), return_counts=True)
    starts = np.searchsorted(pair, np.arange(len(some) + 1) * max(len(words), 1))
    counted = cut(rows.mapInArrow(_counts(words), "doc long, n long, terms array<int>, tfs array<int>"), "counts")
    documents, length = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), dtype=np.int64)
    having = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the group at most
    df[having["term"].to_numpy()] = having["count"].to_numpy()
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    product = _product(starts, pair % max(len(words), 1), times, weights, documents, max(length, 1), depth)
    numbers = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(some), dtype=np.int64)), "row": some["row"]})) if len(some) else spark.createDataFrame([], "at long, row long")
    ranked = counted.filter(F.size("terms") > 0).mapInArrow(product, "item long, doc long, score long")
    return ranked.join(F.broadcast(numbers), ranked["item"] == numbers["at"]).select("row", "doc", "score")  # MAX_ITEMS rows at most
