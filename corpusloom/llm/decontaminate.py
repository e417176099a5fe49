"""Benchmark decontamination.

The windows of all benchmark items form a hash set. Every document's words are
looked up among the longest words of these windows; the token
windows around those found are hashed in place and probed against the set; each probe that hits is
verified word by word, and then its span, or its document, goes.

The set is broadcast while its number of windows is at most
``MAX_BROADCAST`` and it takes no more than ``MAX_BROADCAST_BYTES``; a larger one is joined by a shuffle on the window's hash,
whose hot keys adaptive execution splits. Only hits ever travel, and the texts
of documents that have hits to verify.

Defined cases: null and empty texts have no words and no hits; an item of fewer
words than a window counts as one window of its own length; an item without
words is left out; repeated items and repeated documents are each reported;
an empty benchmark or document table gives clean or no rows; extra columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, fresh, let, lower_ascii, row_keys

WINDOW = 10
WORD_BYTES = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: What stands between words before A-Z become a-z.
NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
ITEM_WORD = rf"[^{WORD_BYTES}]++"
#: Windows that are broadcast, and bytes of their words and items.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 200_000, 64 << 20
#: Words that windows are looked for by, as part of the plan; with more of them every window is hashed.
MAX_ANCHORS = 10_000
#: Documents with hits whose keys are broadcast, so that no other text is shuffled; more of them are joined by a shuffle.
MAX_HIT_KEYS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """How many words there are, by a text of their first characters: no word is made for it."""
    firsts = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{NOT_WORD}]*+([^{NOT_WORD}])[^{NOT_WORD}]*+|[{NOT_WORD}]++\z", "$1")
    return F.char_length(firsts).cast("long")


def _window(array: Column, start: Column, length: Column) -> Column:
    return F.slice(array, start + 1, length)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: its hash, its length, its words and the items that have it."""

    def cut_up(w: Column) -> Column:
        n = F.size(w)
        length = F.least(n, F.lit(window))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - length), lambda i: _window(w, i, length))).otherwise(F.array().cast("array<array<string>>"))

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.explode(F.array_distinct(let(words(F.col(text)), cut_up))).alias("words"))
    hashed = rows.select("item", "words", F.size("words").alias("len"), _hash_words(F.col("words")).alias("h"))
    return hashed.groupBy("h", "len", "words").agg(F.collect_set("item").alias("items"))


def _hash_words(w: Column) -> Column:
    """Of the words' hashes, in order; documents get the same value from an array of such hashes."""
    return _fold(F.transform(w, lambda x: F.xxhash64(x)))


def _fold(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def anchor(w: Column) -> Column:
    """The hash of a window's longest word, which few other places of a text have."""
    longest = F.array_max(F.transform(w, lambda x: F.struct(F.char_length(x).alias("n"), F.xxhash64(x).alias("h"))))
    return longest["h"]


def probes(docs: DataFrame, key: list[str], text: str, lengths: list[int], anchors: list[int] | None = None) -> DataFrame:
    """A row for each window of a document: key, first word, length, hash.

    With ``anchors`` windows that hold none of these words (by hash) are left out, and not hashed.
    """
    none = F.array().cast("array<struct<at:int,len:int,h:bigint>>")

    def windows(h: Column, starts: Column, n: int) -> Column:
        each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), _fold(F.slice(h, i + 1, n)).alias("h")))
        return F.when(F.size(h) >= n, each).otherwise(none)

    def every(h: Column) -> Column:
        return F.concat(*[windows(h, F.sequence(F.lit(0), F.size(h) - n), n) for n in lengths])

    def near(h: Column) -> Column:
        last = lambda n: F.size(h) - n
        around = lambda at, n: F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - n + 1, F.lit(0)), F.least(i, last(n))))))
        # of each length, the places of anchors that some window of it can hold
        held = F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(anchors))).otherwise(F.array().cast("array<int>"))
        return let(held, lambda at: F.concat(*[windows(h, around(at, n), n) for n in lengths]))

    hashes = F.transform(words(F.col(text)), lambda x: F.xxhash64(x))
    return docs.select(*key, F.explode(let(hashes, every if anchors is None else near)).alias("w")).select(*key, "w.at", "w.len", "w.h")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc: str = "doc_id", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Of the documents with verified hits: k1, k2 (as ``row_keys``), spots and items.

    ``spots`` are the word positions that are hit, from 0, in order; ``items``
    the ids of the items with an occurring window, as strings, in order.
    """
    spark = docs.sparkSession
    known = benchmark_windows(benchmark, item, item_text, window)
    taken = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("words") + F.size("items"))
    sizes = known.groupBy("len").agg(F.count("*").alias("n"), F.sum(taken).alias("bytes")).collect()  # at most `window` rows
    empty = spark.createDataFrame([], "k1 long, k2 long, spots array<int>, items array<string>")
    if not sizes:
        return empty
    rows = known.select(anchor(F.col("words")).alias("a")).distinct().limit(MAX_ANCHORS + 1).collect()
    anchors = [r["a"] for r in rows] if len(rows) <= MAX_ANCHORS else None
    if sum(r["n"] for r in sizes) <= max_broadcast and sum(r["bytes"] for r in sizes) <= MAX_BROADCAST_BYTES:
        known = F.broadcast(known)
    keyed = docs.select(F.col(text).alias("text"), *[k.alias(n) for k, n in zip(row_keys(doc, text), ("k1", "k2"), strict=True)])
    hits = probes(keyed, ["k1", "k2"], "text", sorted(r["len"] for r in sizes), anchors).join(known, ["h", "len"])
    per_doc = cut(hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "words", "items")).alias("hits")), "hits")
    if per_doc.count() <= MAX_HIT_KEYS:
        keyed = keyed.join(F.broadcast(per_doc.select("k1", "k2")), ["k1", "k2"], "left_semi")
    checked = keyed.join(per_doc, ["k1", "k2"]).select(
        "k1", "k2", let(words(F.col("text")), lambda w: F.filter(F.col("hits"), lambda x: _window(w, x["at"], F.size(x["words"])) == x["words"])).alias("hits")
    )
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + F.size(x["words"]) - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    found = checked.filter(F.size("hits") > 0).select("k1", "k2", spots.alias("spots"), items.alias("items"))
    return found.groupBy("k1", "k2").agg(F.first("spots").alias("spots"), F.first("items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """Of every document: doc, n_words, n_hit, n_items, items (sorted strings) and contaminated."""
    keys = row_keys(doc, text)
    base = docs.select(F.col(doc), count_words(F.col(text)).alias("n_words"), keys[0].alias("k1"), keys[1].alias("k2"))
    found = find(docs, benchmark, text, doc, **options)
    none = F.array().cast("array<string>")
    return base.join(found, ["k1", "k2"], "left").select(
        doc, "n_words", F.coalesce(F.size("spots"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.col("spots").isNotNull().alias("contaminated"),
    )


def without_spans(text: Column, spots: Column) -> Column:
    """The text without the words at ``spots`` and the separators before each of them."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[{NOT_WORD}]*[^{NOT_WORD}]+|[{NOT_WORD}]+$"), F.lit(0))
    left = lambda t: F.array_except(F.sequence(F.lit(0), F.size(t) - 1), spots)
    return let(tokens, lambda t: F.when(F.size(t) == 0, text).otherwise(F.array_join(F.transform(left(t), lambda i: F.get(t, i)), "")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc: str = "doc_id", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or with only their hit spans removed.

    ``remove`` is "documents" or "spans". Columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    found = find(docs, benchmark, text, doc, **options)
    k1, k2, spots = fresh(docs, "k1", "k2", "spots")
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spots").alias(spots))
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(doc, text), strict=True)))
    if remove == "documents":
        return keyed.join(found.select(k1, k2), [k1, k2], "left_anti").select(*docs.columns)
    joined = keyed.join(found, [k1, k2], "left")
    return joined.withColumn(text, F.when(F.col(spots).isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col(spots)))).select(*docs.columns)
