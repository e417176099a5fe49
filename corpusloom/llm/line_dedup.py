"""Line dedup by distinct-site spread.

Every line's sites go into a HyperLogLog sketch; sketches of one line merge in
the aggregation, so that a line on a third of all pages is a few kilobytes from
each task. Lines whose estimate lies well above the threshold are boilerplate,
lines well below it are not, and only those near it get an exact distinct count.
Boilerplate lines then go from every document but the first that shows them.

Only DataFrame functions are used. Lines travel as two 64-bit hashes; texts
move once, to meet the positions of their removed lines.

Defined cases: white space around a line doesn't matter, and blank lines are
never boilerplate; a null site counts as none; a null text stays null; rows equal in id
and text are treated alike; an empty table gives an empty result; extra columns
pass through. The first document of a line is the one with the smallest id
(null ids come first), then its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, cut, fresh, let, row_keys

MIN_SITES = 10
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _content(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def occurrences(docs: DataFrame, text: str, doc: str, site: str) -> DataFrame:
    """A row for each line with content: l1, l2 (its hashes), site, doc, k1, k2, at."""
    keys = row_keys(doc, text)
    hashed = F.transform(_lines(F.col(text)), lambda x, i: let(_content(x), lambda c: F.struct(i.alias("at"), F.when(c != "", F.xxhash64(c)).alias("l1"), F.xxhash64(F.lit(11), c).alias("l2"))))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(site).cast("string").alias("site"), F.col(doc).alias("doc"), keys[0].alias("k1"), keys[1].alias("k2"), F.explode(F.filter(hashed, lambda x: x["l1"].isNotNull())).alias("x"))
    return rows.select("x.l1", "x.l2", "site", "doc", "k1", "k2", "x.at")


def band(min_sites: int, lg_k: int = LG_K) -> tuple[float, float]:
    """Estimates between these two don't tell on which side of the threshold a line lies.

    Six standard errors of the sketch on either side, one site at least.
    """
    slack = max(1.0, 6 * 1.04 / (2 ** (lg_k / 2)) * min_sites)
    return min_sites - slack, min_sites + slack


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Lines that may be boilerplate: l1, l2, estimate, near, and where each is found first."""
    low, high = band(min_sites, lg_k)
    each = lines.groupBy("l1", "l2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc", "k1", "k2", "at")).alias("first"))
    found = each.select("l1", "l2", F.hll_sketch_estimate("sketch").alias("estimate"), "first").filter(F.col("estimate") >= low)
    return found.withColumn("near", F.col("estimate") <= high)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: l1, l2, first."""
    maybe = cut(spread(lines, min_sites, lg_k), "spread")
    near = maybe.filter("near").select("l1", "l2")
    pairs = lines.select("l1", "l2", "site").filter(F.col("site").isNotNull()).join(near, ["l1", "l2"], "left_semi").distinct()
    exact = pairs.groupBy("l1", "l2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("l1", "l2")
    return maybe.filter("not near").select("l1", "l2", "first").unionByName(maybe.filter("near").join(exact, ["l1", "l2"], "left_semi").select("l1", "l2", "first"))


def removed_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True, lg_k: int = LG_K) -> DataFrame:
    """Of the documents that lose lines: k1, k2 and ``gone``, the positions of those lines from 0."""
    lines = occurrences(docs, text, doc, site)
    bad = cut(boilerplate(lines, min_sites, lg_k), "boilerplate")
    hits = lines.select("l1", "l2", "k1", "k2", "at").join(bad, ["l1", "l2"])
    if keep_first:
        same = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("at") == F.col("first.at"))
        hits = hits.filter(~same)
    return hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", site: str = "source", added: tuple[str, str] = ("n_lines", "n_removed"), drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of its texts, and two added columns.

    The first added column counts the lines of the text before, the second
    those removed; a name that ``docs`` has already gets an underscore in front. ``drop_emptied`` drops documents all of whose content was removed; those
    that were empty before stay.
    """
    k1, k2, gone, kept, *added = fresh(docs, "k1", "k2", "gone", "kept", *added)
    found = removed_lines(docs, text, doc, site, **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone))
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(doc, text), strict=True)))
    joined = keyed.join(found.hint("shuffle_hash"), [k1, k2], "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = let(_lines(F.col(text)), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest))
    if drop_emptied:
        out = out.filter(F.col(gone).isNull() | F.col(kept).rlike(f"[^{SPACE_CLASS}]"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long")
    counts = [n_lines.alias(added[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(added[1])]
    return out.select(*[F.col(kept).alias(c) if c == text else F.col(c) for c in docs.columns], *counts)
