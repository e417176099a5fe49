"""Ranked retrieval: one index, ten weighting models.

The index holds blocks: the postings of one term in one slice of the documents. A
block keeps its largest term frequency and its shortest document, from which every model has a
bound of its weights. Files lie by shelf, a hash of the term, and by slice, in order of terms: a
query reads the shelves of its terms only, and a document's score is summed
where its postings lie, so that nothing but each partition's best documents is shuffled.

A query over many slices first adds up the bounds of its terms in each slice, without reading
postings, and leaves out slices that can't hold one of the best documents; ranks
are the same as without. All models are expressions over one relation, so that an index serves
every one of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import cut, fresh, new_path, scratch

K1, B, K3 = 1.2, 0.75, 8.0
MU, LAMBDA, C = 2500.0, 0.15, 1.0
DEPTH = 1000
#: Terms of queries that are broadcast to the postings, and their bytes; more of them are joined by a shuffle.
MAX_BROADCAST_TERMS, MAX_BROADCAST_BYTES = 500_000, 32 << 20
#: Parts that terms are dealt into, and documents of one slice.
SHELVES, SLICE_DOCS = 32, 1024
#: From so many slices on, those that can't matter are left out; so many of each query are scored first, for each SLICE_DOCS of its depth.
PRUNE_SLICES, SEEDS = 64, 4
#: What scores may differ by for the order of sums and the rounding of ranks.
SLACK = 1e-5
#: The catalog's database of the tables of indexes.
DATABASE = "corpusloom"


def _log2(x: Column) -> Column:
    return F.log2(x)


_LOG_E = math.log2(math.e)


def _guarded(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0.0))


def bm25(p) -> Column:
    """The idf isn't clamped: a term in more than half of all documents counts against them."""
    idf = _log2((p.n - p.df + 0.5) / (p.df + 0.5))
    return idf * (K1 + 1) * p.tf / (p.tf + K1 * (1 - B + B * p.dl / p.avdl))


def tf_idf(p) -> Column:
    return K1 * p.tf / (p.tf + K1 * (1 - B + B * p.dl / p.avdl)) * _log2(p.n / p.df + 1)


def dirichlet_lm(p) -> Column:
    return (_log2(1 + p.tf / (MU * p.cf / p.total)) + _log2(MU / (p.dl + MU)))


def hiemstra_lm(p) -> Column:
    return _log2(1 + LAMBDA * p.tf * p.total / ((1 - LAMBDA) * p.cf * p.dl))


def _tfn(p) -> Column:
    return p.tf * _log2(1 + C * p.avdl / p.dl)


def pl2(p) -> Column:
    tfn, lam = _tfn(p), p.cf / p.n
    return (tfn * _log2(tfn / lam) + (lam - tfn) * _LOG_E + 0.5 * _log2(2 * math.pi * tfn)) / (tfn + 1)


def dph(p) -> Column:
    f = p.tf / p.dl
    gain = p.tf * _log2(p.tf * (p.avdl / p.dl) * (p.n / p.cf)) + 0.5 * _log2(2 * math.pi * p.tf * (1 - f))
    return _guarded(f < 1, (1 - f) * (1 - f) / (p.tf + 1) * gain)


def dlh(p) -> Column:
    f = p.tf / p.dl
    gain = p.tf * _log2(p.tf * (p.avdl / p.dl) * (p.n / p.cf)) + (p.dl - p.tf) * _log2(1 - f) + 0.5 * _log2(2 * math.pi * p.tf * (1 - f))
    return _guarded(f < 1, gain / (p.tf + 0.5))


def lgd(p) -> Column:
    lam = p.df / p.n
    return _log2((lam + _tfn(p)) / lam)


def dfic(p) -> Column:
    e = p.cf * p.dl / p.total
    return _guarded(p.tf > e, _log2(1 + (p.tf - e) * (p.tf - e) / e))


def dfiz(p) -> Column:
    e = p.cf * p.dl / p.total
    return _guarded(p.tf > e, _log2(1 + (p.tf - e) / F.sqrt(e)))


MODELS = {"bm25": bm25, "tf-idf": tf_idf, "dirichlet-lm": dirichlet_lm, "hiemstra-lm": hiemstra_lm, "pl2": pl2, "dph": dph, "dlh": dlh, "lgd": lgd, "dfic": dfic, "dfiz": dfiz}


def query_weight(model: str, qtf: Column) -> Column:
    """What a term's weight is multiplied by for its frequency in the query."""
    return (K3 + 1) * qtf / (K3 + qtf) if model == "bm25" else qtf


@dataclass(frozen=True)
class _Posting:
    """The figures that a model may use, as columns of doubles."""

    tf: Column
    dl: Column
    df: Column
    cf: Column
    n: Column
    total: Column
    avdl: Column


def _highest_pl2(p, share: Column) -> Column:
    """Of the first two terms, the fraction grows with tfn above the mean and falls below it; the third is 0.665 at most."""
    tfn, lam = _tfn(p), p.cf / p.n
    return F.greatest((tfn * _log2(tfn / lam) + (lam - tfn) * _LOG_E) / (tfn + 1), lam * _LOG_E) + 0.665


def _highest_share(p, share: Column, start: float, rest: float) -> Column:
    return p.tf / (p.tf + start) * F.greatest(_log2(share * p.avdl * p.n / p.cf), F.lit(0.0)) + rest


#: What a block's weights don't exceed, by its largest tf and shortest document (as tf and dl) and its largest tf / dl.
#: The other models grow with tf and fall with dl: their own weight is the bound. The numbers are what the
#: Stirling term 0.5 * log2(2 * pi * tf) / (tf + start) has at tf = 1, its largest, rounded up.
HIGHEST = {"pl2": _highest_pl2, "dph": lambda p, share: _highest_share(p, share, 1, 0.663), "dlh": lambda p, share: _highest_share(p, share, 0.5, 0.884)}


def highest(model: str, p, share: Column) -> Column:
    return F.greatest(HIGHEST[model](p, share) if model in HIGHEST else MODELS[model](p), F.lit(0.0))


@dataclass(frozen=True)
class Index:
    """blocks: shelf, slice, term, df, cf, top_tf, low_dl, top_share, postings (an array of docno, tf, dl); terms: shelf, term, df, cf; stats: one row n, total, avdl.

    ``slices`` is the number of parts that documents are dealt into.
    """

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    slices: int


def query_terms(queries: DataFrame, tokens: Column, qid: str = "qid") -> DataFrame:
    """qid, term, qtf. A query of stop words only has no rows, and gets none later on."""
    return queries.select(F.col(qid).alias("qid"), F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _shelf(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHELVES)).cast("int")


def build_index(documents: DataFrame, tokens: Column, docno: str = "docno", slices: int | None = None, buckets: int | None = None) -> Index:
    """The index as a plan, which is run anew by each query; ``write_index`` keeps it.

    Texts travel once, to their slice; words are counted and blocks are made where they are.
    """
    slices = slices or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (own,) = fresh(documents, "slice")
    dealt = documents.withColumn(own, F.pmod(F.xxhash64(docno), F.lit(slices)).cast("int")).repartition(*([buckets] if buckets else []), own)
    rows = dealt.select(F.col(own).alias("slice"), F.col(docno).alias("docno"), tokens.alias("tokens"))
    counted = rows.select("slice", "docno", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("slice", "docno", "term", "dl").agg(F.count("*").cast("int").alias("tf"))
    figures = [F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("top_tf"), F.min("dl").alias("low_dl"), F.max(F.col("tf") / F.col("dl")).alias("top_share")]
    blocks = counted.groupBy("slice", "term").agg(*figures, F.collect_list(F.struct("docno", "tf", "dl")).alias("postings")).withColumn("shelf", _shelf(F.col("term")))  # SLICE_DOCS postings or so
    length = F.size(tokens).cast("long")
    stats = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total"), F.avg(length).alias("avdl"))
    return Index(blocks, _terms(blocks), stats, slices)


def _terms(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("shelf", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def write_index(documents: DataFrame, tokens: Column, folder: str, docno: str = "docno", buckets: int | None = None, slice_docs: int = SLICE_DOCS) -> Index:
    """Build the index, write it to ``folder`` and give it back as it is read from there.

    The texts are read once. ``buckets``, by default as many as shuffle partitions, should be such that the
    words of one fit in an executor's memory.
    """
    spark = documents.sparkSession
    n = documents.select(docno).count()  # documents without words count too
    slices = max(1, -(-n // slice_docs))
    buckets = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), slices)
    blocks = build_index(documents, tokens, docno, slices, buckets).blocks
    kind = blocks.schema["postings"].dataType.elementType["docno"].dataType.simpleString()
    name = _table_name(spark, folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    blocks.write.mode("overwrite").format("parquet").partitionBy("shelf").bucketBy(buckets, "slice").sortBy("term").option("path", f"{folder}/blocks").saveAsTable(name)
    _terms(spark.table(name)).repartition("shelf").write.mode("overwrite").partitionBy("shelf").parquet(f"{folder}/terms")
    total = spark.read.schema("cf long").parquet(f"{folder}/terms").agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    about = [(n, total, total / n if n else None, slices, buckets, kind)]
    spark.createDataFrame(about, "n long, total long, avdl double, slices int, buckets int, docno string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
    return read_index(spark, folder)


def _table_name(spark: SparkSession, folder: str) -> str:
    """Bucketed files need a table; those of indexes are in a database of their own."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    return f"{DATABASE}.index_{hashlib.sha256(folder.encode()).hexdigest()[:20]}"


def read_index(spark: SparkSession, folder: str) -> Index:
    """An index that ``write_index`` wrote, in this session or another."""
    about, name = spark.read.parquet(f"{folder}/about"), _table_name(spark, folder)
    slices, buckets, kind = about.select("slices", "buckets", "docno").first()
    if not spark.catalog.tableExists(name):
        columns = f"slice INT, term STRING, df BIGINT, cf BIGINT, top_tf INT, low_dl INT, top_share DOUBLE, postings ARRAY<STRUCT<docno: {kind}, tf: INT, dl: INT>>, shelf INT"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (shelf) CLUSTERED BY (slice) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{folder}/blocks'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    terms = spark.read.schema("term string, df long, cf long, shelf int").parquet(f"{folder}/terms")
    return Index(spark.table(name), terms, about.select("n", "total", "avdl"), slices)


def forget_index(spark: SparkSession, folder: str) -> None:
    """Drop the catalog's entry of an index; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(spark, folder)}")


@dataclass(frozen=True)
class _Asked:
    """What a batch of queries needs: its terms' weights, and the shelves that they are on."""

    index: Index
    model: str
    terms: DataFrame  # qid, times, term, shelf, df, cf, n, total, avdl
    small: Callable[[DataFrame], DataFrame]

    def blocks(self, *columns: str) -> DataFrame:
        return self.index.blocks.select("shelf", "slice", "term", *columns)


def _size() -> list[Column]:
    """Rows of terms, and their bytes."""
    return [F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0))]


def _hint(rows: int, size: int) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if rows <= MAX_BROADCAST_TERMS and size <= MAX_BROADCAST_BYTES else lambda df: df


def _asked(index: Index, queries: DataFrame, model: str) -> _Asked:
    on = queries.select("qid", "term", query_weight(model, F.col("qtf").cast("double")).alias("times"), _shelf(F.col("term")).alias("shelf"))
    rows, size, shelves = on.agg(*_size(), F.collect_set("shelf")).first()  # SHELVES numbers at most
    small = _hint(rows, size)
    pruned = Index(index.blocks.filter(F.col("shelf").isin(shelves)), index.terms.filter(F.col("shelf").isin(shelves)), index.stats, index.slices)
    known = pruned.terms.join(small(on), ["shelf", "term"]).crossJoin(F.broadcast(index.stats))  # stats: one row
    return _Asked(pruned, model, known, small)


def _figures(tf: str, dl: str) -> _Posting:
    return _Posting(*[F.col(c).cast("double") for c in (tf, dl, "df", "cf", "n", "total", "avdl")])


def _sums(asked: _Asked, rows: DataFrame) -> DataFrame:
    """Scores from rows of blocks with what is asked of them (askers: an array of qid, times). A weight is computed once for each posting of a row."""
    postings = rows.select("slice", "askers", "df", "cf", "n", "total", "avdl", F.explode("postings").alias("x"))
    p = _figures("x.tf", "x.dl")
    weighted = postings.select("slice", F.col("x.docno").alias("docno"), MODELS[asked.model](p).alias("weight"), F.explode("askers").alias("q"))
    return weighted.groupBy("q.qid", "slice", "docno").agg(F.sum(F.col("weight") * F.col("q.times")).alias("score")).select("qid", "docno", "score")


_TERM = ("df", "cf", "n", "total", "avdl")


def score(index: Index, queries: DataFrame, model: str = "bm25") -> DataFrame:
    """qid, docno, score, of every document that shares a term with the query."""
    if model not in MODELS:
        raise ValueError(f"no weighting model {model!r}; there are {', '.join(MODELS)}")
    asked = _asked(index, queries, model)
    by_term = asked.terms.groupBy("shelf", "term", *_TERM).agg(F.collect_list(F.struct("qid", "times")).alias("askers"))
    return _sums(asked, asked.blocks("postings").join(asked.small(by_term), ["shelf", "term"]))


def top(index: Index, queries: DataFrame, model: str = "bm25", depth: int = DEPTH) -> DataFrame:
    """qid, docno, score, of all documents that may be among the ``depth`` best, and of others.

    The bounds of a slice's blocks, added up over a query's terms, are what no document of the slice exceeds.
    Slices with the highest are scored first. Those whose sum is below the score of the last document that is then
    among the best are left out; their postings are neither unpacked nor weighed.
    """
    if model not in MODELS:
        raise ValueError(f"no weighting model {model!r}; there are {', '.join(MODELS)}")
    asked = _asked(index, queries, model)
    terms = asked.small(asked.terms)
    bound = highest(model, _figures("top_tf", "low_dl"), F.col("top_share")) * F.col("times")
    limits = asked.blocks("top_tf", "low_dl", "top_share").join(terms, ["shelf", "term"]).select("qid", "slice", bound.alias("bound")).groupBy("qid", "slice").agg(F.sum("bound").alias("limit"))
    best_first = Window.partitionBy("qid").orderBy(F.col("limit").desc(), "slice")
    seeds = cut(limits.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= SEEDS * (1 + depth // SLICE_DOCS)).select("qid", "slice"), "seeds")
    row = F.array(F.struct("qid", "times")).alias("askers")
    hits = asked.blocks("postings").join(terms, ["shelf", "term"]).select("qid", "slice", "postings", *_TERM, row)
    first = _sums(asked, hits.join(asked.small(seeds), ["qid", "slice"], "left_semi"))
    floor = rank(first, depth, None).filter(F.col("rank") == depth).select("qid", (F.col("score") - SLACK).alias("floor"))
    able = limits.join(F.broadcast(cut(floor, "floors")), "qid", "left").filter(F.col("floor").isNull() | (F.col("limit") >= F.col("floor")))  # a row for each query
    pairs = cut(able.select("qid", "slice"), "able")
    return _sums(asked, hits.join(F.broadcast(pairs) if pairs.count() <= MAX_BROADCAST_TERMS else pairs, ["qid", "slice"], "left_semi"))  # else postings travel once for each query


def rank(scores: DataFrame, depth: int = DEPTH, digits: int | None = 9, parts: tuple[str, ...] = ()) -> DataFrame:
    """qid, docno, rank from 1, score: by score, then docno. With ``parts``, columns that come first, within each of their values.

    Scores are compared after rounding, so that ties don't hang on the order in which sums were made.
    """
    shown = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy(*parts, "qid").orderBy(F.col("score").desc(), F.col("docno"))
    return scores.withColumn("score", shown).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth).select(*parts, "qid", "docno", "rank", "score")


def search(index: Index, queries: DataFrame, query_tokens: Column, model: str = "bm25", depth: int = DEPTH, qid: str = "qid", digits: int | None = 9) -> DataFrame:
    """Ranked documents of every query, from an index. With many slices, those that can't matter are left out."""
    terms = query_terms(queries, query_tokens, qid)
    found = top(index, terms, model, depth) if index.slices >= PRUNE_SLICES else score(index, terms, model)
    return rank(found, depth, digits)


def _write_postings(documents: DataFrame, docno: str, part: Column, tokens: Column, terms: DataFrame, hint: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """part, docno, dl, term, tf, docs: the postings of ``terms`` (part, term), and with a null term what is left of documents; docs sums up to the number of documents."""
    spark, buckets = documents.sparkSession, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.repartition(buckets, docno).select(part.alias("part"), F.col(docno).alias("docno"), tokens.alias("tokens"))
    found = texts.select("part", "docno", F.size("tokens").alias("dl"), F.posexplode_outer("tokens").alias("at", "term"))
    first, known = F.coalesce(F.col("at") == 0, F.lit(True)), F.col("asked").isNotNull()  # documents without words have a row too
    hits = found.join(hint(terms.withColumn("asked", F.lit(True))), ["part", "term"], "left").filter(known | first)
    dealt = hits.select("part", "docno", "dl", F.when(known, F.col("term")).alias("term"), first.alias("first")).repartition(buckets, "docno")  # tokens may be made by Python, after which Spark no longer knows how rows are dealt
    counted = dealt.groupBy("part", "docno", "dl", "term").agg(F.count("*").cast("int").alias("tf"), F.count_if("first").alias("docs"))
    name = _table_name(spark, folder)
    counted.write.format("parquet").bucketBy(buckets, "docno").sortBy("docno").option("path", folder).saveAsTable(name)
    return spark.table(name)


def retrieve(documents: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, model: str = "bm25", depth: int = DEPTH, docno: str = "docno", qid: str = "qid", digits: int | None = 9, part: str | None = None) -> DataFrame:
    """Ranked documents of every query, from the texts, without an index: words that no query asks for become no postings.

    With ``part``, a column of both, the documents of each of its values are a collection with figures of its own, and the
    result has that column first. Texts are analysed once, and postings are kept until the ranks are written.
    """
    if model not in MODELS:
        raise ValueError(f"no weighting model {model!r}; there are {', '.join(MODELS)}")
    spark, of = documents.sparkSession, F.col(part) if part else F.lit(0)
    with scratch(spark):
        found = queries.select(of.alias("part"), F.col(qid).alias("qid"), F.explode(query_tokens).alias("term")).groupBy("part", "qid", "term").agg(F.count("*").cast("double").alias("qtf"))
        asked = cut(found.select("part", "qid", "term", query_weight(model, F.col("qtf")).alias("times")), "asked")
        hint = _hint(*asked.agg(*_size()).first())
        folder = new_path(spark, "postings")
        try:
            postings = _write_postings(documents, docno, of, doc_tokens, asked.select("part", "term").distinct(), hint, folder)
            stats = postings.groupBy("part").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("dl")).alias("total"), F.sum(F.when(F.col("dl").isNotNull(), F.col("docs"))).alias("with_text"))
            stats = stats.select("part", "n", "total", (F.col("total") / F.col("with_text")).alias("avdl"))
            figures = postings.filter("term IS NOT NULL").groupBy("part", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(stats, "part")
            known = figures.join(asked.groupBy("part", "term").agg(F.collect_list(F.struct("qid", "times")).alias("askers")), ["part", "term"])
            weighted = postings.join(hint(known), ["part", "term"]).select("part", "docno", MODELS[model](_figures("tf", "dl")).alias("weight"), F.explode("askers").alias("q"))
            scores = weighted.groupBy("part", "q.qid", "docno").agg(F.sum(F.col("weight") * F.col("q.times")).alias("score"))
            return cut(rank(scores, depth, digits, ("part",)).select(*([F.col("part").alias(part)] if part else []), "qid", "docno", "rank", "score"), "ranked", inner=False)
        finally:
            forget_index(spark, folder)


def dataset_language(queries: DataFrame, language: str = "language") -> str:
    """The one language of all queries; none or several are an error."""
    found = [r[0] for r in queries.select(language).distinct().orderBy(language).limit(20).collect()]
    if not found or found == [None]:
        raise ValueError("the queries name no language")
    if len(found) > 1:
        raise ValueError(f"the queries name several languages: {', '.join(map(str, found))}")
    return found[0]
