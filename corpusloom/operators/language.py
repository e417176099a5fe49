"""Language identification by character n-gram profiles, trained from labelled rows.

A language's profile holds its most frequent n-grams with whole-number log
likelihoods (thousandths of a nat, add-one), counted by aggregation over all labelled
texts. A text's score in a language is the sum over its n-grams; what no profile
knows counts as unseen there. The best language is given, or none where the text has no known
n-gram or where its lead over the second is less than MARGIN for each n-gram.

The model is at most PROFILE rows for each language, so that it can be broadcast.
Scores are whole numbers: they don't hang on the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import let
from corpusloom.session import cut, fresh

#: Lengths of n-grams, how many of each language are kept, the lead that an answer needs for each n-gram, and the characters of a text that are read.
LENGTHS, PROFILE, MARGIN, DETECT_CHARS = (3,), 2000, 20, 10_000
#: A model is trained for so many languages at most.
MAX_LANGUAGES = 200


def ngrams(text: Column, lengths: tuple[int, ...] = LENGTHS, chars: int = DETECT_CHARS) -> Column:
    """n-grams of the text's letters in lower case; all else counts as one space between words, and one at either end. Spaces alone are none."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.substring(text, 1, chars)), r"^\P{L}+|\P{L}+$", ""), F.lit(" "))
    plain = F.regexp_replace(plain, r"\P{L}+", " ")

    def of(x: Column, n: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + k) for k in range(n)]))
        some = F.filter(pieces, lambda g: F.trim(g) != "") if n < 3 else pieces
        return F.when(F.size(x) >= n, some).otherwise(F.array().cast("array<string>"))

    # characters are split off once, so that no place is counted from the text's beginning
    return let(F.split(plain, ""), lambda x: F.concat(*[of(x, n) for n in lengths]))


@dataclass(frozen=True)
class Model:
    """weights: gram and, of each language, what it has more than an unseen one; unseen: of each language."""

    languages: tuple[str, ...]
    weights: DataFrame
    unseen: tuple[int, ...]
    lengths: tuple[int, ...]


def _log(x: Column) -> Column:
    return F.floor(1000 * F.log(x) + 1e-9).cast("long")


def train(docs: DataFrame, text: str = "text", language: str = "lang", lengths: tuple[int, ...] = LENGTHS, profile: int = PROFILE) -> Model:
    """The model of all rows that name a language. Rows without a language or a text say nothing."""
    grams = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("language"), F.explode(ngrams(F.col(text), lengths)).alias("gram"))
    counts = grams.groupBy("language", "gram").agg(F.count("*").alias("n"))
    kept = cut(counts.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "gram"))).filter(F.col("place") <= profile).drop("place"), "profiles")
    totals = kept.groupBy("language").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).orderBy("language").limit(MAX_LANGUAGES + 1)
    rows = totals.withColumn("unseen", _log(1 / (F.col("total") + F.col("grams")))).collect()
    if not rows:
        raise ValueError("no row names a language")
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = tuple(r["language"] for r in rows)
    weighed = kept.join(F.broadcast(totals), "language").select("gram", "language", (_log((F.col("n") + 1) / (F.col("total") + F.col("grams"))) - _log(1 / (F.col("total") + F.col("grams")))).alias("more"))
    weights = weighed.groupBy("gram").agg(F.array(*[F.coalesce(F.max(F.when(F.col("language") == x, F.col("more"))), F.lit(0)) for x in names]).alias("more"))
    return Model(names, cut(weights, "model"), tuple(r["unseen"] for r in rows), lengths)


def classify(docs: DataFrame, model: Model, text: str = "text", language: str = "language", lead: str = "lead", margin: int = MARGIN) -> DataFrame:
    """``docs`` with the language of each row (null if none is sure) and its lead over the second, by n-gram.

    Texts don't travel: each task adds up the scores of its own rows.
    """
    row, gram, names = *fresh(docs, "row", "gram"), fresh(docs, *[f"score{i}" for i in range(len(model.languages))])
    n, language, lead = *fresh(docs, "grams"), *fresh(docs, language, lead)
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hits = keyed.select(row, F.explode(ngrams(F.col(text), model.lengths)).alias(gram)).join(F.broadcast(model.weights.withColumnRenamed("gram", gram)), gram, "left")
    sums = [(F.count("*") * F.lit(u) + F.coalesce(F.sum(F.get("more", F.lit(i))), F.lit(0))).alias(names[i]) for i, u in enumerate(model.unseen)]
    scores = hits.groupBy(row).agg(F.count("*").alias(n), F.count("more").alias("known"), *sums)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("first"), F.lit(x).alias("language")) for i, (c, x) in enumerate(zip(names, model.languages, strict=True))])))
    told = scores.select(row, n, "known", ranked.alias("best"))
    gap = F.floor((F.get("best", F.lit(0))["score"] - F.coalesce(F.get("best", F.lit(1))["score"], F.lit(model.unseen[0]) * F.col(n))) / F.col(n)).cast("long")
    told = told.select(row, gap.alias(lead), F.when((F.col("known") > 0) & (gap >= margin), F.get("best", F.lit(0))["language"]).alias(language))
    return keyed.join(told, row, "left").select(*docs.columns, language, lead)
