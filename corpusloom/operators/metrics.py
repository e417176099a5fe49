"""Scores of texts against reference texts: BLEU, chrF, ROUGE.

A pair's n-grams are counted and matched inside its row, and so is its longest
common subsequence, in Arrow batches; what is shuffled are sums over the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.session import ship

BLEU_ORDER, CHRF_ORDER, CHRF_BETA = 4, 6, 2
_PUNCTUATION = r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"


def mismatched_ids(predictions: DataFrame, truths: DataFrame, key: str = "id") -> DataFrame:
    """id, problem: of what one side has and the other lacks. Scores need both sides to agree."""
    missing = truths.join(predictions, key, "left_anti").select(F.col(key).alias("id"), F.lit("missing").alias("problem"))
    return missing.unionByName(predictions.join(truths, key, "left_anti").select(F.col(key).alias("id"), F.lit("unexpected").alias("problem")))


def align(predictions: DataFrame, truths: DataFrame, key: str = "id", text: str = "summary") -> DataFrame:
    """id, hypothesis, reference."""
    return predictions.select(F.col(key).alias("id"), F.col(text).alias("hypothesis")).join(truths.select(F.col(key).alias("id"), F.col(text).alias("reference")), "id")


def checked_pairs(predictions: DataFrame, truths: DataFrame, key: str = "id", text: str = "summary", shown: int = 10) -> DataFrame:
    """id, hypothesis, reference; ids that only one side has are an error that names some of each kind."""
    bad = mismatched_ids(predictions, truths, key)
    told = {kind: [r["id"] for r in bad.filter(F.col("problem") == kind).orderBy("id").limit(shown).collect()] for kind in ("missing", "unexpected")}
    if any(told.values()):
        raise ValueError("ids differ; " + "; ".join(f"{k}: {', '.join(map(str, v))}" for k, v in told.items() if v))
    return align(predictions, truths, key, text)


def bleu_words(text: Column) -> Column:
    """Words as the 13a tokeniser of machine translation parts them; case counts."""
    out = F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for entity, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    out = F.regexp_replace(out, _PUNCTUATION, " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([\.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([\.,])([^0-9])", " $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(out, r"(?U)\s+"), lambda w: w != "")


def rouge_words(text: Column, stems: bool = True) -> Column:
    """Lower-case words of a-z and 0-9; those longer than three letters are stemmed."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), r"\s+"), lambda w: w != "")
    return stem(words, "porter", shortest=4) if stems else words


def clipped_matches(a: Sequence, b: Sequence, n: int) -> tuple[int, int, int]:
    """Of the n-grams of two texts or lists: matches, each at most as often as in either, and how many either has."""
    if isinstance(a, str):
        x, y = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (a, b))
    else:
        x, y = (Counter(zip(*[s[i:] for i in range(n)], strict=False)) for s in (a, b))
    return sum(min(c, y[gram]) for gram, c in x.items() if gram in y), max(0, len(a) - n + 1), max(0, len(b) - n + 1)


def overlap(pairs: DataFrame, hypothesis: str, reference: str, order: int) -> DataFrame:
    """id, n, matched, in_hypothesis, in_reference: clipped matches of the n-grams up to ``order``.

    The columns hold arrays of strings, or texts, whose characters count. A pair is
    matched within its row, so that only figures leave it; orders that neither side reaches have no row.
    A null counts as empty.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("array<long>")
    def figures(a: pd.Series, b: pd.Series) -> pd.Series:
        plain = lambda s: "" if s is None else s if isinstance(s, str) else list(s)
        return pd.Series([[v for n in range(1, order + 1) for v in clipped_matches(plain(x), plain(y), n)] for x, y in zip(a, b, strict=True)])

    rows = pairs.select("id", figures(hypothesis, reference).alias("f")).select("id", "f", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n"))
    named = [F.get("f", 3 * (F.col("n") - 1) + i).alias(c) for i, c in enumerate(("matched", "in_hypothesis", "in_reference"))]
    return rows.select("id", "n", *named).filter("in_hypothesis > 0 or in_reference > 0")


def bleu(pairs: DataFrame) -> DataFrame:
    """Corpus BLEU from 0 to 100, with orders that no hypothesis reaches left out and exponential smoothing."""
    cut = pairs.select("id", bleu_words(F.col("hypothesis")).alias("hw"), bleu_words(F.col("reference")).alias("rw"))
    lengths = cut.agg(F.coalesce(F.sum(F.size("hw")), F.lit(0)).alias("hl"), F.coalesce(F.sum(F.size("rw")), F.lit(0)).alias("rl"))
    stats = overlap(cut, "hw", "rw", BLEU_ORDER).groupBy("n").agg(F.sum("matched").alias("m"), F.sum("in_hypothesis").alias("t"))
    table = stats.filter("t > 0").agg(F.array_sort(F.collect_list(F.struct("n", "m", "t"))).alias("rows"))  # a row for each order
    none = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("logs"), F.lit(0).alias("orders"))

    def step(done: Column, x: Column) -> Column:
        scale = F.when(x["m"] == 0, done["scale"] * 2).otherwise(done["scale"])
        precision = F.when(x["m"] == 0, 100.0 / (scale * x["t"])).otherwise(100.0 * x["m"] / x["t"])
        return F.struct(scale.alias("scale"), (done["logs"] + F.log(precision)).alias("logs"), (done["orders"] + 1).alias("orders"))

    total = F.aggregate("rows", none, step)
    penalty = F.when(F.col("hl") < F.col("rl"), F.exp(1 - F.col("rl") / F.col("hl"))).otherwise(1.0)
    any_match = F.exists("rows", lambda x: x["m"] > 0)
    value = F.when(any_match & (F.col("hl") > 0), penalty * F.exp(total["logs"] / total["orders"])).otherwise(0.0)
    return table.crossJoin(F.broadcast(lengths)).select(value.alias("bleu"))  # one row each


def chrf(pairs: DataFrame) -> DataFrame:
    """Corpus chrF2 from 0 to 100, over characters without white space."""
    chars = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    cut = pairs.select("id", chars(F.col("hypothesis")).alias("hc"), chars(F.col("reference")).alias("rc"))
    stats = overlap(cut, "hc", "rc", CHRF_ORDER).groupBy("n").agg(F.sum("matched").alias("m"), F.sum("in_hypothesis").alias("h"), F.sum("in_reference").alias("r"))
    known = stats.filter("h > 0 and r > 0").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    b = CHRF_BETA**2
    value = F.when(F.col("p") + F.col("q") > 0, 100 * (1 + b) * F.col("p") * F.col("q") / (b * F.col("p") + F.col("q"))).otherwise(0.0)
    return known.select(F.coalesce(value, F.lit(0.0)).alias("chrf"))


def _f(matched: Column, h: Column, r: Column) -> Column:
    return F.when(matched > 0, 2.0 * matched / (h + r)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int, stems: bool = True) -> DataFrame:
    """id, rouge: F of the n-grams of words, stemmed or with ``stems`` false as they are, for every pair."""
    cut = pairs.select("id", rouge_words(F.col("hypothesis"), stems).alias("hw"), rouge_words(F.col("reference"), stems).alias("rw"))
    stats = overlap(cut, "hw", "rw", n).filter(F.col("n") == n)
    found = stats.select("id", _f(F.col("matched"), F.col("in_hypothesis"), F.col("in_reference")).alias("rouge"))
    return pairs.select("id").join(found, "id", "left").select("id", F.coalesce("rouge", F.lit(0.0)).alias("rouge"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by the bits of one number: a step takes len(a) / 64 machine words.

    A zero at a place says that the longest subsequence up to there is longer than up to the place before.
    """
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := row & places.get(y, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, stems: bool = True) -> DataFrame:
    """id, rouge: F of the longest common subsequence of words, stemmed or with ``stems`` false as they are."""
    ship(pairs.sparkSession)

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    cut = pairs.select("id", rouge_words(F.col("hypothesis"), stems).alias("hw"), rouge_words(F.col("reference"), stems).alias("rw"))
    return cut.select("id", _f(common("hw", "rw"), F.size("hw"), F.size("rw")).alias("rouge"))


def evaluate(pairs: DataFrame) -> DataFrame:
    """key, value: BLEU, chrF, ROUGE-1, ROUGE-2 and ROUGE-L of all pairs."""
    mean = lambda df, name: df.agg(F.avg("rouge").alias("value")).select(F.lit(name).alias("key"), "value")
    one = lambda df, column, name: df.select(F.lit(name).alias("key"), F.col(column).alias("value"))
    parts = [one(bleu(pairs), "bleu", "BLEU"), one(chrf(pairs), "chrf", "chrF"), mean(rouge_n(pairs, 1), "ROUGE-1"), mean(rouge_n(pairs, 2), "ROUGE-2"), mean(rouge_l(pairs), "ROUGE-L")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["align", "bleu", "checked_pairs", "chrf", "evaluate", "mismatched_ids", "clipped_matches", "overlap", "rouge_l", "rouge_n"]
