"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.session import cut, new_path, scratch, ship

__all__ = ["SPACE_CLASS", "WORD", "cut", "fresh", "let", "lower_ascii", "new_path", "row_keys", "scratch", "sha256_hex", "ship", "spread_join", "table"]

#: ASCII white space, as the word rules of several operators name it.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Rows of one key that ``spread_join`` leaves together, and how many keys with more it broadcasts at most.
HOT_ROWS, HOT_KEYS = 256, 50_000


def spread_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big.join(small, on, how)`` where a few keys may hold very many rows of ``big``.

    ``counts`` (``small``, where that has one row for each key) gives the number of ``big``'s rows of each key
    in its column ``rows``; it is read more than once, so it should come from files. The rows of
    keys with very many of them are dealt over several salts, for which ``small``'s
    rows are repeated. No more than HOT_KEYS keys can count as such, so that they fit in a
    broadcast.
    """
    own, counts = counts is None, small if counts is None else counts
    total, top = counts.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    most = max(HOT_ROWS, total // HOT_KEYS)
    if top <= most:
        return big.join(small, on, how)
    salts = F.greatest(F.ceil(F.col(rows) / most), F.lit(1)).cast("int")
    hot = F.broadcast(counts.filter(F.col(rows) > most).select(*on, salts.alias("_salts")))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("_salts"))).cast("int")
    dealt = big.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    of = small.withColumn("_salts", salts) if own else small.join(hot, on, "left")
    repeated = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the named columns: equal rows get equal keys, other rows other keys.

    Joins on them treat rows with one id but different texts as different
    documents, and rows equal in both as one.
    """
    cols = [F.col(c) for c in columns]
    flags = [c.isNull() for c in cols]
    return [F.xxhash64(F.lit(seed), *cols, *flags) for seed in (7, 1_000_003)]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
