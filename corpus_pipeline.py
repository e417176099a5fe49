"""The training-data pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from corpusloom.llm.common import cut, fresh, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the label model holds for bad go.

    Null and empty texts have no words, which fails; repeated rows are judged alike.
    """
    return quality.filter_quality(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites stay only where they were first; what had nothing else goes.

    n_chars follows the text; a null text stays null; other columns stay as they are.
    """
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    left = line_dedup.dedup_lines(docs, added=(n_lines, n_removed), drop_emptied=True)
    n_chars = F.when(F.col(n_removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id, and all without words or id."""
    return near_dedup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; a null text holds none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it; a null text has null ids. Other columns than the text stay."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids, n_ids, decoded, same = fresh(docs, "ids", "n_ids", "decoded", "round_trip")
    back = pieces.encode(docs, model, ids=ids, decoded=decoded)
    added = [F.size(ids).cast("long").alias(n_ids), F.col(decoded).eqNullSafe(F.col("text")).alias(same)]
    return back.select(*[c for c in docs.columns if c != "text"], ids, *added)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the label model nor the search for similar documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return stage_result(spark, docs, sf_dir)


def stage_result(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, docs, sf_dir)
