"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from corpusloom.llm import chat, decontaminate, html_text, lexical, licences, line_dedup, near_dedup, pieces, quality, spelling, substring_dedup, token_store, trie_join
from corpusloom.llm.common import new_path, sha256_hex, table
from corpusloom.llm.oracle import ORACLE  # noqa: F401  for the entry point


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).withColumnRenamed("doc", "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "digest", "licence", F.array_join("statements", ",").alias("statements"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each message, from the conversations that are built of them: its thread's part, and its place in there."""
    linked = chat.link_messages(table(spark, sf_dir, "conversations"))
    built = chat.in_order(linked).select("conv_id", "thread", "root", "part", F.explode("messages").alias("m"))
    own = ("conv_id", "thread", "root")
    return built.select(*[F.col(c) if c in own else F.col(f"m.{c}") for c in linked.columns], "part", "m.place")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _, names = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", *[F.col(f"{names['features']}.{c}").alias(c) for c in quality.FEATURES], "base_failed", "kept", F.col("quality").alias("quality"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, folder).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.char_length("decoded").cast("long").alias("n_chars_decoded"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of op7 that don't hang on its model, which SQL can check."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.features(F.col("text")).alias("x"))
    return docs.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in quality.FEATURES], quality.base_failed(F.col("x")).alias("base_failed"))


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_substring_dedup, op3_html_extraction, op4_decontamination, op5_licence_scan, op6_chat_formatting, op7_quality_rules, op8_token_store, op9_near_dedup, op10_sentencepiece, op11_lexical_search, op12_jaccard_join, op13_spelling_variants, quality_figures)
}
