"""The registered corpus queries: thin uses of the operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlake.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality,
    repeats,
    sql,
    token_counts,
    wrappers,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_pii", sql.PII)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every text."""
    return pii.report(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without strings of 200 bytes that stand elsewhere too."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, from profiles of all documents."""
    return language.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op5_mix_sources", sql.MIX)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_decontaminate", sql.DECONTAMINATE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "n_shingles", "containment")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of being poor or toxic of every document, and whether it is kept."""
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "meta_score", "score", "kept")


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies on two-word shingles."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@query("op10_exact_dedup", sql.EXACT_DEDUP)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, with the row of each that stays."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op11_conversation_trie", sql.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_pack_sequences")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_align_tokenizers")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every text, weighed by the documents that hold them."""
    return alignment.align(table(spark, sf_dir, "documents"))
