"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, mix.

Each stage takes the documents that its predecessor kept, written and read again, and gives those it
keeps with the columns of the documents; the mix gives each of its documents once per copy.  All
rules for nulls, repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorlake.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from motorlake.llm.queries import table
from motorlake.session import scratch_path, settle
from motorlake.sources.lake import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic documents go."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity .8) one stays."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("decontaminate", unseen_documents),
    ("mix", mixed_documents),
]

#: Two stages (a fitted classifier and connected near copies) have no SQL form; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again.

    A stage's documents go when those of the next are there, as nothing reads them any more.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        docs = settle(stage(spark, docs, sf_dir), path=path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
