"""From raw documents to packed sequences: five operators in a row.

Each stage reads what its predecessor wrote and hands on documents with their columns; the last gives
pieces of sequences with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from homescore.llm import near_dedup, packing, quality_model, secrets, substring_dedup
from homescore.llm.common import small_batches, stage, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it has learned from labels not held out."""
    return quality_model.keep_good(docs, quality_model.fit_unheld(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also stand elsewhere; one that has nothing else stays, empty."""
    small_batches(spark)
    return substring_dedup.remove_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    small_batches(spark)
    import public_tokenizers

    return secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("near-dedup", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Hashing, learning and packing are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
