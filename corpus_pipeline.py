"""A corpus from raw documents to packed training batches, stage by stage.

Every stage takes the documents that its predecessor kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapcount.llm import decontam, likeness, packing, pii, quality
from snapcount.session import cut


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain, fitted to ``labels``, does not reject."""
    chain = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word likeness of 0.8 or more: the one with the smallest id.

    Candidates are found by SimHash, compared bit-sliced, and decided by exact likeness of shingle sets (``llm.likeness``). Most texts of
    that likeness differ in more than the four of 64 bits that ``op10_simhash`` links by, so fingerprints are wider here.
    """
    return likeness.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark passage."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a batch."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("simhash", near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

# Learnt models and hashes have no words in SQL; tests/llm hold a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
