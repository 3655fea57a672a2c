"""A training-data pipeline over ``documents``; each stage works on all that the one before kept.

Stages with Python workers lower the session's limit of bytes in an Arrow batch
(``common.small_batches``), which changes memory, not results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textspark.llm import bpe, decontaminate, jaccard, pii, quality
from textspark.llm.common import saved, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are judged as texts of no words."""
    small_batches(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words and a similarity of 0.8; null and empty texts and null ids stay."""
    small_batches(spark)
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever values its slots have; null and empty texts and null ids stay."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced; null texts stay null."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; null and empty texts have none. Workers keep little, as the executors still hold what the stages before left."""
    small_batches(spark)
    return bpe.round_trip(docs, keep=200_000)


STAGES = [
    ("good_quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("without_private_data", without_private_data),
    ("tokens", tokens),
]
#: The classifier and the tokenizer cannot be put in SQL; tests/llm tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
