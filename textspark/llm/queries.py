"""Queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_mss, jaccard, language, line_rules, pii, quality, sharding, toxicity
from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mss.main_text(table(spark, sf_dir, "pages"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op3_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text, op2_private_data, op3_benchmark_templates, op4_ngram_jaccard_join, op5_bounded_ring,
        op6_site_quality, op7_byte_bpe, op8_line_frequency, op9_toxicity, op10_language,
    )
}
#: None of the ten can be put in SQL that DuckDB runs over whole tables in reasonable
#: time or at all; tests/llm holds each against a brute-force version instead.
ORACLE_SQL: dict[str, str] = {}
