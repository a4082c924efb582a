"""The driver queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kairolog.llm._tables import load
from kairolog.llm.decontamination import contamination, decontamination_sql
from kairolog.llm.html_extraction import extract_pages
from kairolog.llm.line_dedup import line_dedup_report, line_dedup_sql
from kairolog.llm.ngram_join import jaccard_join, jaccard_sql
from kairolog.llm.packing import pack
from kairolog.llm.quality import quality_metrics, quality_sql
from kairolog.llm.sharding import shard_documents
from kairolog.llm.substring_dedup import substring_dedup, substring_sql
from kairolog.llm.toxicity import toxicity
from kairolog.llm.url_filters import url_filters, url_filters_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(load(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), vocabulary())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))[0]


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("row")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(load(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(load(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents")).drop("row")


def queries() -> dict[str, Query]:
    ours = (
        op1_substring_dedup, op2_line_dedup, op3_packing, op4_sharding, op5_benchmark_decontamination,
        op6_quality_rules, op7_html_extraction, op8_url_filters, op9_toxicity, op10_ngram_jaccard_join,
    )
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_sql(), "op2_line_dedup": line_dedup_sql(), "op5_benchmark_decontamination": decontamination_sql(),
        "op6_quality_rules": quality_sql(), "op8_url_filters": url_filters_sql(), "op10_ngram_jaccard_join": jaccard_sql(),
    }
