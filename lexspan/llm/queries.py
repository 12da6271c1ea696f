"""Queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import (
    decontam, divergence, filter_audit, html_extract, jpeg_media, langid, line_dedup, ngram_join, online_packing, packing, quality, token_records, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or tokenizer_file("word_bpe_49k.json")
    return token_records.token_records(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or tokenizer_file("byte_bpe_50k.json")
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jpeg_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.stored_features(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op11_online_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or tokenizer_file("word_bpe_49k.json")
    return online_packing.placed(online_packing.online_pack(_table(spark, sf_dir, "documents"), tokenizer, end_id=1, keep_ids=False))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_token_records": op3_token_records,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_jpeg_media_columns": op7_jpeg_media_columns,
        "op8_toxicity": op8_toxicity,
        "op9_html_extraction": op9_html_extraction,
        "op10_line_dedup": op10_line_dedup,
        "op11_online_packing": op11_online_packing,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interactions": op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op5_benchmark_decontamination": decontam.ORACLE_SQL,
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_filter_interactions": filter_audit.ORACLE_SQL,
    }
