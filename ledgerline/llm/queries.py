"""The registered queries of the training-data operators: each one applies an
operator with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, html_text, licenses, minhash, mixing, phrases, ppm, quality, simhash, spelling, suffix_dedup, token_counts, token_files
from ledgerline.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(documents(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(documents(spark, sf_dir))


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.query(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.query(documents(spark, sf_dir))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_suffix_array_dedup, op3_html_extraction, op4_simhash_near_dedup, op5_license_scan, op6_token_files, op7_ppm_scoring, op8_source_mixing, op9_token_counts, op10_benchmark_decontamination,
                                op11_phrase_collocations, op12_minhash_near_dedup, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.oracle_sql(), "op11_phrase_collocations": phrases.oracle_sql()}
