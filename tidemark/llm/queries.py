"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import audio, bpe, filter_audit, html_extract, license_scan, packing, pii, quality, resampling, secret_scan, simhash, token_counts, url_filter
from tidemark.llm.common import shared_folder, table


#: The key of the registered query only; pseudonyms that must hold need a secret one.
EXAMPLE_KEY = "tidemark"


def op1_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_round_trip(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_simhash_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that each run does the whole work; a deployment keeps one."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_columns": op1_audio_columns,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_license_scan": op3_license_scan,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_url_templates": op5_url_templates,
    "op6_html_main_text": op6_html_main_text,
    "op7_simhash_pivot_tables": op7_simhash_pivot_tables,
    "op8_adaptive_quality_rules": op8_adaptive_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.oracle(),
    "op8_adaptive_quality_rules": quality.oracle(),
    "op11_importance_resampling": resampling.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
