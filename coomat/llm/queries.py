"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coomat.llm import credentials, decontaminate, html_text, language_id, merkle, ngram_join, packing, pii, quality, sharding, url_filter, weak_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *weak_rules.BASE, "base_failed", "kept", "quality")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find(table(spark, sf_dir, "documents"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op11 SQL can say."""
    return op11_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven_documents(table(spark, sf_dir, "documents"))


def personal_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6 SQL can say."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7 SQL can say."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *weak_rules.BASE, "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_language_id": op2_language_id,
        "op3_html_extraction": op3_html_extraction,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_pii": op6_pii,
        "op7_quality_rules": op7_quality_rules,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_decontamination": op9_decontamination,
        "op10_sharding": op10_sharding,
        "op11_secret_scans": op11_secret_scans,
        "personal_base_counts": personal_base_counts,
        "quality_base": quality_base,
        "secret_base_spans": secret_base_spans,
        "op12_merkle_manifest": op12_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.oracle_sql(),
        "op5_ngram_jaccard_join": ngram_join.oracle_sql(),
        "personal_base_counts": pii.base_sql(),
        "quality_base": weak_rules.base_sql(),
        "secret_base_spans": credentials.base_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(),
    }
