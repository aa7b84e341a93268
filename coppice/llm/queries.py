"""The fixed-contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, language_model, mixing, ngram_join, packing, permutation_index, pii, quality_rules, rule_ensemble, secrets, sharding, token_alignment, warc_bundles
from .shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_permutation_index": op3_permutation_index,
        "op4_mixing": op4_mixing,
        "op5_rule_ensemble": op5_rule_ensemble,
        "op6_warc_bundles": op6_warc_bundles,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_pii": op9_pii,
        "op10_secrets": op10_secrets,
        "op11_filter_audit": op11_filter_audit,
        "op12_language_model": op12_language_model,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": ngram_join.NGRAM_SQL.format(width=3, percent=90),
        "op4_mixing": mixing.MIX_SQL,
        "op6_warc_bundles": warc_bundles.ROUND_TRIP_SQL,
        "op11_filter_audit": filter_audit.AUDIT_SQL,
    }
