"""The queries of the training-data operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, forest, hard_negatives, jaccard, language_id, language_model, lattice, license_scan, prefix_trie, quality, sharding, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "op1_license_scan": lambda s, d: license_scan.report(t(s, d, "documents")),
        "op2_chat_rotation": lambda s, d: chat.report(t(s, d, "conversations")),
        "op3_hash_prefix_forest": lambda s, d: forest.report(t(s, d, "embeddings")),
        "op4_decontaminate": lambda s, d: decontaminate.report(t(s, d, "documents"), t(s, d, "benchmark")),
        "op5_deleted_interpolation": lambda s, d: language_model.lm_scores(t(s, d, "documents")),
        "op6_quality_mil": lambda s, d: quality.report(t(s, d, "documents"), t(s, d, "labels")),
        "op7_histogram_sort": lambda s, d: sharding.report(t(s, d, "documents")),
        "op8_sentencepiece_lattice": lambda s, d: lattice.report(t(s, d, "documents")),
        "op9_suffix_dedup": lambda s, d: suffix_dedup.report(t(s, d, "documents")),
        "op10_jaccard_join": lambda s, d: jaccard.report(t(s, d, "documents")),
        "op11_prefix_trie": lambda s, d: prefix_trie.report(t(s, d, "conversations")),
        "op12_hard_negatives": lambda s, d: hard_negatives.report(t(s, d, "embeddings")),
        "op13_language_id": lambda s, d: language_id.report(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op2_chat_rotation": chat.ORACLE,
        "op4_decontaminate": decontaminate.ORACLE,
        "op10_jaccard_join": jaccard.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_language_id": language_id.ORACLE,
    }
