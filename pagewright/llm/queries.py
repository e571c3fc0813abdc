"""One query for each training-data operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, line_dedup, packing, prefix_trie, quality_classifier, quality_rules, ranked_search, sharding, simhash, token_orc, toxicity
from .sql import CHAT_SQL, DECONTAMINATION_SQL, EXACT_DEDUP_SQL, LINE_DEDUP_SQL, PREFIX_TRIE_SQL, RANKED_SEARCH_SQL, quality_rules_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.digest(token_orc.token_files(_table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_orc,
        op2_quality_rules,
        op3_decontamination,
        op4_chat_perspectives,
        op5_packing,
        op6_toxicity,
        op7_quality_classifier,
        op8_hilbert_shards,
        op9_line_dedup,
        op10_simhash,
        op11_exact_dedup,
        op12_prefix_trie,
        op13_ranked_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules_sql(),
    "op3_decontamination": DECONTAMINATION_SQL,
    "op4_chat_perspectives": CHAT_SQL,
    "op9_line_dedup": LINE_DEDUP_SQL,
    "op11_exact_dedup": EXACT_DEDUP_SQL,
    "op12_prefix_trie": PREFIX_TRIE_SQL,
    "op13_ranked_search": RANKED_SEARCH_SQL,
}
