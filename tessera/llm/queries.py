"""The queries of these operators, one opN_<name> each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, bpe, licenses, lines, packing, quality_model, rules, sharding, simhash, substrings
from tessera.llm.common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), word_bpe())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablation(rules.ledger(table(spark, sf_dir, "documents")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": op1_substrings,
        "op2_bpe": op2_bpe,
        "op3_sharding": op3_sharding,
        "op4_ann": op4_ann,
        "op5_lines": op5_lines,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_rules": op9_rules,
        "rules_ablation": rules_ablation,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_lines": lines.oracle(),
        "op9_rules": rules.oracle(),
        "rules_ablation": rules.ablation_oracle(),
    }
