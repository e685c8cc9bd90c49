"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import binary_output, decontaminate, embedding_dedup, exact_dedup, language_id, line_dedup, merkle, oracles, packing, quality, secrets, simhash, substring_dedup, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op5_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_binary(_table(spark, sf_dir, "documents"))


def op9_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op11_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_factorisation_machine,
    op2_multipart_secrets,
    op3_collision_counting,
    op4_best_fit_packing,
    op5_deletion_neighbourhood_lines,
    op6_simhash_near_dedup,
    op7_greedy_string_tiling,
    op8_token_binary,
    op9_naive_bayes_language,
    op10_substring_dedup,
    op11_digest_index,
    op12_merkle_manifest,
    op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_multipart_secrets": oracles.SECRETS,
        "op5_deletion_neighbourhood_lines": oracles.LINE_DEDUP,
        "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op11_digest_index": oracles.EXACT_DEDUP,
        "op12_merkle_manifest": oracles.MERKLE,
        "op13_spelling_variants": oracles.VARIANTS,
    }
