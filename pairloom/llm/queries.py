"""The queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.licenses import license_report

    return license_report(_table(spark, sf_dir, "documents"))


def op2_weakly_supervised_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.personal_data import personal_data_report

    return personal_data_report(_table(spark, sf_dir, "documents"))


def op3_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.page_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.decontamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.secrets import secrets_report

    return secrets_report(_table(spark, sf_dir, "documents"))


def op6_weakly_supervised_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.token_files import token_file_digests

    return token_file_digests(_table(spark, sf_dir, "documents"))


def op11_threshold_seeded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.search import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.prefix_trie import conversation_trie, rebuilt_turns

    return conversation_trie(rebuilt_turns(_table(spark, sf_dir, "conversations")))


def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.mixing import sample_copies

    return sample_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_weakly_supervised_personal_data": op2_weakly_supervised_personal_data,
    "op3_template_deduction": op3_template_deduction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_weakly_supervised_quality": op6_weakly_supervised_quality,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_minimum_bin_slack": op8_minimum_bin_slack,
    "op9_fast_similarity_sketching": op9_fast_similarity_sketching,
    "op10_bit_plane_files": op10_bit_plane_files,
    "op11_threshold_seeded_search": op11_threshold_seeded_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_systematic_mix": op13_systematic_mix,
}
