"""One query per training-data operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import byte_cnn, decontam, html_render, license_scan, line_dedup, mixing, sharding, simhash, token_files, weak_rules
from ledgerspark.llm.common import table


def tokenizer_path() -> str:
    """The tokenizer that the queries use: a file outside this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op7_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.selectExpr("doc_id", "_ls_size AS size", "_ls_source_size AS source_size", "_ls_target AS target", "_ls_copies * _ls_size AS taken")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_spaced_seed_decontamination, op2_html_layout, op3_line_windows, op4_simhash_blocks, op5_license_signatures, op6_weak_rules, op7_vector_shards, op8_token_files, op9_entropy_mix, op10_byte_cnn)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Line dedup is the one that SQL expresses; the others are tested against brute force in tests/llm."""
    return {"op3_line_windows": line_dedup.SQL}
