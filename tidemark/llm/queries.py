"""The queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, html_extract, jaccard_join, oracles, packing, quality, substring_dedup, suffix_dedup, training_order, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.contents(training_order.shards(table(spark, sf_dir, "documents")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(table(spark, sf_dir, "conversations"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_html_extract": oracles.OP1,
        "op3_substring_dedup": oracles.OP3,
        "op5_quality_rules": oracles.OP5,
        "op7_chat_format": chat_format.ORACLE,
        "op8_jaccard_join": oracles.OP8,
        "op10_decontamination": oracles.OP10,
    }
