"""Queries over whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.llm import html_blocks, kneser_ney, license_digests, mixing, one_bit, order_minhash, ppm_language, relative_lz, string_tiling, tiered_index, token_links, url_rules, warc_zip
from customsloom.llm.common import table


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op4_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests.scan_documents(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tiered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_index.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align_documents(table(spark, sf_dir, "documents"))


def op13_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_ppm_language": op2_ppm_language,
    "op3_warc_zip": op3_warc_zip,
    "op4_license_digests": op4_license_digests,
    "op5_url_rules": op5_url_rules,
    "op6_string_tiling": op6_string_tiling,
    "op7_one_bit": op7_one_bit,
    "op8_html_blocks": op8_html_blocks,
    "op9_order_minhash": op9_order_minhash,
    "op10_mixing": op10_mixing,
    "op11_tiered_index": op11_tiered_index,
    "op12_token_links": op12_token_links,
    "op13_relative_lz": op13_relative_lz,
}

ORACLES: dict[str, str] = {"op4_license_digests": license_digests.oracle_sql(), "op11_tiered_index": tiered_index.oracle_sql(), "op13_relative_lz": relative_lz.oracle_sql()}
