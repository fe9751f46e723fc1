"""The corpus operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, license_scan, mixing, packing, pii, prefix_trie, quality, simhash, substring_dedup, token_counts, url_filter
from .common import documents


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir))
    return packing.pack(counted, F.col("n_tokens"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op5_simhash": op5_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op10_license_scan": op10_license_scan,
    "op3_pii": op3_pii,
    "op6_language_id": op6_language_id,
    "op1_packing": op1_packing,
    "op7_decontamination": op7_decontamination,
    "op9_url_filter": op9_url_filter,
    "op11_mixing": op11_mixing,
    "op12_prefix_trie": op12_prefix_trie,
}
