"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, lm_score, media, near_dup, packing, secret_scan, sql, substring_dedup, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]
#: Rows and bytes that an Arrow batch takes to a Python worker; long texts make wide rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), 0.85)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, limit=4096)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_context_mixing": op3_context_mixing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_token_files": op5_token_files,
        "op6_media_columns": op6_media_columns,
        "op7_secret_scan": op7_secret_scan,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that have one; the others (machines, models, files, tokens) are tested against brute force."""
    return {
        "op4_minhash_near_dedup": sql.near_dup(85),
        "op7_secret_scan": sql.secret_scan(),
        "op8_substring_dedup": sql.substring_dedup(),
    }
