"""Queries of the operators that work on chunks of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytedup import dedup_bytes
from .common import table
from .decontam import benchmark_matches
from .simhash import near_copies
from .substring import dedup_substrings


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), with_text=False).drop("kept", "text_sha256")


def op8_benchmark_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the items they hold."""
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_suffix_array_dedup": op2_suffix_array_dedup, "op8_benchmark_decontam": op8_benchmark_decontam, "op9_simhash_near_dedup": op9_simhash_near_dedup}
SQL: dict[str, str] = {}
