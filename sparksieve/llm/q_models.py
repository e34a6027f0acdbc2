"""Queries of the operators that learn a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table
from .ctw import score_texts


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(F.col("label_id"), 4) != 2)
    held_out = (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score(docs, model).rows.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"))
    # Code length in bits for each byte and the end mark.
    per_byte = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", per_byte.alias("bits_per_byte"))


QUERIES = {"op3_toxicity": op3_toxicity, "op6_lm_score": op6_lm_score}
SQL: dict[str, str] = {}
