"""Queries over web pages and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table
from .media import image_classes, rendered
from .warc import derivatives, responses


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record: its links, digests and lengths, and a digest of the whole record."""
    found = derivatives(responses(table(spark, sf_dir, "pages")))
    return found.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest",
        F.sha2("source_http_headers", 256).alias("source_headers_sha256"), F.sha2("record", 256).alias("record_sha256"),
    )


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among the pictures of all vectors, with edited copies of every tenth."""
    # A row is a few bytes and milliseconds of work: small files hold too many rows for a task each.
    vectors = table(spark, sf_dir, "embeddings").repartition(shuffle_partitions(spark), "vec_id")
    return image_classes(rendered(vectors))


QUERIES = {"op7_image_copies": op7_image_copies, "op10_warc_derivatives": op10_warc_derivatives}
SQL: dict[str, str] = {}
