"""URLs as a stream, judged by static rules.

Each micro-batch goes through the batch plan: longest matches are aggregations within a URL's own row set, so
no state is kept between batches, and a batch's tags are written once.  Counters of batches are added by the
reader of `counters_path`: counts by sum, checksums by XOR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import hex8
from ..plans.engine import counters, passing_tags, verdicts


def start_filter(lines: DataFrame, domain_rules: DataFrame, prefix_rules: DataFrame, tags_path: str, counters_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts judging a streaming DataFrame (url, tag); a batch that is tried again replaces its own output."""

    def judge(batch: DataFrame, number: int) -> None:
        kept: list[DataFrame] = []
        judged = verdicts(batch, domain_rules, prefix_rules, kept).persist()
        try:
            passing_tags(judged).write.mode("overwrite").text(f"{tags_path}/batch={number}")
            counters(judged).write.mode("overwrite").parquet(f"{counters_path}/batch={number}")
        finally:
            for frame in (judged, *kept):
                frame.unpersist()

    return lines.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def total_counters(batches: DataFrame) -> DataFrame:
    """The counters of all batches together."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    xor = lambda c: hex8(F.coalesce(F.bit_xor(F.conv(c, 16, 10).cast("bigint")), F.lit(0).cast("bigint"))).alias(c)
    return batches.agg(*map(total, ("pass", "hit", "miss", "invalid")), *map(xor, ("pass_xor", "hit_xor")))
