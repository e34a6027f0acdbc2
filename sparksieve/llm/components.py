"""Connected components of a graph in a table, by alternating large and small stars.

Each round is two shuffles of the edges; the number of rounds grows with the square of
the logarithm of the graph at most.  Edges stay in tables, kept in the checkpoint folder
after each round, and only a count and a hash of them come to the driver.  A node with
very many edges is a hot join key, which adaptive execution splits; its minimum is
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    up = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    other = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(other).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): each node that has an edge to another, except roots, with the least node of its component."""
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = state, saved(_small_star(_large_star(now)))
