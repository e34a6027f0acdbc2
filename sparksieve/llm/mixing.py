"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a budget in words.  A document has a fixed position in [0, 2^32),
taken from a digest of its id.  A source whose budget is `whole` full passes and a
remainder takes every document `whole` times and those below a threshold position
once more, so budgets nest: a larger one takes all that a smaller one takes.

The threshold comes from histograms, never from a sort of the documents: words are
summed by source and coarse bucket (the position's top 12 bits), the bucket in which
the remainder falls is found, and only that bucket's documents are summed again by
their remaining 20 bits.  The last fine bucket goes in if that brings the source
nearer its remainder.

Cases: null or empty texts have size 0 and take 0; a null source is a source of its
own, ordered last; a null id has a position of its own, the same for all such rows;
rows with equal ids share a position, so repeated rows go in or stay out together;
extra columns are left out (with_times() keeps them, whatever their names); no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, saved, word_count

COARSE_BITS, FINE_BITS = 12, 20
#: Bytes of a table of sources that is broadcast, at most; keys of a source beyond that.
MOST_BROADCAST, SALTS = 4 << 20, 64


def position(key: Column) -> Column:
    """Where a document stands in [0, 2^32): the first 8 hex digits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets of sources, from (source, source_size).

    Sources in code point order (null last) weigh weights[0], weights[1], ... repeating.  They share the
    sum of all sizes; a target stops at cap times its source's size and the excess goes to the others by
    weight until none is above.  In the order of cap * size / weight the sources that stop come first, so
    running sums give the final share of a unit of weight.  One row per source: the windows see few rows.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shared = ranked.withColumn("share", share).withColumn("stops", F.col("most") <= F.col("weight") * F.col("share"))
    unit = F.max(F.when(~F.col("stops"), F.col("share"))).over(every)
    return shared.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * unit).alias("target"))


def _boundary(histogram: DataFrame, bucket: str, left: str) -> DataFrame:
    """For each source the first bucket at which the running size passes `left`, with the size before it."""
    running = Window.partitionBy("source").orderBy(bucket)
    summed = histogram.withColumn("upto", F.sum("size").over(running)).withColumn("before", F.col("upto") - F.col("size"))
    passed = summed.filter(F.col("upto") > F.col(left))
    return passed.groupBy("source").agg(F.min(F.struct(bucket, "before", "size", left)).alias("b")).select("source", "b.*")


def by_source(rows: DataFrame, of_source: DataFrame, name: str, by: str) -> DataFrame:
    """Adds to rows (with a column source) the struct `name` of of_source's row of the same source; rows without one go.

    of_source is in the checkpoint folder with one row per source.  It is broadcast if it is measured to be small;
    otherwise each of its rows is dealt to SALTS keys, among which the rows of a source are spread (by the column `by`),
    so that one source is never one task.
    """
    s, salt = fresh(rows, "source_of", "salt")
    if name in rows.columns or name == s:
        raise ValueError(f"there is a column {name}")
    small = of_source.select(F.col("source").alias(s), F.struct(*[c for c in of_source.columns if c != "source"]).alias(name))
    n, size = of_source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source").cast("long")), F.lit(0))).first()
    same = F.col("source").eqNullSafe(F.col(s))
    if n * 100 + size <= MOST_BROADCAST:
        return rows.join(F.broadcast(small), same).drop(s)
    dealt, own = fresh(rows, "dealt")[0], F.pmod(F.xxhash64(by), F.lit(SALTS))
    many = small.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn(salt, own).join(many, same & (F.col(salt) == F.col(dealt))).drop(s, salt, dealt)


def _places(key: Column) -> tuple[Column, Column]:
    """A position's coarse and fine bucket."""
    at = position(key)
    return F.shiftright(at, FINE_BITS).cast("int"), at.bitwiseAND((1 << FINE_BITS) - 1).cast("int")


def rules(items: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """items(doc_id, source, size) -> one row per source: source_size, target, whole, edge, below (which documents once more)."""
    coarse, fine = _places(F.col("doc_id"))
    base = saved(items.select("doc_id", "source", "size", coarse.alias("coarse"), fine.alias("fine")))
    by_coarse = base.groupBy("source", "coarse").agg(F.sum("size").alias("size"))
    targets = source_targets(by_coarse.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = saved(plan)  # one row per source
    edge = saved(_boundary(by_source(by_coarse, plan.select("source", "left"), "plan", "coarse").select("source", "coarse", "size", "plan.left"), "coarse", "left").select("source", F.col("coarse").alias("edge"), (F.col("left") - F.col("before")).alias("left")))
    inside = by_source(base, edge, "at", "doc_id").filter("coarse = at.edge").groupBy("source", "fine", "at.left").agg(F.sum("size").alias("size"))
    nearer = (F.col("before") + F.col("size") - F.col("left")) < (F.col("left") - F.col("before"))
    last = _boundary(inside, "fine", "left").select(F.col("source").alias("t"), (F.col("fine") + nearer.cast("int")).alias("below"))
    edges = edge.join(last, F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), "edge", "below")
    return saved(plan.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "edge", "below"))


def times(key: Column, rule: str) -> Column:
    """How often a document is taken, by its source's rule."""
    coarse, fine = _places(key)
    r = lambda k: F.col(f"{rule}.{k}")
    # A remainder of 0 has its edge at the first bucket with words and takes none of it.
    again = (coarse < r("edge")) | ((coarse == r("edge")) & (fine < r("below")))
    return r("whole") + F.coalesce(again, F.lit(False)).cast("long")


def with_times(docs: DataFrame, size: str, name: str, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """docs(doc_id, source, `size`, ...) and how often each is taken, as the column `name`; documents stay where they are."""
    rule = fresh(docs, "rule")[0]
    found = rules(docs.select("doc_id", "source", F.col(size).alias("size")), weights, cap)
    return by_source(docs, found, rule, "doc_id").withColumn(name, times(F.col("doc_id"), rule)).drop(rule)


def mix(items: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """items(doc_id, source, size) -> doc_id, source, size, source_size, target, taken (words, repeats counted), times."""
    items = items.select("doc_id", "source", "size")
    taken = by_source(items, rules(items, weights, cap), "rule", "doc_id").withColumn("times", times(F.col("doc_id"), "rule"))
    return taken.select("doc_id", "source", "size", "rule.source_size", "rule.target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix_documents(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """mix() of documents(doc_id, source, text), sized by their words."""
    sized = saved(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))  # words are counted once
    return mix(sized, weights, cap)
