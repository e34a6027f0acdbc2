"""Text formats: rule files, URL files, and the output of a run.

Lines are split by Spark's text source, with or without a last line end.  Rules that don't parse are left
out by the rule operators; URLs that don't parse are kept as invalid and counted apart.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one in spark.checkpoint.dir, or a temporary one where everything is on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return named or tempfile.mkdtemp(prefix="filter-")


def _columns(lines: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def read_domain_rules(spark: SparkSession, path: str) -> DataFrame:
    """KEY <tab> PERM -> key, perm."""
    return _columns(spark.read.text(path), ["key", "perm"])


def read_prefix_rules(spark: SparkSession, path: str) -> DataFrame:
    """KEY <tab> RANGE <tab> PERM -> key, rng, perm."""
    return _columns(spark.read.text(path), ["key", "rng", "perm"])


def url_columns(lines: DataFrame) -> DataFrame:
    """URL <tab> TAG in `value` -> url, tag; the tag is what follows the last tab."""
    at = F.regexp_extract("value", r"(?s)^(.*)\t([^\t]*)$", 1)
    return lines.select(at.alias("url"), F.regexp_extract("value", r"(?s)\t([^\t]*)$", 1).alias("tag"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return url_columns(spark.read.text(path))


def write_tags(passing: DataFrame, path: str) -> None:
    """One passing tag a line; order isn't defined."""
    passing.select("tag").write.text(path)


def counter_lines(counters: DataFrame) -> DataFrame:
    """The five lines that close a run: pass, hit, miss, and the checksums of passing and rejected tags."""
    lines = F.array(*[F.col(c).cast("string") for c in ("pass", "hit", "miss", "pass_xor", "hit_xor")])
    return counters.select(F.explode(lines).alias("value"))
