"""Rule lines and URLs derived from the pages table, for the queries.

Pages have URLs without ports.  Ports, tags, invalid URLs and rules are set by page_id, the same way in the
queries' SQL, so that both see the same input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Inputs(NamedTuple):
    urls: DataFrame
    domain_rules: DataFrame
    prefix_rules: DataFrame


def _choose(by: Column, *values: Column) -> Column:
    """values[by], null where there is none."""
    return F.get(F.array(*values), by.cast("int"))


def _present(key: Column) -> Column:
    """Rows that have a key; exploding keeps the long expression from being repeated where the key is used."""
    return F.explode(F.array_compact(F.array(key)))


def derived(spark: SparkSession, sf_dir: str) -> Inputs:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    k = F.col("page_id")
    port = F.when(k % 5 == 1, ":80").when(k % 5 == 2, ":443").when(k % 5 == 3, ":8080").otherwise("")
    url = F.regexp_replace("url", F.lit("^(https?://[^/:]+)"), F.concat(F.lit("$1"), port))
    url = F.when(k % 50 == 49, F.regexp_replace(url, "^https?", "ftp")).otherwise(url)
    urls = pages.select("page_id", url.alias("url"), F.format_string("%08x", (k * 2654435761) % 4294967296).alias("tag"))

    part = lambda i: F.regexp_extract("url", "^(https?)://([^/:]+)(/.*)$", i)
    raw = pages.select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    top = F.regexp_replace("host", r"^.*\.", "")
    c = F.concat
    key = _choose(k % 11, F.col("host"), c(F.lit("."), parent), parent, c("host", F.lit(":8080")), c(F.lit("."), parent, F.lit(":80")), c(parent, F.lit(":443")), F.when(top == "org", c(F.lit("."), top)), F.when(top == "org", top), c("host", F.lit(":0")), F.col("host"))
    domain = raw.select(_present(key).alias("key"), F.when(k % 7 == 0, "-").otherwise("+").alias("perm"))

    first = F.regexp_extract("path", "^(/[^/]*)", 1)
    base = c("scheme", F.lit("://"), "host")
    none = c(F.lit("//"), "host")
    key = _choose(
        k % 13, c(base, "path"), c(base, first), c(base, F.lit("/")), c(none, first), c(none, F.lit(":80"), first), c(none, F.lit(":443/")), c(base, F.lit(":8080"), first),
        c(base, F.expr("left(path, 5)")), c(none, "path"), F.col("host"), c(base, "path"), c(none, "path"),
    )
    prefix = raw.select(_present(key).alias("key"), F.when(k % 3 == 0, "=").when(k % 3 == 1, "+").otherwise("*").alias("rng"), F.when(k % 2 == 0, "-").otherwise("+").alias("perm"))
    return Inputs(urls, domain, prefix)


#: The same inputs in SQL: u(page_id, url, tag), dl(key, perm), pl(key, rng, perm).
INPUTS_SQL = r"""
WITH u0 AS (
  SELECT page_id, regexp_replace(url, '^(https?://[^/:]+)', '\1' || CASE page_id % 5 WHEN 1 THEN ':80' WHEN 2 THEN ':443' WHEN 3 THEN ':8080' ELSE '' END) AS url,
         printf('%08x', (page_id * 2654435761) % 4294967296) AS tag FROM pages
), u AS (
  SELECT page_id, CASE WHEN page_id % 50 = 49 THEN regexp_replace(url, '^https?', 'ftp') ELSE url END AS url, tag FROM u0
), raw AS (
  SELECT page_id, regexp_extract(url, '^(https?)://([^/:]+)(/.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/:]+)(/.*)$', 2) AS host, regexp_extract(url, '^(https?)://([^/:]+)(/.*)$', 3) AS path FROM pages
), dl0 AS (
  SELECT CASE page_id % 11 WHEN 0 THEN host WHEN 1 THEN '.' || regexp_replace(host, '^[^.]*\.', '') WHEN 2 THEN regexp_replace(host, '^[^.]*\.', '') WHEN 3 THEN host || ':8080'
           WHEN 4 THEN '.' || regexp_replace(host, '^[^.]*\.', '') || ':80' WHEN 5 THEN regexp_replace(host, '^[^.]*\.', '') || ':443' WHEN 6 THEN CASE WHEN host LIKE '%.org' THEN '.org' END
           WHEN 7 THEN CASE WHEN host LIKE '%.org' THEN 'org' END WHEN 8 THEN host || ':0' WHEN 9 THEN host END AS key,
         CASE WHEN page_id % 7 = 0 THEN '-' ELSE '+' END AS perm FROM raw
), dl AS (SELECT * FROM dl0 WHERE key IS NOT NULL), pl0 AS (
  SELECT CASE page_id % 13 WHEN 0 THEN scheme || '://' || host || path WHEN 1 THEN scheme || '://' || host || regexp_extract(path, '^(/[^/]*)', 1) WHEN 2 THEN scheme || '://' || host || '/'
           WHEN 3 THEN '//' || host || regexp_extract(path, '^(/[^/]*)', 1) WHEN 4 THEN '//' || host || ':80' || regexp_extract(path, '^(/[^/]*)', 1) WHEN 5 THEN '//' || host || ':443/'
           WHEN 6 THEN scheme || '://' || host || ':8080' || regexp_extract(path, '^(/[^/]*)', 1) WHEN 7 THEN scheme || '://' || host || left(path, 5) WHEN 8 THEN '//' || host || path WHEN 9 THEN host WHEN 10 THEN scheme || '://' || host || path WHEN 11 THEN '//' || host || path END AS key,
         CASE page_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '+' ELSE '*' END AS rng, CASE WHEN page_id % 2 = 0 THEN '-' ELSE '+' END AS perm FROM raw
), pl AS (SELECT * FROM pl0 WHERE key IS NOT NULL)
"""
