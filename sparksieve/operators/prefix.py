"""Prefix rules: parsing, and the longest-prefix join.

A rule's key is `scheme://host[:port]path` or `//host[:port]path` for both schemes; its range says which URLs
with that prefix it takes: `=` the same path, `+` longer ones, `*` both.  Among matches the longest path wins,
then `=` or `+` over `*`, then deny.  Both schemes are expanded first and missing ports filled in after, so
`//h:80/` means port 80 of http and of https; rules are made distinct after that.

The longest-prefix join is an equi-join too.  A URL path is cut to the lengths that prefixes of its authority have,
and (scheme, host, port, cut path) is joined to the rules.  Lengths are listed by authority and first HEAD characters
(shorter prefixes, of at most HEAD lengths, under none), so a path is cut for the rules that begin as it does, not for
all lengths that an authority with very many rules has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import MAX_PORT, default_port, explicit_port

KEY_PATTERN = r"(?s)^(?:(https?):)?//([^/:]*)(?::([0-9]{1,5}))?(/.*)?$"
AUTHORITY = ["scheme", "host", "port"]
#: Characters of a prefix by which its authority's lengths are told apart.
HEAD = 8


def expand_prefix_rules(lines: DataFrame) -> DataFrame:
    """(key, rng, perm) -> scheme, host, port, prefix, rng, deny; one row for each scheme; other lines are left out."""
    part = lambda i: F.regexp_extract("key", KEY_PATTERN, i)
    rules = lines.filter(F.col("rng").isin("=", "+", "*") & F.col("perm").isin("+", "-") & F.col("key").rlike(KEY_PATTERN)).select(
        part(1).alias("s"), part(2).alias("host"), explicit_port(part(3)).alias("given"), part(4).alias("prefix"), "rng", (F.col("perm") == "-").alias("deny")
    )
    valid = rules.filter((F.col("host") != "") & (F.col("given").isNull() | F.col("given").between(1, MAX_PORT)))
    schemes = F.when(F.col("s") == "", F.array(F.lit("http"), F.lit("https"))).otherwise(F.array("s"))
    both = valid.withColumn("scheme", F.explode(schemes))
    return both.select("scheme", "host", F.coalesce("given", default_port(F.col("scheme"))).cast("int").alias("port"), "prefix", "rng", "deny")


def distinct_prefix_rules(expanded: DataFrame) -> DataFrame:
    """Deny wins among equal (scheme, host, port, prefix, range)."""
    return expanded.groupBy(*AUTHORITY, "prefix", "rng").agg(F.max("deny").alias("deny"))


def parse_prefix_rules(lines: DataFrame) -> DataFrame:
    return distinct_prefix_rules(expand_prefix_rules(lines))


def path_keys(urls: DataFrame) -> DataFrame:
    """Distinct (scheme, host, port, path) of the valid URLs."""
    return urls.filter("valid").select(*AUTHORITY, "path").distinct()


def prefix_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that matches a distinct (scheme, host, port, path): with prefix, rng, deny."""
    return key_matches(path_keys(urls), rules)


def key_matches(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """prefix_matches() of path_keys()."""
    size = F.length("prefix")
    lengths = rules.groupBy(*AUTHORITY, F.when(size >= HEAD, F.expr(f"left(prefix, {HEAD})")).otherwise("").alias("head")).agg(F.collect_set(size).alias("lengths"))
    heads = F.when(F.length("path") >= HEAD, F.array(F.lit(""), F.expr(f"left(path, {HEAD})"))).otherwise(F.array(F.lit("")))
    cut = keys.withColumn("head", F.explode(heads)).join(lengths, [*AUTHORITY, "head"]).withColumn("size", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    cut = cut.select(*AUTHORITY, "path", F.expr("left(path, size)").alias("prefix"))
    found = cut.join(rules, [*AUTHORITY, "prefix"])
    fits = (F.col("rng") == "*") | ((F.col("rng") == "=") & (F.col("path") == F.col("prefix"))) | ((F.col("rng") == "+") & (F.col("path") != F.col("prefix")))
    return found.filter(fits).select(*AUTHORITY, "path", "prefix", "rng", "deny")


def best_prefix_match(matches: DataFrame) -> DataFrame:
    """(scheme, host, port, path, prefix_deny) of the URLs that have a match."""
    rank = F.struct(F.octet_length("prefix").alias("size"), (F.col("rng") != "*").alias("narrow"), F.col("deny"))
    return matches.groupBy(*AUTHORITY, "path").agg(F.max(rank)["deny"].alias("prefix_deny"))


def with_prefix_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds prefix_deny: true, false, or null where no rule matches."""
    return urls.join(best_prefix_match(prefix_matches(urls, rules)), [*AUTHORITY, "path"], "left")


def needed_prefix_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of authorities that some URL has."""
    return rules_of(urls.filter("valid"), rules)


def rules_of(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the authorities that stand in keys."""
    return rules.join(keys.select(*AUTHORITY).distinct(), AUTHORITY, "left_semi")


def prefix_chain_depth(rules: DataFrame) -> DataFrame:
    """How many distinct prefixes of the same authority are proper prefixes of each rule's (scheme, host, port, prefix, depth)."""
    keys = rules.select(*AUTHORITY, "prefix").distinct()
    lengths = keys.groupBy(*AUTHORITY).agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = keys.join(lengths, AUTHORITY).withColumn("size", F.explode(F.filter("lengths", lambda n: n < F.length("prefix"))))
    cut = cut.select(*AUTHORITY, F.col("prefix").alias("of"), F.expr("left(prefix, size)").alias("prefix"))
    depth = cut.join(keys, [*AUTHORITY, "prefix"], "left_semi").groupBy(*AUTHORITY, F.col("of").alias("prefix")).agg(F.count("*").alias("n"))
    return keys.join(depth, [*AUTHORITY, "prefix"], "left").select(*AUTHORITY, "prefix", F.coalesce("n", F.lit(0)).cast("bigint").alias("depth"))
