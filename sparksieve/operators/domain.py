"""Domain rules: parsing, and the longest-suffix join.

A rule's key is `host[:port]`, where the host may have a leading dot (subdomains only) or be a single label.
It matches a URL if its host is one of the URL host's suffix candidates and its port, if it has one, is the
URL's effective port.  Among matches, one with a port beats those without, then the longer key, then deny.

The longest-suffix join is an equi-join: candidates of the distinct (host, port) pairs are exploded and joined
to the rules, and the best match is one struct maximum.  Pairs are distinct first, so a host with very many
URLs costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import MAX_PORT, explicit_port, suffix_candidates

KEY_PATTERN = r"^(\.?[^:/]+?)(?::([0-9]{1,5}))?$"


def parse_domain_rules(lines: DataFrame) -> DataFrame:
    """(key, perm) -> distinct (host, port, deny): port 0 is any, deny wins among equal keys; other lines are left out."""
    port = explicit_port(F.regexp_extract("key", KEY_PATTERN, 2))
    rules = lines.filter(F.col("perm").isin("+", "-")).select(F.regexp_extract("key", KEY_PATTERN, 1).alias("host"), port.alias("given"), (F.col("perm") == "-").alias("deny"))
    valid = rules.filter((F.col("host") != "") & (F.col("given").isNull() | F.col("given").between(1, MAX_PORT)))
    return valid.groupBy("host", F.coalesce("given", F.lit(0)).cast("int").alias("port")).agg(F.max("deny").alias("deny"))


def authorities(urls: DataFrame) -> DataFrame:
    """Distinct (host, port) of the valid URLs."""
    return urls.filter("valid").select("host", "port").distinct()


def domain_matches(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that matches a (host, port): host, port, rule_host, rule_port, deny."""
    candidates = pairs.select("host", "port", F.explode(suffix_candidates(F.col("host"))).alias("candidate"))
    r = rules.select(F.col("host").alias("rule_host"), F.col("port").alias("rule_port"), "deny")
    return candidates.join(r, (F.col("candidate") == F.col("rule_host")) & ((F.col("rule_port") == 0) | (F.col("rule_port") == F.col("port")))).drop("candidate")


def best_domain_match(matches: DataFrame) -> DataFrame:
    """(host, port, domain_deny) of the pairs that have a match."""
    rank = F.struct((F.col("rule_port") > 0).alias("has_port"), F.octet_length("rule_host").alias("size"), F.col("deny"))
    return matches.groupBy("host", "port").agg(F.max(rank)["deny"].alias("domain_deny"))


def with_domain_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds domain_deny: true, false, or null where no rule matches."""
    best = best_domain_match(domain_matches(authorities(urls), rules)).withColumnsRenamed({"host": "_host", "port": "_port"})
    return urls.join(best, (spread(F.col("host"), F.col("url")) == F.col("_host")) & (F.col("port") == F.col("_port")), "left").drop("_host", "_port")


def spread(key: Column, by: Column) -> Column:
    """A join key whose nulls become values that equal none (with a NUL in front), so that rows without a key don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\0"), by))


def needed_domain_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that some URL's host could use, whatever its port."""
    hosts = urls.filter("valid").select("host").distinct().select(F.explode(suffix_candidates(F.col("host"))).alias("host")).distinct()
    return rules.join(hosts, "host", "left_semi")


def domain_chain_depth(rules: DataFrame) -> DataFrame:
    """How many rules of the same port stand above each rule as suffixes of it (host, port, depth)."""
    host = F.regexp_replace("host", r"^\.", "")
    up = rules.select("host", "port", F.explode(F.array_distinct(F.concat(F.array("host"), suffix_candidates(host)))).alias("above")).filter("above <> host")
    up = up.filter(F.octet_length("above") < F.octet_length("host"))
    found = up.join(rules.select(F.col("host").alias("above"), F.col("port").alias("p")), ["above"]).filter("p = port")
    depth = found.groupBy("host", "port").agg(F.count("*").alias("n"))
    return rules.join(depth, ["host", "port"], "left").select("host", "port", F.coalesce("n", F.lit(0)).cast("bigint").alias("depth"))
