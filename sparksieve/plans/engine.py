"""The filter: domain stage, then prefix stage on what it leaves, then tags and counters.

There is one plan.  Which joins are broadcast and which are shuffled, and how hot keys are split, is left to
Catalyst and adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import hex8, tag_number, with_url_parts
from ..operators.domain import best_domain_match, domain_matches, parse_domain_rules, spread
from ..operators.prefix import AUTHORITY, best_prefix_match, key_matches, parse_prefix_rules, path_keys, rules_of


def denied(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def verdicts(urls: DataFrame, domain_rules: DataFrame, prefix_rules: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    """(url, tag, ...) and rule lines -> the URLs with parts, domain_deny, prefix_deny, passes, miss.

    A URL that the domain stage denies isn't looked up in the prefix stage: its prefix_deny is null.  passes is
    null for URLs that aren't valid; miss is true for those that no stage matched.

    Both stages judge distinct (scheme, host, port, path) keys, which are persisted (and added to `kept`, for callers
    that want to let go of them); the URLs are read twice, for the keys and for the result, and shuffled by key once.
    Prefix rules are first reduced to the authorities that the domain stage leaves.
    """
    parsed = with_url_parts(urls)
    keys = path_keys(parsed).persist()
    if kept is not None:
        kept.append(keys)
    domain = best_domain_match(domain_matches(keys.select("host", "port").distinct(), parse_domain_rules(domain_rules)))
    staged = keys.join(domain, ["host", "port"], "left")
    alive = staged.filter(~denied("domain_deny")).select(*AUTHORITY, "path")
    rules = rules_of(alive, parse_prefix_rules(prefix_rules))
    judged = staged.join(best_prefix_match(key_matches(alive, rules)), [*AUTHORITY, "path"], "left").withColumnsRenamed({k: f"_{k}" for k in (*AUTHORITY, "path")})
    same = (spread(F.col("host"), F.col("url")) == F.col("_host")) & (F.col("scheme") == F.col("_scheme")) & (F.col("port") == F.col("_port")) & (F.col("path") == F.col("_path"))
    done = parsed.join(judged, same, "left").drop("_host", "_scheme", "_port", "_path")
    rejected = denied("domain_deny") | denied("prefix_deny")
    return done.withColumns({"passes": F.when(F.col("valid"), ~rejected), "miss": F.col("valid") & F.col("domain_deny").isNull() & F.col("prefix_deny").isNull()})


def counters(judged: DataFrame) -> DataFrame:
    """One row: pass, hit, miss and invalid counts, and XOR checksums of passing and rejected tags (0 of none)."""
    number = tag_number(F.col("tag"))
    count = lambda c: F.count_if(c).cast("bigint")
    xor = lambda c: hex8(F.coalesce(F.bit_xor(F.when(c, number)), F.lit(0).cast("bigint")))
    passes = F.col("passes")
    return judged.agg(
        count(passes).alias("pass"), count(~passes).alias("hit"), count(F.col("miss")).alias("miss"), count(~F.col("valid")).alias("invalid"), xor(passes).alias("pass_xor"), xor(~passes).alias("hit_xor")
    )


def passing_tags(judged: DataFrame) -> DataFrame:
    return judged.filter("passes").select("tag")
