"""The filter's queries over the pages table, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.urls import canonical_url, suffix_candidates, tag_number, with_url_parts
from .operators import domain as d
from .operators import prefix as p
from .plans.engine import counters, passing_tags, verdicts
from .plans.inputs import INPUTS_SQL, derived
from .sources.text import counter_lines, read_domain_rules, read_prefix_rules, read_urls, shared_folder, write_tags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parsed URLs, rules and verdicts in SQL.
PLAN_SQL = (
    INPUTS_SQL
    + r""", m AS (
  SELECT *, regexp_extract(url, '(?s)^(https?)://([^/:]*)(?::([0-9]{1,5}))?(/.*)$', 1) AS s, regexp_extract(url, '(?s)^(https?)://([^/:]*)(?::([0-9]{1,5}))?(/.*)$', 2) AS h,
    TRY_CAST(nullif(regexp_extract(url, '(?s)^(https?)://([^/:]*)(?::([0-9]{1,5}))?(/.*)$', 3), '') AS INTEGER) AS pt, regexp_extract(url, '(?s)^(https?)://([^/:]*)(?::([0-9]{1,5}))?(/.*)$', 4) AS pa FROM u
), parsed AS (
  SELECT page_id, url, tag, (s <> '' AND coalesce(pt, 0) <= 65535) AS valid, CASE WHEN s <> '' AND coalesce(pt, 0) <= 65535 THEN s END AS scheme, CASE WHEN s <> '' AND coalesce(pt, 0) <= 65535 THEN h END AS host,
    CASE WHEN s <> '' AND coalesce(pt, 0) <= 65535 THEN coalesce(pt, CASE s WHEN 'https' THEN 443 ELSE 80 END) END AS port, CASE WHEN s <> '' AND coalesce(pt, 0) <= 65535 THEN pa END AS path FROM m
), dr0 AS (
  SELECT regexp_extract(key, '^(\.?[^:/]+?)(?::([0-9]{1,5}))?$', 1) AS host, TRY_CAST(nullif(regexp_extract(key, '^(\.?[^:/]+?)(?::([0-9]{1,5}))?$', 2), '') AS INTEGER) AS given, perm = '-' AS deny FROM dl WHERE perm IN ('+', '-')
), dr AS (
  SELECT host, coalesce(given, 0) AS port, max(deny) AS deny FROM dr0 WHERE host <> '' AND (given IS NULL OR given BETWEEN 1 AND 65535) GROUP BY 1, 2
), pr0 AS (
  SELECT regexp_extract(key, '(?s)^(?:(https?):)?//([^/:]*)(?::([0-9]{1,5}))?(/.*)?$', 1) AS s, regexp_extract(key, '(?s)^(?:(https?):)?//([^/:]*)(?::([0-9]{1,5}))?(/.*)?$', 2) AS host,
    TRY_CAST(nullif(regexp_extract(key, '(?s)^(?:(https?):)?//([^/:]*)(?::([0-9]{1,5}))?(/.*)?$', 3), '') AS INTEGER) AS given, regexp_extract(key, '(?s)^(?:(https?):)?//([^/:]*)(?::([0-9]{1,5}))?(/.*)?$', 4) AS prefix,
    rng, perm = '-' AS deny FROM pl WHERE rng IN ('=', '+', '*') AND perm IN ('+', '-')
), pe AS (
  SELECT z.scheme, host, coalesce(given, CASE z.scheme WHEN 'https' THEN 443 ELSE 80 END) AS port, prefix, rng, deny FROM pr0, (VALUES ('http'), ('https')) z(scheme)
  WHERE host <> '' AND (given IS NULL OR given BETWEEN 1 AND 65535) AND (s = '' OR s = z.scheme)
), pr AS (
  SELECT scheme, host, port, prefix, rng, max(deny) AS deny FROM pe GROUP BY ALL
), au AS (SELECT DISTINCT host, port FROM parsed WHERE valid), cand AS (
  SELECT host, port, candidate FROM (
    SELECT host, port, host AS candidate FROM au
    UNION ALL SELECT host, port, array_to_string(string_split(host, '.')[i:], '.') FROM au, unnest(range(2, len(string_split(host, '.')) + 1)) t(i)
    UNION ALL SELECT host, port, '.' || array_to_string(string_split(host, '.')[i:], '.') FROM au, unnest(range(2, len(string_split(host, '.')) + 1)) t(i))
), dm AS (
  SELECT c.host, c.port, r.host AS rule_host, r.port AS rule_port, r.deny FROM cand c JOIN dr r ON c.candidate = r.host AND r.port IN (0, c.port)
), dv AS (
  SELECT host, port, deny AS domain_deny FROM (SELECT *, row_number() OVER (PARTITION BY host, port ORDER BY (rule_port > 0) DESC, strlen(rule_host) DESC, deny DESC) AS rn FROM dm) WHERE rn = 1
), staged AS (
  SELECT x.*, dv.domain_deny FROM parsed x LEFT JOIN dv ON x.host = dv.host AND x.port = dv.port
), pm0 AS (
  SELECT DISTINCT scheme, host, port, path FROM staged WHERE valid AND NOT coalesce(domain_deny, false)
), pm AS (
  SELECT k.scheme, k.host, k.port, k.path, r.prefix, r.rng, r.deny FROM pm0 k JOIN pr r ON k.scheme = r.scheme AND k.host = r.host AND k.port = r.port AND starts_with(k.path, r.prefix)
    AND (r.rng = '*' OR (r.rng = '=' AND k.path = r.prefix) OR (r.rng = '+' AND k.path <> r.prefix))
), pv AS (
  SELECT scheme, host, port, path, deny AS prefix_deny FROM (SELECT *, row_number() OVER (PARTITION BY scheme, host, port, path ORDER BY strlen(prefix) DESC, (rng <> '*') DESC, deny DESC) AS rn FROM pm) WHERE rn = 1
), judged AS (
  SELECT s.*, pv.prefix_deny, CASE WHEN valid THEN NOT (coalesce(domain_deny, false) OR coalesce(prefix_deny, false)) END AS passes, valid AND domain_deny IS NULL AND prefix_deny IS NULL AS miss
  FROM staged s LEFT JOIN pv ON NOT coalesce(s.domain_deny, false) AND s.scheme = pv.scheme AND s.host = pv.host AND s.port = pv.port AND s.path = pv.path
)
"""
)


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL after PLAN_SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = PLAN_SQL + sql
        return f

    return register


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url_parts(derived(spark, sf_dir).urls)


def _domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.parse_domain_rules(derived(spark, sf_dir).domain_rules)


def _prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.parse_prefix_rules(derived(spark, sf_dir).prefix_rules)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(*derived(spark, sf_dir))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = d.with_domain_verdict(_parsed(spark, sf_dir), _domain_rules(spark, sf_dir))
    return staged.filter(F.col("valid") & ~F.coalesce("domain_deny", F.lit(False)))


@query("SELECT pass, hit, miss, invalid, pass_xor, hit_xor FROM (SELECT count_if(passes)::BIGINT AS pass, count_if(NOT passes)::BIGINT AS hit, count_if(miss)::BIGINT AS miss, count_if(NOT valid)::BIGINT AS invalid, printf('%08x', coalesce(bit_xor(CASE WHEN passes THEN ('0x' || tag)::BIGINT END), 0)) AS pass_xor, printf('%08x', coalesce(bit_xor(CASE WHEN NOT passes THEN ('0x' || tag)::BIGINT END), 0)) AS hit_xor FROM judged)")
def filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(_judged(spark, sf_dir))


@query("SELECT page_id, valid, scheme, host, port, path FROM parsed")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", "valid", "scheme", "host", "port", "path")


@query("SELECT page_id, scheme || '://' || host || CASE WHEN port = CASE scheme WHEN 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || port END || path AS canonical FROM parsed WHERE valid")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).filter("valid").select("page_id", canonical_url(*map(F.col, ("scheme", "host", "port", "path"))).alias("canonical"))


@query("SELECT page_id, ('0x' || tag)::BIGINT AS tag_num, printf('%08x', ('0x' || tag)::BIGINT) AS tag_hex FROM u")
def tag_number_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = tag_number(F.col("tag"))
    return derived(spark, sf_dir).urls.select("page_id", number.alias("tag_num"), F.format_string("%08x", number).alias("tag_hex"))


@query("SELECT host, port, deny FROM dr")
def domain_rules_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain_rules(spark, sf_dir)


@query("SELECT host, port, deny FROM (SELECT host, port, max(deny) AS deny FROM (SELECT * FROM dr UNION ALL SELECT '.' || host, port, NOT deny FROM dr WHERE NOT starts_with(host, '.') UNION ALL SELECT * FROM dr) GROUP BY ALL)")
def domain_rules_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived(spark, sf_dir).domain_rules
    other = _domain_rules(spark, sf_dir).filter("not startswith(host, '.')")
    key = F.concat(F.lit("."), "host", F.when(F.col("port") > 0, F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise(""))
    return d.parse_domain_rules(lines.unionByName(other.select(key.alias("key"), F.when(F.col("deny"), "+").otherwise("-").alias("perm"))).unionByName(lines))


@query("SELECT scheme, host, port, prefix, rng, deny FROM pe")
def prefix_rules_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.expand_prefix_rules(derived(spark, sf_dir).prefix_rules)


@query("SELECT scheme, host, port, prefix, rng, deny FROM pr")
def prefix_rules_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefix_rules(spark, sf_dir)


@query("SELECT host, port, candidate FROM cand")
def domain_suffix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.authorities(_parsed(spark, sf_dir)).select("host", "port", F.explode(suffix_candidates(F.col("host"))).alias("candidate"))


@query("SELECT host, port, rule_host, deny FROM dm WHERE rule_port > 0")
def domain_match_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.domain_matches(d.authorities(_parsed(spark, sf_dir)), _domain_rules(spark, sf_dir).filter("port > 0"))
    return found.select("host", "port", "rule_host", "deny")


@query("SELECT host, port, rule_host, deny FROM dm WHERE rule_port = 0")
def domain_match_noport(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.domain_matches(d.authorities(_parsed(spark, sf_dir)), _domain_rules(spark, sf_dir).filter("port = 0"))
    return found.select("host", "port", "rule_host", "deny")


@query("SELECT page_id, domain_deny FROM staged WHERE valid")
def domain_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.with_domain_verdict(_parsed(spark, sf_dir), _domain_rules(spark, sf_dir)).filter("valid").select("page_id", "domain_deny")


@query("SELECT page_id, url, tag FROM staged WHERE valid AND NOT coalesce(domain_deny, false)")
def domain_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select("page_id", "url", "tag")


def _prefix_match(rng: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = p.prefix_matches(_survivors(spark, sf_dir), _prefix_rules(spark, sf_dir).filter(F.col("rng") == rng))
        return found.select("scheme", "host", "port", "path", "prefix", "deny")

    return run


for _name, _rng in (("prefix_match_exact", "="), ("prefix_match_longer", "+"), ("prefix_match_star", "*")):
    QUERIES[_name] = _prefix_match(_rng)
    SQL[_name] = PLAN_SQL + f"SELECT scheme, host, port, path, prefix, deny FROM pm WHERE rng = '{_rng}'"


@query("SELECT page_id, pv.prefix_deny FROM staged s LEFT JOIN pv ON s.scheme = pv.scheme AND s.host = pv.host AND s.port = pv.port AND s.path = pv.path WHERE valid AND NOT coalesce(domain_deny, false)")
def prefix_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.with_prefix_verdict(_survivors(spark, sf_dir), _prefix_rules(spark, sf_dir)).select("page_id", "prefix_deny")


@query("SELECT page_id, valid, domain_deny, prefix_deny, passes, miss FROM judged")
def url_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("page_id", "valid", "domain_deny", "prefix_deny", "passes", "miss")


@query("SELECT tag FROM judged WHERE passes")
def passing_tags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passing_tags(_judged(spark, sf_dir))


@query("SELECT CASE WHEN coalesce(domain_deny, false) THEN 'domain' ELSE 'prefix' END AS stage, count(*)::BIGINT AS rejected, printf('%08x', bit_xor(('0x' || tag)::BIGINT)) AS tag_xor FROM judged WHERE NOT passes GROUP BY 1")
def rejected_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.coalesce("domain_deny", F.lit(False)), "domain").otherwise("prefix")
    return _judged(spark, sf_dir).filter("not passes").groupBy(stage.alias("stage")).agg(F.count("*").alias("rejected"), F.format_string("%08x", F.bit_xor(tag_number(F.col("tag")))).alias("tag_xor"))


@query("SELECT page_id, url FROM judged WHERE miss")
def missed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("miss").select("page_id", "url")


@query("SELECT DISTINCT r.host, r.port, r.deny FROM dr r JOIN cand c ON r.host = c.candidate")
def needed_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.needed_domain_rules(_parsed(spark, sf_dir), _domain_rules(spark, sf_dir))


@query("SELECT r.scheme, r.host, r.port, r.prefix, r.rng, r.deny FROM pr r WHERE EXISTS (SELECT 1 FROM parsed x WHERE x.scheme = r.scheme AND x.host = r.host AND x.port = r.port)")
def needed_prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.needed_prefix_rules(_parsed(spark, sf_dir), _prefix_rules(spark, sf_dir))


@query("SELECT CASE WHEN starts_with(host, 'www.') THEN 'www.' || substr(host, 5, 1) ELSE left(host, 2) END AS bucket, count(*)::BIGINT AS n, count(DISTINCT host)::BIGINT AS hosts FROM parsed WHERE valid GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.startswith("host", F.lit("www.")), F.concat(F.lit("www."), F.substring("host", 5, 1))).otherwise(F.expr("left(host, 2)"))
    return _parsed(spark, sf_dir).filter("valid").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


@query("SELECT port, count(*)::BIGINT AS rules, (sum(count(*)) OVER (ORDER BY port) - count(*))::BIGINT AS first_rule FROM dr GROUP BY port")
def port_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # At most 65,536 ports: the running sum is over few rows.
    counted = _domain_rules(spark, sf_dir).groupBy("port").agg(F.count("*").alias("rules"))
    return counted.withColumn("first_rule", (F.sum("rules").over(Window.orderBy("port")) - F.col("rules")).cast("bigint"))


@query("SELECT a.scheme, a.host, a.port, a.prefix, count(b.prefix)::BIGINT AS depth FROM (SELECT DISTINCT scheme, host, port, prefix FROM pr) a LEFT JOIN (SELECT DISTINCT scheme, host, port, prefix FROM pr) b ON a.scheme = b.scheme AND a.host = b.host AND a.port = b.port AND a.prefix <> b.prefix AND starts_with(a.prefix, b.prefix) GROUP BY ALL")
def prefix_chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.prefix_chain_depth(_prefix_rules(spark, sf_dir))


@query("SELECT a.host, a.port, count(b.host)::BIGINT AS depth FROM dr a LEFT JOIN dr b ON a.port = b.port AND strlen(b.host) < strlen(a.host) AND (suffix(a.host, CASE WHEN starts_with(b.host, '.') THEN b.host ELSE '.' || b.host END) OR a.host = '.' || b.host) GROUP BY ALL")
def domain_chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.domain_chain_depth(_domain_rules(spark, sf_dir))


@query("SELECT host, port, deny, row_number() OVER (PARTITION BY port ORDER BY reverse(host), strlen(host), deny DESC)::BIGINT AS place FROM dr")
def rules_sorted_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("port").orderBy(F.reverse("host"), F.octet_length("host"), F.col("deny").desc())
    return _domain_rules(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("bigint"))


@query("SELECT scheme, host, port, prefix, rng, deny, row_number() OVER (PARTITION BY scheme, host, port ORDER BY prefix, strlen(prefix), CASE rng WHEN '=' THEN 2 WHEN '+' THEN 1 ELSE 0 END, deny DESC)::BIGINT AS place FROM pr")
def rules_sorted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("rng") == "=", 2).when(F.col("rng") == "+", 1).otherwise(0)
    order = Window.partitionBy("scheme", "host", "port").orderBy("prefix", F.octet_length("prefix"), rank, F.col("deny").desc())
    return _prefix_rules(spark, sf_dir).withColumn("place", F.row_number().over(order).cast("bigint"))


for _old, _new in (("tag_number_query", "tag_number"), ("passing_tags_query", "passing_tags")):
    QUERIES[_new], SQL[_new] = QUERIES.pop(_old), SQL.pop(_old)


@query("SELECT value FROM (SELECT tag AS value FROM judged WHERE passes UNION ALL SELECT unnest([count_if(passes)::VARCHAR, count_if(NOT passes)::VARCHAR, count_if(miss)::VARCHAR, printf('%08x', coalesce(bit_xor(CASE WHEN passes THEN ('0x' || tag)::BIGINT END), 0)), printf('%08x', coalesce(bit_xor(CASE WHEN NOT passes THEN ('0x' || tag)::BIGINT END), 0))]) AS value FROM judged)")
def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter over text files: rules and URLs are written as text, read by the readers, judged, and the tags' file is read again, with the trailer's lines."""
    base = f"{shared_folder(spark)}/filter-{uuid.uuid4()}"
    for name, frame in derived(spark, sf_dir)._asdict().items():
        frame.select(F.concat_ws("\t", *[c for c in frame.columns if c != "page_id"])).write.text(f"{base}/{name}")
    judged = verdicts(read_urls(spark, f"{base}/urls"), read_domain_rules(spark, f"{base}/domain_rules"), read_prefix_rules(spark, f"{base}/prefix_rules"))
    write_tags(passing_tags(judged), f"{base}/tags")
    return spark.read.text(f"{base}/tags").unionByName(counter_lines(counters(judged)))
