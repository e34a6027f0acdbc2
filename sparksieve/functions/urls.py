"""URL parsing and canonical form, as Catalyst expressions.

A URL is `scheme://host[:port]path` with scheme http or https; the path starts at the first `/` after the
authority and keeps queries and fragments.  Its canonical form is the tuple (scheme, host, effective port,
path): the scheme's default port (80, 443) when none is given, so an explicit default port equals none, and
the other scheme's default stays as it is.  Nothing is lower-cased, decoded or normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_PATTERN = r"(?s)^(https?)://([^/:]*)(?::([0-9]{1,5}))?(/.*)$"
MAX_PORT = 65535


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))


def explicit_port(text: Column) -> Column:
    """The port in digits as an int, or null where the text is empty."""
    return F.nullif(text, F.lit("")).try_cast("int")


def with_url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds valid, scheme, host, port (effective), path; the parts are null where the URL isn't valid."""
    # One lambda holds the whole parse, so a plan that pushes filters or keys through it repeats a name, not the patterns.
    groups = F.transform(F.array(F.col(url)), lambda u: F.struct(*[F.regexp_extract(u, URL_PATTERN, i).alias(n) for i, n in enumerate(("scheme", "host", "port", "path"), 1)]))
    ported = F.transform(groups, lambda g: g.withField("port", F.coalesce(explicit_port(g["port"]), default_port(g["scheme"]))))
    parsed = F.get(F.filter(ported, lambda g: (g["scheme"] != "") & (g["port"] <= MAX_PORT)), 0)
    out = urls.withColumn("_parsed", parsed)
    return out.withColumns({"valid": F.col("_parsed").isNotNull(), **{c: F.col("_parsed")[c] for c in ("scheme", "host", "port", "path")}}).drop("_parsed")


def canonical_url(scheme: Column, host: Column, port: Column, path: Column) -> Column:
    """The URL text without its scheme's default port."""
    return F.concat(scheme, F.lit("://"), host, F.when(port == default_port(scheme), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))), path)


def tag_number(tag: Column) -> Column:
    """An 8-digit hexadecimal tag as a number; null where it isn't one."""
    return F.when(tag.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(tag, 16, 10)).cast("bigint")


def hex8(number: Column) -> Column:
    return F.format_string("%08x", number)


def suffix_candidates(host: Column) -> Column:
    """Keys that could match a host: itself, and from each later label on, with a leading dot and without."""
    labels = F.split(host, r"\.", -1)
    later = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i > 1)
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.concat(F.array(host), F.transform(later, lambda i: F.concat(F.lit("."), tail(i))), F.transform(later, tail))
