"""Worked cases of both stages.

The cases are generated: every pair of rules from a table of kinds, with opposite permissions, meets every URL of a small
family, and `by_hand` (a direct reading of the documented priorities) says what must come out.  A few cases with verdicts
written out guard the reading itself.
"""

from itertools import permutations, product

import pytest
from test_properties import by_hand

from sparksieve.plans.engine import counters, verdicts

# Kinds of domain rules for a URL whose host is HOST, and of prefix rules for its paths.
DOMAIN = ("HOST", ".HOST", "HOST:8443", ".kiosk-HOST", "HOST:80", "HOST:443")
HOSTS = ("HOST", "till.HOST", "a.till.HOST", "kiosk-HOST")
PORTS = ("", ":80", ":443", ":8443")
PREFIX = ("http://HOST/", "http://HOST/stall", "//HOST/st", "https://HOST/stall", "//HOST:443/", "http://HOST:8443/stall?")
PATHS = ("/", "/st", "/stall", "/stall?row=7", "/elsewhere#st")

# (domain rules, prefix rules, URL, passes, no rule matched)
WRITTEN = [
    ("ink.test:443 -; ink.test +", "", "http://ink.test:443/q", False, False),  # the port is compared, not the scheme
    (".ink.test -; pen.ink.test:80 +", "", "http://pen.ink.test/", True, False),
    (".ink.test -", "", "https://ink.test/", True, True),  # a leading dot takes subdomains only
    ("test -; .test +", "", "http://ink.test/", True, False),  # the longer key
    ("test -", "", "https://ink.test/", False, False),
    ("", "//ink.test:80/box * -", "https://ink.test:80/box/1", False, False),
    ("", "//ink.test:80/box * -", "https://ink.test/box/1", True, True),
    ("", "//ink.test/box * +; http://ink.test/box * -", "https://ink.test/box/1", True, False),
    ("", "//ink.test/box * -; http://ink.test/box + +", "https://ink.test/box/1", False, False),
    ("", "http://ink.test/box = -; http://ink.test/bo + +", "http://ink.test/box", False, False),
    ("ink.test -", "http://ink.test/ * +", "http://ink.test/box", False, False),  # what the first stage denies is gone
]


def cases():
    """(domain rules, prefix rules, URLs), each with a host of its own so that all run as one table."""
    n = 0

    def named(*texts):
        return [t.replace("HOST", f"m{n}.fair.test") for t in texts]

    for one, other in permutations(DOMAIN, 2):
        n += 1
        keys = named(one, other)
        yield list(zip(keys, "-+", strict=True)), [], named(*(f"{s}://{h}{p}/x" for s, h, p in product(("http", "https"), HOSTS, PORTS)))
    for one, other in permutations(PREFIX, 2):
        for rng in ("=+", "+*", "*="):
            n += 1
            keys = named(one, other)
            yield [], list(zip(keys, rng, "-+", strict=True)), named(*(f"{s}://HOST{p}{x}" for s, p, x in product(("http", "https"), ("", ":443", ":8443"), PATHS)))


def test_generated(spark):
    domain, prefix, want = [], [], {}
    for d, p, urls in cases():
        domain += d
        prefix += p
        for u in urls:
            want[u] = by_hand(u, d, p)
    rows = [(u, f"{i:08x}") for i, u in enumerate(want)]
    judged = verdicts(spark.createDataFrame(rows, "url string, tag string"), spark.createDataFrame(domain, "key string, perm string"), spark.createDataFrame(prefix, "key string, rng string, perm string")).collect()
    assert {r.url: (r.domain_deny, r.prefix_deny) for r in judged} == want and len(judged) == len(rows)
    assert len({w for w in want.values()}) >= 5  # both stages deny, allow and miss somewhere


@pytest.mark.parametrize("case", WRITTEN, ids=lambda c: c[2])
def test_written(spark, case):
    domain, prefix, url, passes, miss = case
    rules = lambda text, schema: spark.createDataFrame([r.split() for r in text.split(";") if r.strip()], schema)
    (row,) = verdicts(spark.createDataFrame([(url, "1")], "url string, tag string"), rules(domain, "key string, perm string"), rules(prefix, "key string, rng string, perm string")).collect()
    assert (row.passes, row.miss) == (passes, miss)


def test_counters(spark):
    urls = spark.createDataFrame([("http://a.b/x", "0000000f"), ("http://a.b/y", "ffffffff"), ("ftp://a.b/", "00000001"), ("https://q.r:70000/", "1"), ("http://c/", "000000f0"), ("http://c/", "000000f0")], "url string, tag string")
    domain = spark.createDataFrame([("a.b", "+"), ("bad key/", "-"), ("c:0", "-"), ("c", "?")], "key string, perm string")
    prefix = spark.createDataFrame([("http://a.b/y", "=", "-"), ("nothing", "*", "-")], "key string, rng string, perm string")
    row = counters(verdicts(urls, domain, prefix)).first().asDict()
    assert row == {"pass": 3, "hit": 1, "miss": 2, "invalid": 2, "pass_xor": "0000000f", "hit_xor": "ffffffff"}
    none = counters(verdicts(urls.limit(0), domain, prefix)).first().asDict()
    assert none == {"pass": 0, "hit": 0, "miss": 0, "invalid": 0, "pass_xor": "00000000", "hit_xor": "00000000"}
