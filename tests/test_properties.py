"""Random small inputs against a direct reading of the rules, and relations between runs."""

import random

from sparksieve.__main__ import main
from sparksieve.functions.urls import with_url_parts
from sparksieve.operators import prefix as p
from sparksieve.plans.engine import counters, verdicts
from sparksieve.sources.text import read_urls
from sparksieve.streaming.urls import start_filter, total_counters

DEFAULT = {"http": 80, "https": 443}


def split_url(url):
    scheme, rest = url.split("://")
    authority, path = rest[: rest.index("/")], rest[rest.index("/") :]
    host, _, port = authority.partition(":")
    return scheme, host, int(port) if port else DEFAULT[scheme], path


def by_hand(url, domain, prefix):
    scheme, host, port, path = split_url(url)
    found = []
    for key, perm in domain:
        h, _, p = key.partition(":")
        ends = host == h or (host.endswith(h) if h.startswith(".") else host.endswith("." + h))
        if ends and (not p or int(p) == port):
            found.append((bool(p), len(h), perm == "-"))
    domain_deny = max(found)[2] if found else None
    if domain_deny:
        return True, None
    found = []
    for key, rng, perm in prefix:
        own = [key] if "://" in key else [f"{s}:{key}" for s in DEFAULT]
        for k in own:
            s, h, p, x = split_url(k)
            if (s, h, p) == (scheme, host, port) and path.startswith(x) and (rng == "*" or (rng == "=") == (path == x)):
                found.append((len(x), rng != "*", perm == "-"))
    return domain_deny, max(found)[2] if found else None


def made(seed, n=150):
    r = random.Random(seed)
    host = lambda: ".".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    port = lambda: r.choice(["", "", ":80", ":443", ":8080"])
    path = lambda: "/" + "".join(r.choice("x/?") for _ in range(r.randint(0, 3)))
    urls = [(f"{r.choice(['http', 'https'])}://{host()}{port()}{path()}", f"{r.getrandbits(32):08x}") for _ in range(n)]
    domain = [(r.choice(["", "."]) + host() + port(), r.choice("+-")) for _ in range(10)]
    prefix = [(r.choice(["http:", "https:", ""]) + "//" + host() + port() + path(), r.choice("=+*"), r.choice("+-")) for _ in range(120)]
    return urls, domain, prefix


def frames(spark, urls, domain, prefix):
    return spark.createDataFrame(urls, "url string, tag string"), spark.createDataFrame(domain, "key string, perm string"), spark.createDataFrame(prefix, "key string, rng string, perm string")


def test_against_direct_reading(spark):
    for seed in range(3):
        urls, domain, prefix = made(seed)
        got = verdicts(*frames(spark, urls, domain, prefix)).collect()
        assert sorted((r.url, r.tag, r.domain_deny, r.prefix_deny) for r in got) == sorted(((u, t, *by_hand(u, domain, prefix)) for u, t in urls), key=lambda x: x[:2])


def test_relations(spark):
    urls, domain, prefix = made(7)
    once = counters(verdicts(*frames(spark, urls, domain, prefix))).first()
    shuffled = counters(verdicts(*frames(spark, urls[::-1], (domain * 2)[::-1], prefix[::-1] * 2))).first()
    assert once == shuffled
    twice = counters(verdicts(*frames(spark, urls * 2, domain, prefix))).first()
    assert (twice["pass"], twice.hit, twice.miss) == (2 * once["pass"], 2 * once.hit, 2 * once.miss)
    assert twice.pass_xor == twice.hit_xor == "00000000"


def test_files_and_stream(spark, tmp_path, capsys):
    urls, domain, prefix = made(9)
    for name, rows in (("d", domain), ("p", prefix)):
        (tmp_path / name).write_text("\n".join("\t".join(r) for r in rows))
    (tmp_path / "u").mkdir()
    for i in range(3):
        (tmp_path / "u" / f"{i}.txt").write_text("".join(f"{u}\t{t}\n" for u, t in urls[i::3]))
    plain = counters(verdicts(*frames(spark, urls, domain, prefix))).first()
    assert main([*(str(tmp_path / x) for x in ("d", "p", "u", "out"))]) == 0
    assert capsys.readouterr().out.split() == [str(plain[c]) for c in ("pass", "hit", "miss", "pass_xor", "hit_xor")]
    assert spark.read.text(str(tmp_path / "out/tags")).count() == plain["pass"]

    from sparksieve.sources.text import read_domain_rules, read_prefix_rules, url_columns

    stream = url_columns(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "u")))
    run = start_filter(stream, read_domain_rules(spark, str(tmp_path / "d")), read_prefix_rules(spark, str(tmp_path / "p")), str(tmp_path / "tags"), str(tmp_path / "counts"), str(tmp_path / "state"))
    run.awaitTermination()
    assert total_counters(spark.read.parquet(str(tmp_path / "counts"))).first() == plain
    assert spark.read.text(str(tmp_path / "tags")).count() == plain["pass"]
    assert read_urls(spark, str(tmp_path / "u")).count() == len(urls)


def test_plan(spark):
    """URLs are read for the keys and for the result only; rows without a key are spread; prefixes are cut for rules that begin alike."""
    urls, domain, prefix = frames(spark, *made(3))
    kept = []
    plan = verdicts(urls, domain, prefix, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 1 and plan.count("regexp_extract(u") <= 8 and len(kept) == 1
    many = [(f"http://a.b/long/path/{i:04}" + "x" * i, "*", "-") for i in range(200)]
    keys = p.path_keys(with_url_parts(spark.createDataFrame([("http://a.b/other/" + "y" * 500, "1"), ("http://a.b/long/path/0003xxxz", "2")], "url string, tag string")))
    found = p.key_matches(keys, p.parse_prefix_rules(spark.createDataFrame(many, "key string, rng string, perm string"))).collect()
    assert [(r.path, r.prefix) for r in found] == [("/long/path/0003xxxz", "/long/path/0003xxx")]
    for k in kept:
        k.unpersist()
