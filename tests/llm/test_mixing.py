import re

from sparksieve.llm import mixing
from sparksieve.llm.mixing import mix, mix_documents, source_targets

SCHEMA = "doc_id long, text string, source string, size string, target int"


def targets(sizes, weights, cap):
    """Reshares what is above a cap until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def rows():
    out = []
    for i in range(3000):
        source = ["big", "Ünder", "a", "B", None, "tiny", "zero"][0 if i % 3 else i % 7]
        text = {"tiny": "one", "zero": " "}.get(source, "w " * (1 + i * 7919 % 50))
        out.append((i, text, source, "s", 1))
    return out + [(3000, None, "a", "s", 1), (3001, "", "a", "s", 1), (None, "x y", "a", "s", 1), (5, "x y", "a", "s", 1), (5, "x y", "a", "s", 1), (3002, "long " * 4000, "B", "s", 1)]


def test_mix(spark):
    data = rows()
    got = mix_documents(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes, (5, 2, 1), 3)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(data)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for s in sizes:
        largest = max(count(t) for _, t, x, *_ in data if x == s)
        assert abs(taken[s] - want[s]) <= largest, s
    again = mix_documents(spark.createDataFrame(data[::-1], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_many_sources(spark, monkeypatch):
    """Tables of sources that are too large to broadcast are joined by salted keys, with the same result."""
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = sorted(map(tuple, mix_documents(frame).collect()), key=repr)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    got = mix_documents(frame)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, got.collect()), key=repr) == want


def test_budgets_nest(spark):
    items = spark.createDataFrame([(i, s, 10) for i in range(500) for s in "ab"], "doc_id long, source string, size long")
    less = {(r.doc_id, r.source): r.times for r in mix(items, (3, 1)).collect()}
    more = {(r.doc_id, r.source): r.times for r in mix(items, (4, 1)).collect()}
    assert all(more[k] >= less[k] for k in less if k[1] == "a")


def test_targets(spark):
    for sizes, weights in (({"a": 10, "b": 1000, "c": 5}, (5, 2, 1)), ({"a": 0, "b": 0}, (5, 2, 1)), ({"a": 1, "b": 1, "c": 1, "d": 997}, (5, 2, 1)), ({"x": 7}, (1,))):
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights, 3.0).collect()
        want = targets(sizes, weights, 3.0)
        assert all(abs(r.target - want[r.source]) < 1e-9 * max(1, want[r.source]) for r in got) and len(got) == len(sizes)


def test_empty_table(spark):
    assert mix_documents(spark.createDataFrame([], SCHEMA)).collect() == []
