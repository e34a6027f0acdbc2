import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparksieve.llm.chunks import chunked, unpack
from sparksieve.llm.ctw import DEPTH, END, common_contexts, counted, held_out, score_texts

SCHEMA = "doc_id long, text string, held_out int, extra string"


class Tree:
    """Context-tree weighting as defined, node by node."""

    def __init__(self):
        self.zeros, self.ones, self.children, self.memo = Counter(), Counter(), {}, {}

    def learn(self, context, node, bit):
        for d in range(DEPTH + 1):
            key = (context[:d], node)
            (self.ones if bit else self.zeros)[key] += 1
            if d:
                self.children.setdefault((context[: d - 1], node), set()).add(key)

    def log_e(self, key):
        a, b = self.zeros[key], self.ones[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_children(self, key):
        return sum(self.log_w(c) for c in self.children.get(key, ()))

    def log_w(self, key):
        if key not in self.memo:
            e = self.log_e(key)
            if len(key[0]) == DEPTH:
                self.memo[key] = e
            else:
                c = self.log_children(key)
                self.memo[key] = max(e, c) + math.log1p(math.exp(-abs(e - c))) - math.log(2)
        return self.memo[key]

    def chance(self, context, node, bit, d=0):
        key = (context[:d], node)
        a, b = self.zeros[key], self.ones[key]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == DEPTH:
            return own
        x = self.log_e(key) - self.log_children(key)
        stop = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        return stop * own + (1 - stop) * self.chance(context, node, bit, d + 1)


def decisions(text):
    data = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    padded = bytes([END] * DEPTH) + data + bytes([END])
    for p in range(DEPTH, len(padded)):
        context = padded[p - DEPTH : p][::-1]
        for b in range(8):
            yield context, (1 << b) | (padded[p] >> (8 - b)), padded[p] >> (7 - b) & 1


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    tree, count = Tree(), Counter()
    for i, t in rows:
        if not held(i):
            count.update(tokens(t))
            for x in decisions(t):
                tree.learn(*x)
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, held(i), len(own), sum(count[w] > 0 for w in own), n, base, sum(math.log10(tree.chance(*x)) for x in decisions(t))))
    return out


def compare(spark, rows, share=512):
    got = score_texts(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3), share=share).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    got, want = sorted(map(tuple, got), key=repr), sorted(brute(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5)


@pytest.mark.parametrize("share", [1, 8, 64, 1 << 20])  # of contexts: none, a few, many, all are split
def test_matches_definition(spark, share):
    r = random.Random(4)
    words = ["The", "then", "é", "other", "a", "b!"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 8, 30])))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n "), (None, "the then"), (3, rows[3][1]), (43, "ab" * 300)]
    compare(spark, rows, share)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    compare(spark, [(held[0], "Some text"), (held[1], None), (held[2], "")])


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_common_contexts_are_spread(spark):
    """All contexts of the asked-for part of strings, and none of less than half of that, over chunks that differ."""
    r = random.Random(6)
    texts = ["".join(r.choices("eeet nab", k=400)) for _ in range(20)] + ["".join(r.choices("xyz 0123456789", k=400)) for _ in range(20)]
    chunks = chunked(spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).coalesce(1).sortWithinPartitions("doc_id"), 2000)
    split = common_contexts(chunks, 10, 16)
    counts, total = {d: Counter() for d in (2, 3, 4)}, 0
    for row in chunks.collect():
        own = unpack(row.payload)
        key, _ = counted(own, ~held_out(own, 10))
        total += len(key)
        for d in counts:
            counts[d].update((key >> np.uint64(8 * (DEPTH + 1 - d))).tolist())
    assert len(split[2])
    for d, count in counts.items():
        assert {c for c, k in count.items() if 16 * k >= total} <= set(split[d].tolist()) <= {c for c, k in count.items() if 32 * k > total}
        assert len(split[d]) < 32
