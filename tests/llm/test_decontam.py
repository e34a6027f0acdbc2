import random
import re
from collections import Counter

import pyarrow as pa

from sparksieve.llm.decontam import BLOCK_RADIUS, RADIUS, SHINGLE, SIMILARITY, _bits, benchmark_matches, shingles, simhash, without_benchmark

SCHEMA = "doc_id long, text string, item_id long, n int"


def bag(words):
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def brute(docs, items):
    read = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for d, text in docs:
        own = bag(read(text))
        for i, item in items:
            other = bag(read(item))
            if not own or not other:
                continue
            m, b = min(len(own), len(other)), Counter(other)
            best = 0
            for w in range(len(own) - m + 1):
                c = Counter(own[w : w + m])
                shared = sum((c & b).values())
                best = max(best, shared / (m + len(other) - shared))
            if best >= SIMILARITY - 1e-12:
                out.add((d, i, round(best, 9)))
    return out


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(200)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 8, 15, 40, 60])))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, ""), (33, "!!"), (34, "a a a a a a a a a b")]
    docs = []
    for d in range(150):
        words = r.choices(vocabulary, k=r.choice([0, 3, 20, 100]))
        for _ in range(r.choice([0, 1, 2])):
            passage = r.choice(items)[1]
            passage = (passage or "").split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if passage:
                    passage[r.randrange(len(passage))] = r.choice(vocabulary)
            at = r.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, r.choice([" ", ", ", "\n"]).join(words).replace("w1", "W1")))
    docs += [(150, None), (151, "w1é " * 20000), (None, items[5][1]), (5, docs[5][1]), (152, items[0][1]), (153, "A A A a a a a a a B"), (154, " ".join(items[4][1].split()[:-1]))]
    return docs, items


def test_matches_brute_force(spark):
    for seed in range(2):
        docs, items = made(seed)
        frame = spark.createDataFrame([(d, t, 7, 1) for d, t in docs], SCHEMA).repartition(3)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        for block in (4 << 20, 800):
            got = {(x.doc_id, x.item_id, round(x.similarity, 9)) for x in benchmark_matches(frame, benchmark, block).collect()}
            assert got == brute(docs, items)
        hit = {d for d, *_ in brute(docs, items)}
        kept = without_benchmark(frame, benchmark).collect()
        assert sorted([x.doc_id for x in kept], key=repr) == sorted([d for d, _ in docs if d not in hit], key=repr)


def test_recall_of_the_radius():
    """Windows of similarity 0.80 to 0.85 whose fingerprints the index finds, edits being scattered or in one piece."""
    r = random.Random(31)
    near = [v for v in range(256) if v.bit_count() <= BLOCK_RADIUS]
    found = total = 0
    for k in range(1500):
        n = r.choice([30, 60, 120, 300])
        item = [r.getrandbits(40) for _ in range(n)]
        other = list(item)
        lost = int(n * 0.1)
        if k % 2:  # scattered words, each in five shingles
            for _ in range(max(1, lost // 5)):
                other[r.randrange(n)] = r.getrandbits(40)
        else:
            at = r.randrange(n - lost)
            other[at : at + max(1, lost - 4)] = [r.getrandbits(40) for _ in range(max(1, lost - 4))]
        texts = pa.array([" ".join(map(str, x)) for x in (item, other)])
        s = shingles(texts)
        a, b = s.hashes[s.first[0] : s.first[1]], s.hashes[s.first[1] : s.first[2]]
        shared = len(set(a.tolist()) & set(b.tolist()))
        if not 0.8 <= shared / (len(a) + len(b) - shared) <= 0.85:
            continue
        x, y = (simhash(_bits(h).sum(axis=0)[None])[0] for h in (a, b))
        blocks = [p ^ q for p, q in zip(x.tobytes(), y.tobytes())]
        found += any(v in near for v in blocks) and int(x ^ y).bit_count() <= RADIUS
        total += 1
    assert total >= 200 and found / total >= 0.999, (found, total)


def test_empty_tables(spark):
    docs, items = made(1)
    frame = spark.createDataFrame([(d, t, 7, 1) for d, t in docs], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert benchmark_matches(frame, benchmark.limit(0)).collect() == []
    assert benchmark_matches(frame.limit(0), benchmark).collect() == []
    assert without_benchmark(frame, benchmark.limit(0)).count() == len(docs)
