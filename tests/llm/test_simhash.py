import random
import re

import numpy as np
import xxhash

from sparksieve.llm.simhash import anchors, compared, components, exact_similarity, fingerprint, links, near_copies, one_of_each

SCHEMA = "doc_id long, text string, bits long, u string"


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(bits):
    root = {x: x for x in bits}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bits:
        for b in bits:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {x: find(x) for x in bits}


def test_fingerprint():
    for t in ["", " ", "One", "One two", "one TWO three", "É a\tb\nc É", "x " * 500, "a b c d e f g h i j k"]:
        assert fingerprint(t.encode()) == brute_fingerprint(t)


def test_links_of_fingerprints(spark):
    r = random.Random(3)
    bits = {0, 1, 3, 7, 15, 2**64 - 1, 2**63, 2**62}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 6])):
            bits.add(x)
            for _ in range(r.choice([1, 2, 3])):
                x ^= 1 << r.randrange(64)
    signed = {x: x - 2**64 if x >= 2**63 else x for x in bits}
    got = components(links(anchors(spark.createDataFrame([(s, s) for s in signed.values()], "bits long, id long"))))
    root = {row.node: row.root for row in got.collect()}
    want = brute_components(sorted(bits))
    for a in bits:
        for b in bits:
            assert (want[a] == want[b]) == (root.get(signed[a], signed[a]) == root.get(signed[b], signed[b]))


def test_documents(spark):
    words = [f"w{i}" for i in range(400)]
    r = random.Random(5)
    base = [" ".join(r.choices(words, k=300)) for _ in range(5)]
    rows = [(i, base[i % 5] + (" more" if i % 2 else ""), 1, "x") for i in range(40)]
    rows += [(40, None, 1, "x"), (41, "", 1, "x"), (42, " \n", None, None), (3, rows[3][1], 1, "x"), (None, "only here a b c", 1, "x"), (43, "WORD " * 20000, 1, "x")]
    got = near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    group = brute_components({p for _, p in prints})
    want = [(i, p - 2**64 if p >= 2**63 else p, min((j for j, q in prints if group[q] == group[p] and j is not None), default=None)) for i, p in prints]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_of_each(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = r.choices(words, k=r.choice([40, 150, 400]))
        rows.append((i, " ".join(base)))
        for k in range(r.choice([0, 1, 3])):
            other = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 60, len(base) // 10])):
                other[r.randrange(len(other))] = r.choice(words)
            rows.append((100 * (k + 1) + i, " ".join(other).replace("w1 ", "W1\n")))
    rows += [(900, None), (901, ""), (902, " "), (None, rows[0][1]), (None, None), rows[5], (903, "few words"), (904, "few words")]
    kept = one_of_each(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)).collect()
    have = [(x.doc_id, x.text) for x in kept]
    assert all(x.bits == 1 and x.u == "x" for x in kept) and len(set(have)) == len(have)
    distinct = {i: t for i, t in rows if i is not None}
    near = {(a, b) for a in distinct for b in distinct if a < b and exact_similarity(distinct[a], distinct[b]) >= 0.8}
    ids = {i for i, _ in have}
    root = {i: i for i in distinct}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert ids == {find(i) for i in distinct}  # rows without an id are copies of others here


def test_rows_without_ids_and_ids_of_several_texts(spark):
    """A null id is the largest; of two rows with one id each goes by its own text; columns named like those used inside stay."""
    schema = "doc_id long, text string, raw string, i long, d string, node long, copy string, list long, root long"
    long = "one two three four five six seven eight"
    rows = [(None, "alone here"), (None, long), (5, long.upper()), (7, "other words of it"), (7, long), (None, "alone  HERE"), (9, "alone here too many words to be like it"), (9, "alone here too many words to be like it")]
    got = one_of_each(spark.createDataFrame([(i, t, f"r{k}", k, "d", k, "c", k, k) for k, (i, t) in enumerate(rows)], schema).repartition(3)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted([rows[5], rows[2], rows[3], rows[6]] if (rows[5] in [(x.doc_id, x.text) for x in got]) else [rows[0], rows[2], rows[3], rows[6]], key=repr)
    assert all((x.raw, x.i, x.d, x.copy) == (f"r{x.node}", x.node, "d", "c") and x.list == x.root == x.node for x in got)


def brute_kept(texts):
    """Least ids of groups of similar texts, by all pairs."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and exact_similarity(texts[a], texts[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def test_differences_in_one_piece(spark):
    """Copies with text appended, put in front or cut off, at similarities of 0.80 to 0.90."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    texts = {}
    for i in range(120):
        base = r.choices(words, k=r.choice([60, 150, 404]))
        grams = len(base) - 4
        more = r.choices(words, k=int(grams / r.uniform(0.8, 0.9)) - grams)
        texts[i] = " ".join(base)
        texts[1000 + i] = " ".join([base + more, more + base, base[: 4 + -int(-grams * r.uniform(0.81, 0.9) // 1)]][i % 3])
    assert sum(exact_similarity(texts[i], texts[1000 + i]) >= 0.8 for i in range(120)) >= 110
    kept = one_of_each(spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], SCHEMA).repartition(3)).collect()
    assert {x.doc_id for x in kept} == brute_kept(texts)


def test_leaders_that_are_unlike(spark):
    """What a few similar texts share is a template that many lesser ids with longer texts of their own have too."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    template = r.choices(words, k=160)
    texts = {i: " ".join(template + r.choices(words, k=60 if i < 150 else 14)) for i in range(156)}
    kept = one_of_each(spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], SCHEMA).repartition(3)).collect()
    assert brute_kept(texts) == set(range(151)) and {x.doc_id for x in kept} == set(range(151))


def test_lists_of_any_size(spark):
    """Links of lists that are compared in one task, or with leaders and in blocks, make the same components."""
    r = random.Random(17)
    base = list(range(60))
    sets = {}
    for i in range(150):
        if i % 50 == 0:
            base = r.sample(range(5000), 60)
        own = set(r.sample(base, 60 - r.choice([0, 2, 5, 9, 14]))) | {r.randrange(10**6, 10**9) for _ in range(r.choice([0, 1, 4, 8]))}
        sets[i] = own
    pack = lambda x: np.array(sorted(x), np.uint64).tobytes()
    frame = spark.createDataFrame([(i, bytearray(pack(x))) for i, x in sets.items()], "node long, shingles binary")
    lists = spark.createDataFrame([(k, i, len(x)) for i, x in sets.items() for k in range(i // 50 * 2, i // 50 * 2 + 2)] + [(99, 3, len(sets[3])), (98, 3, len(sets[3])), (98, 77, len(sets[77]))], "list long, node long, size long")
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            if a // 50 == b // 50 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for most in (1 << 21, 2000, 300):
        got = {x.node: x.root for x in components(compared(lists, frame, most)).collect()}
        assert {i: got.get(i, i) for i in sets} == {i: find(i) for i in sets}, most


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    assert one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []
