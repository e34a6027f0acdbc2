import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparksieve.llm import suffix
from sparksieve.llm.bytedup import dedup_bytes, without_repeats
from sparksieve.llm.suffix import repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, n_bytes int, payload string"


def test_suffix_array():
    r = random.Random(1)
    for _ in range(200):
        letters = r.choice([1, 2, 3, 5])
        text = [r.randint(2, letters + 1) if r.random() < 0.9 else 1 for _ in range(r.randint(1, 60))] + [0]
        assert suffix_array(np.array(text, np.int16), 100).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("few", [4, 64, 256])
def test_suffix_array_by_recursion(few, monkeypatch):
    """Few names a depth make it go on with digits, many with the names themselves."""
    monkeypatch.setattr(suffix, "FEW", few)
    r = random.Random(few)
    for letters in (2, 4, 40, 250):
        passage = r.choices(range(2, letters + 2), k=300)
        text = [r.randint(2, letters + 1) for _ in range(500)] + passage + [1] + passage[50:] + [2] * 60 + passage[:200] + [0]
        assert suffix_array(np.array(text, np.int16), len(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        short = suffix_array(np.array(text, np.int16), 20).tolist()
        assert [text[i : i + 20] for i in short] == sorted(text[i : i + 20] for i in range(len(text)))


def test_repeated_starts():
    r = random.Random(2)
    for _ in range(200):
        length, base = r.choice([8, 9, 16, 20]), bytes(r.choices(b"abc", k=80))
        fragments = []
        for _ in range(r.randint(1, 6)):
            i = r.randrange(70)
            fragments.append(base[i : i + r.randint(0, 60)] + bytes(r.choices(b"ab\xc3\x00", k=r.randint(0, 30))) + b"a" * r.choice([0, 0, 50]))
        count = Counter(f[i : i + length] for f in fragments for i in range(len(f) - length + 1))
        for f, got in zip(fragments, repeated_starts(fragments, length)):
            assert got.tolist() == [count[f[i : i + length]] > 1 for i in range(max(0, len(f) - length + 1))]


def brute(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k : k + length] for _, d in docs for k in range(len(d) - length + 1))
    out = []
    for i, d in docs:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(300)]
    passage = " ".join(r.choices(words, k=120))
    rows = []
    for i in range(60):
        text = " ".join(r.choices(words, k=r.choice([0, 10, 60, 200])))
        for _ in range(r.choice([0, 1, 1, 2])):
            a, at = r.randrange(100), r.randrange(len(text) + 1)
            text = text[:at] + passage[a : a + r.choice([90, 99, 100, 101, 150, 400])] + text[at:]
        rows.append((i, text))
    for k in range(8):  # near copies
        text = list(rows[k][1])
        if text:
            text[r.randrange(len(text))] = "X"
        rows.append((100 + k, "".join(text)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (203, "x" * 3000), (204, "line of text " * 40), (205, "line of text " * 40 + "z"), (206, "y" * 100)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "hot"), [(2 << 20, 32), (3000, 32), (2 << 20, 1), (2 << 20, 2)])
def test_matches_brute_force(spark, shard, hot):
    for seed in range(2):
        rows = made(seed)
        got = dedup_bytes(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3), 100, shard, hot_chunks=hot).drop("kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 100)


def test_production_length(spark):
    rows = made(5) + [(300 + i, made(6)[i][1] * 3) for i in range(10)]
    got = dedup_bytes(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)).drop("kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 400)


def brute_first(rows, length):
    """What is left of each text (by id) where of equal strings the first stays: least id, then least place."""
    docs = sorted((i is None, i or 0, (t or "").encode()) for i, t in rows)
    seen, left = set(), {}
    for none, i, d in docs:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if d[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(d[k : k + length])
        left[None if none else i] = bytes(b for b, g in zip(d, gone) if not g)
    return left


@pytest.mark.parametrize(("shard", "hot"), [(2 << 20, 32), (3000, 32), (2 << 20, 1), (2 << 20, 2), (3000, 2)])
def test_first_of_equal_strings_stays(spark, shard, hot):
    for seed in (11, 12):
        rows = [x for k, x in enumerate(made(seed)) if not (x[0] == 3 and x[1] == dict(made(seed)).get(202) and k)]
        rows = [*{i: (i, t) for i, t in rows}.values()]
        got = dedup_bytes(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3), 100, shard, hot_chunks=hot, keep_first=True).collect()
        assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(x).hexdigest() for i, x in brute_first(rows, 100).items()}


def test_without_repeats(spark):
    """Columns named like those used inside stay as they are, and no text that stands nowhere else goes."""
    schema = "doc_id long, text string, n_chars int, id string, digest int, left string, of string, _of string, _id string, _digest string, _kept string, kept string, n_removed int"
    rows = [*dict(made(7)).items()]
    frame = spark.createDataFrame([(i, t, len(t or ""), "a", 1, "b", "c", "d", "e", "f", "g", "h", 2) for i, t in [*rows, rows[0]]], schema)
    got = without_repeats(frame, 100).collect()
    want = {i: x for i, x in brute_first(rows, 100).items() if x or not dict(rows)[i]}
    assert sorted((r.doc_id for r in got), key=repr) == sorted([*want, rows[0][0]] if rows[0][0] in want else want, key=repr)
    for r in got:
        assert (r.text or "").encode() == want[r.doc_id].decode("utf-8", "ignore").encode()
        assert r.n_chars == len(r.text or "") and tuple(r)[3:] == ("a", 1, "b", "c", "d", "e", "f", "g", "h", 2)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert dedup_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_spanning():
    """So many LMS substrings in a row span the length wherever they begin, and one fewer does not."""
    r = np.random.default_rng(4)
    for _ in range(200):
        lms = np.cumsum(r.integers(2, 6, r.integers(1, 30)))
        length = int(r.integers(2, 60))
        k = suffix._names_spanning(lms, length)
        spans = lambda k: all(lms[i + k] - lms[i] + 1 >= length for i in range(len(lms) - k))  # noqa: B023, E731
        assert spans(k) and (k == 1 or not spans(k - 1))
