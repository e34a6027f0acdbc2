import hashlib
import random
import re

from sparksieve.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_chars long, chunk int, payload string"


def brute(rows, window):
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for i, words in docs:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < (float("inf") if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(12)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    made = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 12, 13, 14, 50, 120]))]
        if r.random() < 0.6:
            a = r.randrange(40)
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[a : a + r.choice([12, 13, 14, 30])]
        made.append((i, r.choice([" ", "\n", "  \t"]).join(words)))
    made += [(60, made[7][1]), (60, made[7][1]), (61, None), (62, ""), (63, " \n "), (None, made[9][1]), (None, made[9][1]), (64, "x " * 3000), (65, "x " * 20)]
    r.shuffle(made)
    return [(i, t, 1, 2, "y") for i, t in made]


def test_matches_brute_force(spark):
    for seed in range(3):
        data = rows(seed)
        got = dedup_substrings(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(data, 13)


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
