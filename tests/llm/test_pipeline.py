"""Each stage of the pipeline on its own input, against brute force."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from sparksieve.llm.simhash import exact_similarity  # noqa: E402
from test_bytedup import brute_first  # noqa: E402
from test_decontam import brute as brute_benchmark  # noqa: E402
from test_mixing import targets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ru", "ti", "so", "") for c in ("", "é", "x", "zen", "dor", "w")]
    long = " ".join(r.choices(words, k=120))
    items = [(i, " ".join(r.choices(words, k=20))) for i in range(6)]
    docs, labels = [], []
    for i in range(400):
        body = r.choices(words, k=r.choice([10, 60, 200]))
        toxic = r.random() < 0.2
        if toxic:
            body[3:3] = ["zork" + r.choice(["", "a", "b"]), "zork"]
        text = " ".join(body)
        if r.random() < 0.1:
            text += " " + long
        if r.random() < 0.1:
            text += " " + r.choice(items)[1]
        docs.append((i, text, r.choice(["en", "de"]), r.choice(["a", "a", "a", "b", None]), len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(60):
        j, text, lang, source, n = docs[i]
        docs.append((1000 + i, text if i % 2 else text.replace(" ", "  ", 1) + " end", lang, source, n))
    docs += [(2000, None, "en", "a", 0), (2001, "", "en", "a", 0), (2002, " ", None, None, 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {}
    rows["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns

    before, after = ({r.doc_id: r.text for r in rows[k]} for k in ("documents", "toxicity"))
    gone = [i for i in before if i not in after]
    assert sum("zork" in before[i] for i in gone) >= 0.95 * len(gone) and sum("zork" in (t or "") for t in after.values()) <= 0.05 * len(gone)

    before, after = after, {r.doc_id: r.text for r in rows["near_copies"]}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in before:
        for b in before:
            if a < b and exact_similarity(before[a], before[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in before} and all(after[i] == before[i] for i in after)

    before, after = after, {r.doc_id: r.text for r in rows["repeated_strings"]}
    # At 400 bytes and more every repeated run goes; what stays besides are the first of each and shorter runs of 50 words or fewer.
    least, most = brute_first(before.items(), 101), brute_first(before.items(), 400)
    assert sorted(after) == sorted(i for i in before if after.get(i) or not before[i])
    size = {i: (len(least[i]), len(most[i])) for i in before}
    assert all(size[i][0] - 6 <= len((after.get(i) or "").encode()) <= size[i][1] for i in before)
    assert any(len(after[i] or "") < len(before[i] or "") for i in after)
    assert all(r.n_chars == len(r.text) for r in rows["repeated_strings"] if r.text is not None)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {i for i, *_ in brute_benchmark(list(after.items()), items)}
    before, after = after, {r.doc_id: r.text for r in rows["benchmark"]}
    assert hit and set(after) == set(before) - hit

    size = {}
    for r in rows["benchmark"]:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    want, got, largest = targets(size, (5, 2, 1), 3), dict.fromkeys(size, 0), {}
    for r in rows["mix"]:
        got[r.source] += len(r.text.split())
        largest[r.source] = max(largest.get(r.source, 0), len(r.text.split()))
    assert all(abs(got[s] - want[s]) <= max(largest.get(s, 0), 210) for s in size)
    assert {r.copy for r in rows["mix"]} <= {1, 2, 3}


def test_passages_of_over_fifty_words(spark):
    """Of passages of 51 to 60 words in otherwise different texts the first stays and the others go; those of 50 and fewer stay, whatever their words' lengths."""
    r = random.Random(13)
    own = lambda: " ".join(f"{r.getrandbits(30):x}" for _ in range(80))
    rows, want = [], {}
    for n, size in ((51, 1), (51, 3), (55, 5), (60, 5), (40, 5), (40, 7), (50, 4)):
        for _ in range(3):
            passage = " ".join("".join(r.choices("abcdefghij", k=size)) for _ in range(n))
            for k in range(3):
                a, b, i = own(), own(), len(rows)
                rows.append((i, f"{a} {passage} {b}", "en", "a", 1))
                want[i] = k == 0 or n <= 50
    whole = f"{own()} {own()}"
    rows += [(900, whole, "en", "a", 1), (901, whole.replace(" ", " x ", 1), "en", "a", 1)]
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_strings_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), "").collect()}
    assert got[900] == whole and len(got[901]) < 40
    for i, text, *_ in rows[:-2]:
        assert got[i] == text if want[i] else len(got[i]) < len(text) - 100, (i, want[i])


CLASHES = ("id", "s", "times", "copy", "score", "threshold", "rejected", "_of", "_id", "_digest", "_kept", "raw", "d", "i", "digest", "left", "of", "node", "list", "root", "taken", "size")


def test_clashing_columns(spark, sf_dir):
    """Columns named like those used inside keep values and types through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) if k % 2 else (F.col("doc_id") * k).cast("int").alias(c) for k, c in enumerate(CLASHES)))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes[: len(docs.dtypes)] == docs.dtypes
        rows = out.collect()
        assert rows and all(r[c] == (f"{c} {r.doc_id}" if k % 2 else r.doc_id * k) for r in rows for k, c in enumerate(CLASHES))
    assert "copy_" in out.columns


def test_run(spark, sf_dir):
    first, again = (sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert first == again and first


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
