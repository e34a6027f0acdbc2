import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparksieve.llm import toxicity as t

SCHEMA = "doc_id long, text string, lang string, score string, toxic long"


def made(n, seed):
    """Texts of common words; toxic ones hold a word of a hidden stem somewhere."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        body = r.choices(words, k=r.choice([5, 40, 400]))
        toxic = int(r.random() < 0.2)
        if toxic:
            body[r.randrange(len(body))] = "zork" + "".join(r.choices("abc", k=2))
        rows.append((i, " ".join(body), r.choice(["en", "de", None]), "x", toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = t.fit(docs, labels, F.col("label_id") % 4 != 2)
    got = {r.doc_id: r for r in t.score(docs.drop('score'), model).rows.collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([(got[r[0]].score >= 0.3) == r[4] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert model.thresholds.keys() <= {"en", "de"}
    # Labels, language and ids don't enter a score.
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("1").alias("score"), F.lit(1).alias("toxic"))
    again = {r.doc_id - 10**6: r.score for r in t.score(other, model).rows.select('doc_id', F.col('score_').alias('score')).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)


def test_scores_do_not_depend_on_the_batch():
    rows = made(200, 2)
    texts = pa.array([r[1] for r in rows[:60]] + [None, "", "!!", "zorkab " * 5000])
    model = t.train(pa.array([r[1] for r in rows]), np.array([r[4] for r in rows]), ["en"] * 200, 40, 160)
    alone = np.concatenate([t.scores(model, t.encode(texts[i : i + 1])) for i in range(len(texts))])
    assert np.allclose(alone, t.scores(model, t.encode(texts)), atol=1e-5)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, "s", 1), (2, "", "en", "s", 1), (None, "a b", "en", "s", 1), (3, "x " * 50000, "en", "s", 1), (3, "x", "en", "s", 1)], SCHEMA)
    for labels in ([], [(1, 1), (None, 0), (2, None)], [(1, 1), (2, 0), (9, 1), (3, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        rows = t.score(docs.drop('score'), t.fit(docs, frame)).rows.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert t.score(docs.limit(0), t.fit(docs.limit(0), frame)).rows.collect() == []


def test_saturated_scores():
    """Training on until log odds are far beyond single precision leaves all finite and in order."""
    rows = made(400, 4)
    texts, y = pa.array([r[1] + (" zorkaa zorkab zorkac" if r[4] else "") for r in rows]), np.array([r[4] for r in rows])
    epochs, t.EPOCHS = t.EPOCHS, 40
    try:
        model = t.train(texts, y, [r[2] for r in rows], int(y.sum()) * 50, int((1 - y).sum()) * 50)
    finally:
        t.EPOCHS = epochs
    sure = model._replace(out=model.out * np.float32(40))
    z = t.logits(sure, t.encode(texts))
    assert np.float32(t.sigmoid(z).max()) == 1 and np.isfinite(z).all()
    again = t._calibrated(sure, z, y.astype(float), [r[2] for r in rows], 0.3)
    for m in (model, again):
        got = t.scores(m, t.encode(texts))
        assert np.isfinite([m.scale, m.bias, m.common, *m.thresholds.values()]).all() and np.isfinite(got).all() and 0 <= got.min() and got.max() <= 1
        reject = got >= np.array([m.thresholds.get(r[2], m.common) for r in rows])
        assert reject[y == 1].mean() >= 0.98 and reject[y == 0].mean() <= 0.02
        assert set(m.thresholds) == {"en", "de"}


def naive_logit(m, text):
    """Convolution by loops: words, features, windows with padding on both sides, maxima, output."""
    words = re.findall("[a-z0-9'\x80-\U0010ffff]+", text.lower())
    vectors = []
    for w in words:
        alone = t.encode(pa.array([w]))
        vectors.append(sum(m.table[f].astype(float) for f in alone.features[alone.sequence[0]]))
    total = m.bias
    for i, (filters, shift) in enumerate(zip(m.filters, m.shift)):
        width = len(filters)
        padded = [np.zeros(t.WIDTH)] * (width - 1) + vectors + [np.zeros(t.WIDTH)] * 2
        for k in range(t.FILTERS):
            best = max(sum(padded[j + s] @ filters[s][:, k].astype(float) for s in range(width)) + shift[k] for j in range(len(padded) - width + 1))
            total += m.scale * max(best, 0) * float(m.out[i * t.FILTERS + k])
    return total


def test_against_a_naive_convolution():
    rows = made(120, 6)
    model = t.train(pa.array([r[1] for r in rows]), np.array([r[4] for r in rows]), ["en"] * 120, 24, 96)
    texts = ["", "One", "zorkab", "Aé b, c d zorkca e!", *(r[1] for r in rows[:6] if len(r[1]) < 400)]
    assert np.allclose(t.logits(model, t.encode(pa.array(texts))), [naive_logit(model, x) for x in texts], atol=1e-3)


def test_gradient():
    """One step's change of the output weights follows the loss's slope, found by differences."""
    rows = made(40, 8)
    docs, y = t.encode(pa.array([r[1] for r in rows])), np.array([r[4] for r in rows], np.float32)
    m = t._start(3)

    def loss(out):
        z = t.logits(m._replace(out=out.astype(np.float32)), docs)
        return float((np.logaddexp(0, z) - y * z).mean() + 0.5e-4 * (out**2).sum())

    slope = np.array([(loss(m.out + 1e-2 * e) - loss(m.out - 1e-2 * e)) / 2e-2 for e in np.eye(len(m.out))])
    past: dict = {"table": np.full((t.ROWS + 1, t.WIDTH), 1e-6, np.float32)}
    t._step(m._replace(table=m.table.copy(), filters=[f.copy() for f in m.filters], out=m.out.copy(), shift=[s.copy() for s in m.shift]), docs, y, past, np.ones(t.ROWS + 1, bool))
    assert np.allclose(np.sqrt(past["out"]), np.abs(slope), atol=2e-4)


def test_every_labelled_row_is_learned_from(spark):
    """A stem that stands only in toxic rows past the first 5,000 by the hash of the id; several shards."""
    r = random.Random(9)
    words = ["".join(r.choices("abcde", k=5)) for _ in range(100)]
    ids = [x.id for x in spark.range(9000).orderBy(F.xxhash64("id", F.lit(7))).collect()]
    rows = [(i, " ".join([*r.choices(words, k=4), ("zork" if n < 5000 else "quux") + r.choice("abc")] if n < 6200 else r.choices(words, k=5)), "en", "x", int(n < 6200)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = t.fit(docs, docs.select("doc_id", "toxic"))
    got = t.scores(model, t.encode(pa.array([f"{w} {s}a {w}" for s in ("zork", "quux") for w in words])))
    assert (got > 0.5).mean() > 0.97
    assert (t.scores(model, t.encode(pa.array(words))) < 0.3).mean() > 0.9


def test_averages_of_shards():
    """A row's change is the mean over the shards that touched it; what is not in the table is the mean of all."""
    rows = made(90, 3)
    texts, y, live = pa.array([x[1] for x in rows]), np.array([x[4] for x in rows], np.float32), np.arange(t.ROWS + 1) < t.ROWS
    m, past = t._begin(live, 3)
    parts, changes = [], {}
    for own in (np.arange(30), np.arange(30, 90)):
        alone, sums = t._begin(live, 3)
        parts.append((len(own), t._passed(alone, texts, y, sums, live, own), sums))
        for block, n, data in t._changes(parts[-1][1], sums, m, past, len(own)):
            changes.setdefault(block, []).append((n, data))
    table, moved = m.table.copy(), [(p["table"] != past["table"]).any(axis=1) for _, _, p in parts]
    got = t._changed(m, past, [(b, t._averaged(b, c)) for b, c in changes.items()])
    one, two = parts[0][1], parts[1][1]
    assert np.allclose(got.out, (one.out + 2 * two.out) / 3, atol=1e-6) and np.isclose(got.bias, (one.bias + 2 * two.bias) / 3)
    both = (one.table + 2 * two.table) / 3
    want = np.where((moved[0] & moved[1])[:, None], both, np.where(moved[0][:, None], one.table, np.where(moved[1][:, None], two.table, table)))
    assert np.allclose(got.table, want, atol=1e-6) and (moved[0] & ~moved[1]).any()


def test_fit_leaves_no_files(spark):
    """Neither the labelled texts nor the models sent for each pass stay on disk."""
    docs = spark.createDataFrame(made(200, 5), SCHEMA)
    t.fit(docs, docs.select("doc_id", "toxic"))

    def left():
        places = spark.sparkContext._temp_dir, spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        return {p for place in places for p in Path(place).rglob("*") if p.is_file() and p.stat().st_size > 0}

    before = left()
    t.fit(docs, docs.select("doc_id", "toxic"))
    assert left() <= before
