"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word's embedding is the sum of hashed rows for the word and for its first 3 to 8 bytes, so words of one
stem share most of it; rows that fewer than MIN_DOCS training documents touch stay zero, so a word seen once
can't decide.  Filters of widths 1, 2 and 3 slide over the whole document, each filter's maximum goes to a
logistic output with weights of zero or more: what a document says besides can't make up for toxic words, however
long it is.  Through a maximum only the winning window has a gradient, so training is a cheap forward
pass and a sparse update (Adagrad).

Every labelled row is learned from.  Four fifths, by a hash of the id, train the classifier: dealt over shards of some
SHARD_ROWS rows (MOST_SHARDS at most, which then grow), each read as a stream in EPOCHS passes.  In a pass every shard goes on
from the same model; what it changed is averaged by blocks of the table in tasks, over the shards that touched a row, and
only the averages come to the driver.  The other fifth gives temperature and bias, and each language's threshold for the best
F1 on its own rows, to which those of other languages add a little; its log odds come to the driver as counts of bins of
1 / BINS.  Language chooses a threshold only: no score depends on it, nor on labels, source or id.

Scoring reads whole texts in Arrow batches with a model of fixed size (ROWS x WIDTH floats), so it shuffles nothing.

Cases: null and empty texts have no words and get the score of no evidence; labels without a document, with a
null label or a null id are left out; repeated rows get equal scores; a language that is null or unknown takes the
common threshold; without labels, or with one label only, the score is the share of toxic rows (0 of none); extra
columns are kept, also those named like what score() adds (it takes other names then); no rows give no rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .chunks import mix64, words_of
from .common import forget, fresh, release_memory, saved, shuffle_partitions

#: Training rows of a shard, while there are not more shards than that.
SHARD_ROWS, MOST_SHARDS = 5000, 64
#: Rows of the table that are averaged together; bins of one unit of log odds, and where they end.
BLOCK, BINS, LAST_BIN = 1 << 13, 256, 1 << 14
#: Bits that tell most ids without a label.
ID_BITS = 1 << 25
#: Rows (a power of two) and width of the embedding table, filters of each width.
ROWS, WIDTH, FILTERS, WIDTHS = 1 << 17, 12, 16, (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8)
MIN_DOCS, EPOCHS, BATCH, RATE = 3, 6, 64, 0.08
#: Toxic rows of other languages that a language's threshold leans on, in all.
OTHERS = 10.0
#: Log odds beyond which scores don't change (1 - score is still a double above 0).
MOST_LOGIT = 30.0
#: Bytes of text that are scored at a time.
SCORED = 1 << 18

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789'", *range(128, 256)]] = False


class Words(NamedTuple):
    features: np.ndarray  # (distinct words + 1, 1 + len(PREFIXES)) rows of the table; ROWS for none; the last word is padding
    sequence: np.ndarray  # of distinct words, two of padding after each document
    starts: np.ndarray  # where documents begin


def encode(texts: pa.Array) -> Words:
    """Lower-cased words of texts (null: none)."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data = np.frombuffer(b"\n".join(t.as_buffer().to_pybytes() for t in texts) + b"\n", np.uint8)
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cuts = np.concatenate([[0], np.cumsum(length)])
    first, last = words_of(data, cuts, _OUTSIDE)
    place = np.arange(len(data), dtype=np.int64)
    size = last - first
    offset = np.zeros(len(data) + 1, np.int64)
    offset[first] = first
    offset = np.maximum.accumulate(offset)[:-1]
    mixed = mix64(((place - offset).astype(np.uint64) << np.uint64(8) | data) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x70C5))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    whole = mix64(sums[last] - sums[first] + size.astype(np.uint64))
    distinct, at, word = np.unique(whole, return_index=True, return_inverse=True)
    features = np.full((len(distinct) + 1, 1 + len(PREFIXES)), ROWS, np.int32)
    features[:-1, 0] = distinct & np.uint64(ROWS - 1)
    for i, k in enumerate(PREFIXES, 1):
        own = np.flatnonzero(size[at] >= k)
        begin = first[at[own]]
        features[own, i] = mix64(sums[begin + k] - sums[begin] + np.uint64(1000 + k)) & np.uint64(ROWS - 1)
    count = np.diff(np.searchsorted(first, cuts))
    starts = np.concatenate([[0], np.cumsum(count + 2)[:-1]]).astype(np.int64)
    sequence = np.full(int(count.sum()) + 2 * len(count), len(distinct), np.int64)
    sequence[np.arange(len(word)) + 2 * np.repeat(np.arange(len(count)), count)] = word
    return Words(features, sequence, starts)


class Model(NamedTuple):
    table: np.ndarray  # (ROWS + 1, WIDTH), the last row zero
    filters: list[np.ndarray]  # for each width w: (w, WIDTH, FILTERS)
    shift: list[np.ndarray]  # for each width: (FILTERS,)
    out: np.ndarray  # (filters of all widths,)
    bias: float
    scale: float
    thresholds: dict[str, float]
    common: float


def _windows(m: Model, w: Words) -> list[np.ndarray]:
    """Activations of the windows that end at each place, without the nonlinearity; before the text and after it there is padding."""
    words = m.table[w.features].sum(axis=1)
    found = []
    for f, b in zip(m.filters, m.shift, strict=True):
        own = np.zeros((len(w.sequence) + len(f) - 1, f.shape[2]), np.float32)
        own += b
        for t in range(len(f)):
            own[len(f) - 1 - t : len(own) - t] += (words @ f[t])[w.sequence]
        found.append(own[: len(w.sequence)])
    return found


def logits(m: Model, w: Words) -> np.ndarray:
    """Log odds of each document, in double precision from the pooled values on: confident ones differ far beyond single precision's 1.0."""
    if not len(w.starts):
        return np.zeros(0)
    pooled = np.concatenate([np.maximum(np.maximum.reduceat(a, w.starts, axis=0), 0) for a in _windows(m, w)], axis=1)
    return m.scale * (pooled.astype(np.float64) @ m.out.astype(np.float64)) + m.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -MOST_LOGIT, MOST_LOGIT)))


def scores(m: Model, w: Words) -> np.ndarray:
    return sigmoid(logits(m, w))


def _start(seed: int) -> Model:
    r = np.random.default_rng(seed)
    table = r.normal(0, 0.05, (ROWS + 1, WIDTH)).astype(np.float32)
    table[ROWS] = 0
    filters = [r.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(r.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32), -2.0, 1.0, {}, 0.5)


def _step(m: Model, w: Words, y: np.ndarray, past: dict, live: np.ndarray) -> Model:
    """One Adagrad step on a batch; arrays of the model are changed in place."""
    found, ends = _windows(m, w), np.append(w.starts[1:], len(w.sequence))
    best = [np.stack([a[s:e].argmax(axis=0) + s for s, e in zip(w.starts, ends, strict=True)]) for a in found]
    top = [np.take_along_axis(a, b, axis=0) for a, b in zip(found, best, strict=True)]
    pooled = np.maximum(np.concatenate(top, axis=1), 0)
    wrong = (1 / (1 + np.exp(-np.clip(pooled @ m.out + m.bias, -30, 30))) - y).astype(np.float32) / len(y)

    def update(name: str, value: np.ndarray, gradient: np.ndarray, rate: float = RATE) -> None:
        past[name] = past.get(name, 0) + gradient**2
        value -= rate * gradient / (np.sqrt(past[name]) + 1e-6)

    back = wrong[:, None] * m.out * (pooled > 0)
    update("out", m.out, wrong @ pooled + 1e-4 * m.out)
    np.maximum(m.out, 0, out=m.out)
    rows, gradients = [], []
    for i, (f, b) in enumerate(zip(m.filters, best, strict=True)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        update(f"shift{i}", m.shift[i], g.sum(axis=0))
        change = np.zeros_like(f)
        for t in range(len(f)):
            # A window's place is its last word's: word t of a width of len(f) stands len(f) - 1 - t before it.
            at = b - (len(f) - 1 - t)
            feature = np.where((at < 0)[:, :, None], ROWS, w.features[w.sequence[np.maximum(at, 0)]])
            vector = m.table[feature].sum(axis=2)
            change[t] = np.einsum("df,dfw->wf", g, vector)
            d = g[:, :, None] * f[t].T[None]
            rows.append(feature.reshape(-1))
            gradients.append(np.repeat(d.reshape(-1, WIDTH), feature.shape[2], axis=0))
        update(f"filter{i}", f, change)
    row, gradient = np.concatenate(rows), np.concatenate(gradients)
    keep = live[row] & (np.abs(gradient).sum(axis=1) > 0)
    row, place = np.unique(row[keep], return_inverse=True)
    if len(row):
        total = np.stack([np.bincount(place, weights=c, minlength=len(row)) for c in gradient[keep].T], axis=1).astype(np.float32)
        past["table"][row] += total**2
        m.table[row] -= RATE * total / (np.sqrt(past["table"][row]) + 1e-6)
    bias = m.bias - RATE * float(wrong.sum())
    return m._replace(bias=bias)


def _fitted(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log odds by weighted logistic regression with a weak pull towards 1 and 0: damped Newton steps on a convex loss."""

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.05 * (a - 1) ** 2 + 0.005 * b * b)

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(100):
        p = sigmoid(a * z + b)
        e, h = (p - y) * weight, p * (1 - p) * weight
        ga, gb = (e * z).sum() + 0.1 * (a - 1), e.sum() + 0.01 * b
        haa, hab, hbb = (h * z * z).sum() + 0.1, (h * z).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db, step = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det, 1.0
        while step > 1e-6 and not loss(a - step * da, b - step * db) < now:
            step /= 2
        if step <= 1e-6:
            break
        a, b = a - step * da, b - step * db
        now = loss(a, b)
    return max(a, 0.05), b


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The log odds from which on rejecting has the best weighted F1, half-way to the next lower row."""
    order = np.argsort(-z, kind="stable")
    q, hit, taken = z[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    last = np.append(q[1:] != q[:-1], True)  # rows of equal score are rejected together
    f = np.where(last, 2 * hit / (taken + hit[-1]), -1.0)
    k = int(f.argmax())
    return float((q[k] + q[k + 1]) / 2 if k + 1 < len(q) else q[k] - 1.0)


def _calibrated(m: Model, z: np.ndarray, y: np.ndarray, lang: list[str | None], shift: float, count: np.ndarray | None = None) -> Model:
    """Scale and bias on held-back rows (count: how many of each; clean ones weigh exp(shift)), then a threshold for each language among them.

    A language's threshold is chosen on its own rows and, with a weight of OTHERS toxic rows in all, those of the other
    languages: many own rows decide for themselves, few lean on the rest.
    """
    count = np.ones(len(y)) if count is None else count
    weight = np.where(y > 0, 1.0, np.exp(shift)) * count
    a, b = _fitted(z, y, weight)
    t = a * z + b
    common, by = 0.0, {}
    if y.any():
        common = _best_cut(t, y, weight)
        for name in sorted({x for x in lang if x is not None}):
            own = np.array([x == name for x in lang])
            by[name] = _best_cut(t, y, np.where(own, weight, weight * min(1.0, OTHERS / max(1.0, (y * count)[~own].sum()))))
    out = m._replace(scale=m.scale * a, bias=a * m.bias + b, thresholds={k: float(sigmoid(v)) for k, v in by.items()}, common=float(sigmoid(common)))
    if not np.isfinite([out.scale, out.bias, out.common, *out.thresholds.values()]).all():
        raise ValueError("the classifier's calibration is not finite")
    return out


def _even(toxic: int, clean: int, seed: int) -> Model:
    """Without both labels: the share of toxic rows for every text."""
    share = toxic / max(1, toxic + clean)
    m = _start(seed)
    m.out[:] = 0
    return m._replace(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def _pieces(texts: pa.Array) -> Iterator[slice]:
    """Runs of BATCH rows, fewer where texts are long."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ends):
        j = max(i + 1, min(i + BATCH, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4 * SCORED, "right"))))
        yield slice(i, j)
        i = j


def _counted(texts: pa.Array, seen: np.ndarray) -> None:
    """Adds to seen how many of the texts touch each row of the table."""
    for p in _pieces(texts):
        w = encode(texts[p])
        doc = np.repeat(np.arange(len(w.starts)), np.diff(np.append(w.starts, len(w.sequence))))
        # A document's distinct words, then its distinct rows of the table.
        word = np.unique(doc * len(w.features) + w.sequence)
        row = np.unique((word // len(w.features))[:, None] * (ROWS + 1) + w.features[word % len(w.features)]) % (ROWS + 1)
        seen += np.bincount(row, minlength=ROWS + 1)


def _living(seen: np.ndarray) -> np.ndarray:
    live = seen >= MIN_DOCS
    live[ROWS] = False
    return live


def _passed(m: Model, texts: pa.Array, y: np.ndarray, past: dict, live: np.ndarray, order: np.ndarray) -> Model:
    """One pass over the texts in an order; arrays of the model and past are changed in place."""
    texts, y = texts.take(pa.array(order)), y[order]
    for p in _pieces(texts):
        m = _step(m, encode(texts[p]), y[p], past, live)
    return m


def _begin(live: np.ndarray, seed: int) -> tuple[Model, dict]:
    """A model before training, and its sums of squared gradients."""
    m = _start(seed)
    m.table[~live] = 0
    past: dict = {"table": np.full((ROWS + 1, WIDTH), 1e-6, np.float32), "out": np.zeros_like(m.out)}
    for i in range(len(WIDTHS)):
        past |= {f"shift{i}": np.zeros_like(m.shift[i]), f"filter{i}": np.zeros_like(m.filters[i])}
    return m, past


def train(texts: pa.Array, labels: np.ndarray, lang: list[str | None], toxic: int, clean: int, seed: int = 11) -> Model:
    """fit() for rows in memory, as one shard, every fifth held back; toxic and clean count the labels that these rows stand for."""
    y = labels.astype(np.float32)
    if not y.any() or y.all():
        return _even(toxic, clean, seed)
    held = np.arange(len(y)) % 5 == 4
    learn, kept = np.flatnonzero(~held), np.flatnonzero(held)
    seen = np.zeros(ROWS + 1, np.int64)
    _counted(texts.take(pa.array(learn)), seen)
    live = _living(seen)
    m, past = _begin(live, seed)
    r = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        m = _passed(m, texts, y, past, live, r.permutation(learn))
    back = texts.take(pa.array(kept))
    z = np.concatenate([np.zeros(0), *(logits(m, encode(back[p])) for p in _pieces(back))])
    # The rows may have the labels in other shares than what they stand for: log of (clean per clean row) / (toxic per toxic row).
    shift = float(np.log((clean / max(1, (y == 0).sum())) / (toxic / max(1, y.sum()))))
    return _calibrated(m, z, y[kept].astype(np.float64), [lang[k] for k in kept], shift)


def _dense(m: Model, past: dict) -> list[np.ndarray]:
    """What is not in the table; the bias last."""
    names = ["out", *(f"{n}{i}" for i in range(len(WIDTHS)) for n in ("shift", "filter"))]
    return [m.out, *m.shift, *m.filters, *(past[n] for n in names), np.array([m.bias])]


def _changes(m: Model, past: dict, before: Model, past_before: dict, rows: int) -> list[tuple[int, int, bytes]]:
    """(block, rows learned from, data): rows of the table that moved with their changes, and all else whole in block -1."""
    out = [(-1, rows, np.concatenate([a.ravel().astype(np.float64) for a in _dense(m, past)]).tobytes())]
    moved = np.flatnonzero((past["table"] != past_before["table"]).any(axis=1))
    change = np.concatenate([m.table[moved] - before.table[moved], past["table"][moved] - past_before["table"][moved]], axis=1)
    cuts = np.searchsorted(moved, np.arange(0, ROWS + 1, BLOCK))
    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i < j:
            out.append((b, rows, moved[i:j].astype(np.int32).tobytes() + change[i:j].tobytes()))
    return out


def _read_change(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (4 + 8 * WIDTH)
    return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, 2 * WIDTH * n, 4 * n).reshape(n, 2 * WIDTH)


def _averaged(block: int, parts: list[tuple[int, bytes]]) -> bytes:
    """The changes of several shards, (rows, data) each, as one."""
    if block < 0:
        return np.average([np.frombuffer(d) for _, d in parts], axis=0, weights=[n for n, _ in parts]).tobytes()
    total, weight = np.zeros((BLOCK, 2 * WIDTH)), np.zeros(BLOCK)
    for n, d in parts:
        row, change = _read_change(d)
        total[row % BLOCK] += n * change.astype(np.float64)
        weight[row % BLOCK] += n
    own = np.flatnonzero(weight)
    return (own + block * BLOCK).astype(np.int32).tobytes() + (total[own] / weight[own, None]).astype(np.float32).tobytes()


def _changed(m: Model, past: dict, averages: list[tuple[int, bytes]]) -> Model:
    """The model after a pass; arrays are changed in place."""
    for block, data in averages:
        if block < 0:
            value, at = np.frombuffer(data), 0
            for a in _dense(m, past)[:-1]:
                a[...] = value[at : at + a.size].reshape(a.shape)
                at += a.size
            m = m._replace(bias=float(value[-1]))
        else:
            row, change = _read_change(data)
            m.table[row] += change[:, :WIDTH]
            past["table"][row] += change[:, WIDTH:]
    return m


def join(parts: list[Words]) -> Words:
    """Words of several encodings as one."""
    features, sequence, starts, n, at = [], [], [], 0, 0
    for p in parts:
        features.append(p.features)
        sequence.append(p.sequence + n)
        starts.append(p.starts + at)
        n += len(p.features)
        at += len(p.sequence)
    return Words(np.concatenate(features), np.concatenate(sequence), np.concatenate(starts))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@contextlib.contextmanager
def _sent(spark: SparkSession, value: Any) -> Iterator[Broadcast]:
    """The value as a broadcast whose files go at the end: those that Spark makes of large closures stay with the session."""
    sent = spark.sparkContext.broadcast(value)
    try:
        yield sent
    finally:
        sent.destroy()


def _learned(rows: DataFrame, m: Model, past: dict, live: np.ndarray, number: int) -> Model:
    """One pass over rows(text, toxic, held) whose partitions are shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, (m, past, live) = TaskContext.get().partitionId(), sent.value
        own, before = m._replace(table=m.table.copy(), filters=[f.copy() for f in m.filters], shift=[b.copy() for b in m.shift], out=m.out.copy()), {k: v.copy() for k, v in past.items()}
        done, r = 0, np.random.default_rng([number, shard])
        for b in batches:
            b = b.filter(pc.invert(b.column("held")))
            own = _passed(own, b.column("text"), b.column("toxic").to_numpy().astype(np.float32), before, live, r.permutation(len(b)))
            done += len(b)
        if done:
            block, n, data = zip(*_changes(own, before, m, past, done), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([shard] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["block", "shard", "n", "data"])

    def average(own: pa.Table) -> pa.Table:
        own, block = own.sort_by("shard"), own["block"][0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([_averaged(block, list(zip(own["n"].to_pylist(), own["data"].to_pylist(), strict=True)))], pa.binary())})

    with _sent(rows.sparkSession, (m, past, live)) as sent:
        parts = rows.mapInArrow(run, "block int, shard int, n long, data binary")
        averages = parts.groupBy("block").applyInArrow(average, "block int, data binary").collect()
    return _changed(m, past, [(x["block"], bytes(x["data"])) for x in averages])


def _touched(rows: DataFrame) -> np.ndarray:
    """How many training documents touch each row of the table, at least; exact below MIN_DOCS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS + 1, np.int64)
        for b in batches:
            _counted(b.filter(pc.invert(b.column("held"))).column("text"), seen)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(seen, MIN_DOCS).astype(np.uint8).tobytes()], pa.binary())], ["seen"])

    seen = np.zeros(ROWS + 1, np.int64)
    for x in rows.mapInArrow(run, "seen binary").collect():
        seen += np.frombuffer(x["seen"], np.uint8)
    return seen


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(ID_BITS))


def _places(known: DataFrame) -> np.ndarray:
    """The bits of known(label_id), a Bloom filter of one hash."""

    def pack(own: pa.Table) -> pa.Table:
        block, bits = own["block"][0].as_py(), np.zeros(BLOCK, bool)
        bits[own["place"].to_numpy() % BLOCK] = True
        return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    places = known.select(_place(F.col("label_id")).alias("place")).distinct().withColumn("block", F.floor(F.col("place") / BLOCK))
    mask = np.zeros(ID_BITS // 8, np.uint8)
    for x in places.groupBy("block").applyInArrow(pack, "block long, bits binary").collect():
        mask[x["block"] * (BLOCK // 8) : (x["block"] + 1) * (BLOCK // 8)] = np.frombuffer(x["bits"], np.uint8)
    return mask


def _perhaps(mask: Broadcast) -> Callable[[Column], Column]:
    """Whether an id may have a label, so that few texts without one are shuffled."""

    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array(mask.value[at >> 3] << (at & 7).astype(np.uint8) & 128 > 0)

    found = F.arrow_udf(held, "boolean")
    return lambda doc_id: found(_place(doc_id))


def _binned(rows: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """Log odds, label, language and count of the rows held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("held"))
            z = np.concatenate([np.zeros(0), *(logits(sent.value, encode(b.column("text")[p])) for p in _pieces(b.column("text")))])
            place = np.clip(np.rint(z * BINS), -LAST_BIN, LAST_BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(place)], ["lang", "toxic", "bin"])

    with _sent(rows.sparkSession, m) as sent:
        found = rows.mapInArrow(run, "lang string, toxic int, bin int").groupBy("lang", "toxic", "bin").count().orderBy("lang", "toxic", "bin").toArrow()
    z, y, n = (found[c].to_numpy().astype(np.float64) for c in ("bin", "toxic", "count"))
    return z / BINS, y, found["lang"].to_pylist(), n


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, seed: int = 11) -> Model:
    """docs(doc_id, text, lang), labels(doc_id, toxic); learn: which ids of labels to learn from (all)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    if learn is not None:
        known = known.filter(learn)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return _even(toxic, clean, seed)
    shards = min(MOST_SHARDS, -(-(toxic + clean) // SHARD_ROWS))
    texts = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null")
    held = F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(5)) == 4
    with _sent(docs.sparkSession, _places(known)) as mask:
        if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:  # hashes of other types differ
            texts = texts.filter(_perhaps(mask)(F.col("doc_id")))
        # Dealt by id, whatever the sizes: texts of one label that lie together in the files don't make a shard.
        rows = texts.repartition(shuffle_partitions(docs.sparkSession), "doc_id").join(known.hint("merge"), F.col("doc_id") == F.col("label_id"))
        rows = rows.sortWithinPartitions(F.xxhash64("label_id", F.lit(7)), "label_id", "text", "toxic").select("text", "lang", "toxic", held.alias("held"))
        kept = saved(rows)
    rows = kept.coalesce(shards)
    live = _living(_touched(rows))
    m, past = _begin(live, seed)
    for number in range(EPOCHS):
        m = _learned(rows, m, past, live, number)
    del past
    z, y, lang, count = _binned(rows, m)
    model = _calibrated(m, z, y, lang, 0.0, count)
    forget(kept)
    del rows, kept
    release_memory()
    return model


class Scored(NamedTuple):
    rows: DataFrame  # all columns of the documents and the three below
    score: str
    threshold: str
    rejected: str


def score(docs: DataFrame, m: Model) -> Scored:
    """docs(doc_id, text, lang, ...) with a score (double), its language's threshold (double) and whether it reaches that (boolean)."""
    names, added = docs.columns, fresh(docs, "score", "threshold", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lang = b.column(names.index("text")), b.column(names.index("lang")).to_pylist()
            ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False))
            got, i = [], 0
            while i < len(b):
                done = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + SCORED, "right")))
                got.append(scores(m, encode(text[i:j])))
                i = j
            s = np.concatenate([np.zeros(0), *got])
            t = np.array([m.thresholds.get(x, m.common) for x in lang], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(t), pa.array(s >= t)], [*names, *added])

    schema = StructType([*docs.schema.fields, StructField(added[0], DoubleType()), StructField(added[1], DoubleType()), StructField(added[2], BooleanType())])
    return Scored(docs.mapInArrow(run, schema), *added)
