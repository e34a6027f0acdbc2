"""Language-model scoring by context-tree weighting over bytes.

The model predicts each byte of a lower-cased (A-Z) text, and an end mark after the last, from up to DEPTH bytes
before it (end marks before the first).  A byte is eight binary decisions; each decision has, for every length
of context from 0 to DEPTH, a Krichevsky-Trofimov estimate of its counts, and all lengths are mixed with the
weights of context-tree weighting: P_w = (P_e + product of the children's P_w) / 2, at depth DEPTH P_w = P_e.
A text's score is the log10 of its probability; divided by log10(2) and its bytes it is the code length per byte.

Counts come from all training texts.  Chunks send their distinct (context, byte) strings with counts; a bucket
holds all strings of the contexts it owns, with their whole subtrees.  A bucket owns contexts by a hash of their last
two bytes, but contexts that hold more than 1 / SHARE of the chunks' strings are split by one byte more, as often as
needed, so a common pair of bytes doesn't meet in one bucket.  Depths 0 and 1 have at most 257 contexts, and fewer
than 2 * SHARE are split at each depth, each with 255 decisions: their sums over buckets are of bounded number, come
to the driver and go out with the second pass, in which buckets answer each chunk's strings with log probabilities.
So the tables of contexts grow with the corpus and are never in one place.  What is split changes no score.

A word model goes with it as a base line: additive smoothing over words and one end mark a text.

Cases: null and empty texts are an end mark only; no training text gives every byte and word the estimates of
no counts; a null id counts as training; repeated rows are rows of their own; extra columns are left out; no
rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Answers, Texts, answer, ask, buckets, chunk_words, chunked, finish, groups, lower_ascii, mix64, planes, split_sorted, unplanes
from .common import saved

DEPTH = 5
END = 0xFF  # no byte of UTF-8
#: Bytes of text whose strings are counted at a time.
COUNTED = 1 << 21
#: A context with this part of all strings or more is split over buckets.
SHARE = 512

SCHEMA = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(texts: Texts, n: int) -> np.ndarray:
    """Documents whose id's crc32 (as text) is 0 modulo n; not those without an id."""
    return np.array([not null and zlib.crc32(str(i).encode()) % n == 0 for i, null in zip(texts.ids.tolist(), texts.null.tolist(), strict=True)], bool)


def _slices(texts: Texts) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(texts.offsets, texts.offsets[i] + COUNTED, "right")) - 1)
        yield i, j
        i = j


def strings(texts: Texts, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents [i, j), their (context, byte) strings as numbers, the latest context byte on top; and where each document begins."""
    at = texts.offsets[i : j + 1] - texts.offsets[i]
    size = np.diff(at)
    data = np.full(int(at[-1]) + (j - i) * (DEPTH + 1) + DEPTH, END, np.uint8)
    shift = (np.arange(j - i) + 1) * DEPTH + np.arange(j - i)  # padding before a document, and earlier end marks
    data[np.arange(int(at[-1])) + np.repeat(shift, size)] = lower_ascii(texts.data[texts.offsets[i] : texts.offsets[j]])
    key = np.zeros(len(data) - DEPTH, np.uint64)
    for d in range(1, DEPTH + 1):
        key |= data[DEPTH - d : len(data) - d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    key |= data[DEPTH:]
    # Of a document's size + 1 + DEPTH places (bytes, end mark, the next one's padding) the first size + 1 count.
    places = np.arange(int(size.sum()) + j - i) + np.repeat(np.arange(j - i) * DEPTH, size + 1)
    return key[places], np.concatenate([[0], np.cumsum(size + 1)])


def counted(texts: Texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a chunk, sorted, and how often each stands in training documents."""
    found, counts = [], []
    for i, j in _slices(texts):
        key, first = strings(texts, i, j)
        key = np.sort(key << np.uint64(1) | np.repeat(train[i:j], np.diff(first)).astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(new, len(key)))
        found.append(key[new] >> np.uint64(1))
        counts.append(np.where(key[new] & np.uint64(1), count, 0))
    return _summed(np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *counts]))


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(count[order], new)


def _packed(key: np.ndarray, count: np.ndarray, shift: int) -> bytes:
    raw = planes(key << np.uint64(shift), 8 - shift // 8) + planes(count.astype(np.uint64))
    return len(key).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, shift: int) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(blob[:8], "big"), 8 - shift // 8
    raw = pa.decompress(blob[8:], decompressed_size=n * (wide + 8), codec="zstd", asbytes=True)
    return unplanes(raw[: n * wide], np.uint64, wide) >> np.uint64(shift), unplanes(raw[n * wide :], np.uint64).astype(np.int64)


STRING_SHIFT = 64 - 8 * (DEPTH + 1)


#: Contexts that are split, sorted, by their depth (2 to DEPTH - 1).
Split = dict[int, np.ndarray]


def context(key: np.ndarray, depth: int) -> np.ndarray:
    return key >> np.uint64(8 * (DEPTH + 1 - depth))


def common_contexts(chunks: DataFrame, hold_out: int, share: int = SHARE) -> Split:
    """All contexts with 1 / share of the chunks' distinct strings or more, and none with half of that or less.

    A chunk names those with half of that part of its own strings, so no more than 2 * share a depth; what a context
    has in chunks that don't name it is less than half of 1 / share of all.
    """

    def count(texts: Texts, _: Answers) -> Iterator[pa.RecordBatch]:
        key, _ = counted(texts, ~held_out(texts, hold_out))
        rows = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(key)]))]
        for d in range(2, DEPTH):
            new = np.flatnonzero(groups(context(key, d)))
            size = np.diff(np.append(new, len(key)))
            own = new[2 * share * size >= len(key)]
            rows.append((np.full(len(own), d), context(key[own], d).astype(np.int64), size[2 * share * size >= len(key)]))
        depth, at, size = (np.concatenate(c) for c in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["depth", "context", "n"])

    named = saved(finish(chunks, [], count, "depth int, context long, n long").groupBy("depth", "context").agg(F.sum("n").alias("n")))
    total = sum(r.n for r in named.where("depth = 0").collect())
    rows = named.where((F.col("depth") > 0) & (F.col("n") * (2 * share) > total)).collect()
    return {d: np.array(sorted(r.context for r in rows if r.depth == d), np.uint64) for d in range(2, DEPTH)}


def roots(key: np.ndarray, split: Split) -> np.ndarray:
    """The depth of the context by which each string's bucket is chosen: the least that isn't split."""
    depth = np.full(len(key), 2)
    for d in range(2, DEPTH):
        if len(split[d]):
            depth[(depth == d) & np.isin(context(key, d), split[d])] += 1
    return depth


def by_bucket(key: np.ndarray, n: int, split: Split) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts strings of a bucket together, and the buckets' offsets in it."""
    depth = roots(key, split)
    owner = (key >> (np.uint64(8) * (DEPTH + 1 - depth).astype(np.uint64))) << np.uint64(3) | depth.astype(np.uint64)
    bucket = (mix64(owner) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series after ten steps up."""
    low = np.zeros_like(x)
    small = x < 10
    for k in range(10):
        low += np.where(small, np.log(np.where(small, x + k, 1.0)), 0.0)
    z = np.where(small, x + 10, x)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


class Level:
    """The decisions of one bit of strings of a bucket, at depths `least` to DEPTH."""

    def __init__(self, key: np.ndarray, count: np.ndarray, bit: int, least: int):
        self.least = least
        byte = (key & np.uint64(0xFF)).astype(np.int64)
        self.bit = (byte >> (7 - bit)) & 1
        self.node = (1 << bit) | (byte >> (8 - bit))
        zeros, ones = count * (1 - self.bit), count * self.bit
        self.own, self.zeros, self.ones, self.log_e, self.below = {}, {}, {}, {}, {}
        weighted = None
        for d in range(DEPTH, least - 1, -1):
            _, own = np.unique(context(key, d) << np.uint64(8) | self.node.astype(np.uint64), return_inverse=True)
            n = int(own.max()) + 1
            self.own[d] = own
            self.zeros[d], self.ones[d] = np.bincount(own, zeros, n), np.bincount(own, ones, n)
            self.log_e[d] = estimate(self.zeros[d], self.ones[d])
            if weighted is None:
                weighted = self.log_e[d]
            else:
                parent = np.zeros(len(weighted), np.int64)
                parent[self.own[d + 1]] = own
                self.below[d] = np.bincount(parent, weighted, n)
                weighted = np.logaddexp(self.log_e[d], self.below[d]) - np.log(2)
        self.weighted = weighted  # of depth `least`

    def chance(self, d: int) -> np.ndarray:
        """The estimate, at depth d, of each string's bit."""
        zeros, ones = self.zeros[d][self.own[d]], self.ones[d][self.own[d]]
        return (np.where(self.bit > 0, ones, zeros) + 0.5) / (zeros + ones + 1.0)

    def mixed(self) -> np.ndarray:
        """The probability of each string's bit, mixed over depths `least` to DEPTH."""
        q = self.chance(DEPTH)
        for d in range(DEPTH - 1, self.least - 1, -1):
            stop = sigmoid(self.log_e[d] - self.below[d])[self.own[d]]
            q = stop * self.chance(d) + (1 - stop) * q
        return q


def _by_root(key: np.ndarray, split: Split) -> Iterator[tuple[int, np.ndarray]]:
    """Depths of roots, and which strings have them."""
    depth = roots(key, split)
    for d in np.unique(depth).tolist():
        yield d, np.flatnonzero(depth == d)


def tops(key: np.ndarray, count: np.ndarray, split: Split) -> tuple[np.ndarray, ...]:
    """What a bucket adds to the contexts above its own: (depth, context, decision, zeros, ones, log of the product of the children's P_w)."""
    out = []
    for least, some in _by_root(key, split):
        for bit in range(8):
            v = Level(key[some], count[some], bit, least)
            first = np.zeros(len(v.weighted), np.int64)
            first[v.own[least]] = (context(key[some], least - 1).astype(np.int64) << 8) | v.node
            at, own = np.unique(first, return_inverse=True)
            out.append((np.full(len(at), least - 1), at >> 8, at & 255, *(np.bincount(own, x, len(at)) for x in (v.zeros[least], v.ones[least], v.weighted))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Top:
    """Depths 0 and 1 of the tree, and the split contexts below."""

    def __init__(self, rows: list[tuple[int, int, int, float, float, float]], split: Split):
        self.split = split
        self.contexts = {0: np.zeros(1, np.uint64), 1: np.arange(256, dtype=np.uint64), **split}
        self.zeros, self.ones, below, self.stop = ({d: np.zeros((len(c), 256)) for d, c in self.contexts.items()} for _ in range(4))
        for depth, at, node, zeros, ones, log in rows:
            place = int(np.searchsorted(self.contexts[depth], np.uint64(at)))
            self.zeros[depth][place, node] += zeros
            self.ones[depth][place, node] += ones
            below[depth][place, node] += log
        for d in range(DEPTH - 1, -1, -1):
            log_e = estimate(self.zeros[d], self.ones[d])
            self.stop[d] = sigmoid(log_e - below[d])
            if d:
                parent = np.searchsorted(self.contexts[d - 1], self.contexts[d] >> np.uint64(8))
                for above, own in ((self.zeros, self.zeros[d]), (self.ones, self.ones[d]), (below, np.logaddexp(log_e, below[d]) - np.log(2))):
                    np.add.at(above[d - 1], parent, own)

    def mix(self, key: np.ndarray, least: int, node: np.ndarray, bit: np.ndarray, q: np.ndarray) -> np.ndarray:
        for d in range(least - 1, -1, -1):
            row = np.searchsorted(self.contexts[d], context(key, d))
            zeros, ones, stop = self.zeros[d][row, node], self.ones[d][row, node], self.stop[d][row, node]
            q = stop * (np.where(bit > 0, ones, zeros) + 0.5) / (zeros + ones + 1.0) + (1 - stop) * q
        return q


def log_probabilities(key: np.ndarray, count: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each string's byte after its context."""
    total = np.zeros(len(key))
    for least, some in _by_root(key, top.split):
        for bit in range(8):
            v = Level(key[some], count[some], bit, least)
            total[some] += np.log10(top.mix(key[some], least, v.node, v.bit, v.mixed()))
    return total


def _merged(blobs: list[bytes], shift: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    lists = [_unpacked(b, shift) for b in blobs]
    key, count = _summed(np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists]))
    return key, count, [k for k, _ in lists]


class Lookup:
    """Places of numbers in a sorted list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(len(keys) * 3).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free][::-1]] = left[free][::-1]
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x must be in the list."""
        slot = self._slot(x)
        out = self.table[slot]
        left = np.flatnonzero(self.keys[out] != x)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[left] = self.table[slot]
            wrong = self.keys[out[left]] != x[left]
            left, slot = left[wrong], slot[wrong]
        return out


def distinct_words(texts: Texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes with training counts; all words' places among them; where documents begin."""
    words, first = chunk_words(texts, lower=True)
    keys, place = np.unique(words, return_inverse=True)
    count = np.bincount(place, np.repeat(train, np.diff(first)), len(keys)).astype(np.int64)
    return keys, count, place, first


def score_texts(docs: DataFrame, hold_out: int = 10, share: int = SHARE) -> DataFrame:
    """docs(doc_id, text) -> SCHEMA: documents whose id's crc32 is not 0 modulo hold_out are learned from, all are scored."""
    n = buckets(docs)
    chunks = chunked(docs)
    split = common_contexts(chunks, hold_out, share)

    def ask_strings(texts: Texts, _: Answers) -> Iterator[tuple[int, bytes]]:
        key, count = counted(texts, ~held_out(texts, hold_out))
        order, cuts = by_bucket(key, n, split)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            yield k, _packed(key[own], count[own], STRING_SHIFT)

    def ask_words(texts: Texts, _: Answers) -> Iterator[tuple[int, bytes]]:
        key, count, *_ = distinct_words(texts, ~held_out(texts, hold_out))
        cuts = split_sorted(key, n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            yield k, _packed(key[own], count[own], 0)

    asked_strings, asked_words = saved(ask(chunks, [], ask_strings)), saved(ask(chunks, [], ask_words))
    above = _by_bucket(asked_strings, n, lambda blobs: tops(*_merged(blobs, STRING_SHIFT)[:2], split), "depth int, context long, node int, zeros double, ones double, log double")
    top = Top([tuple(r) for r in above.groupBy("depth", "context", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log")).collect()], split)

    def totals(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        _, count, _ = _merged(blobs, 0)
        return np.array([count.sum()]), np.array([(count > 0).sum()])

    words, distinct = _by_bucket(asked_words, n, totals, "words long, distinct long").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    trained = docs.select(F.count_if(F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % hold_out != 0, F.lit(True)))).first()[0]
    tokens, vocabulary = words + trained, distinct + (trained > 0)

    def reply_strings(blobs: list[bytes]) -> list[bytes]:
        key, count, lists = _merged(blobs, STRING_SHIFT)
        log = log_probabilities(key, count, top).astype(np.float32)
        return [log[np.searchsorted(key, own)].tobytes() for own in lists]

    def reply_words(blobs: list[bytes]) -> list[bytes]:
        key, count, lists = _merged(blobs, 0)
        return [planes(count[np.searchsorted(key, own)].astype(np.uint64)) for own in lists]

    def done(texts: Texts, got: Answers) -> Iterator[pa.RecordBatch]:
        held = held_out(texts, hold_out)
        keys, _ = counted(texts, ~held)
        order, cuts = by_bucket(keys, n, split)
        log = np.zeros(len(keys), np.float64)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            log[order[cuts[k] : cuts[k + 1]]] = np.frombuffer(got[0][k], np.float32)
        place, score = Lookup(keys), []
        for i, j in _slices(texts):
            key, first = strings(texts, i, j)
            score.append(np.add.reduceat(log[place(key)], first[:-1]))
        distinct_keys, _, word, first = distinct_words(texts, ~held)
        cuts = split_sorted(distinct_keys, n)
        count = np.concatenate([np.zeros(0, np.uint64), *(unplanes(got[1][k], np.uint64) for k in np.flatnonzero(np.diff(cuts)).tolist())]).astype(np.float64)
        scale = tokens + 0.1 * (vocabulary + 1)
        each = np.concatenate([[0.0], np.cumsum(np.log10((count + 0.1) / scale)[word])])
        known = np.concatenate([[0], np.cumsum((count > 0)[word])])
        base = each[first[1:]] - each[first[:-1]] + np.log10((trained + 0.1) / scale)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(texts.ids, pa.int64(), mask=texts.null), pa.array(held), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(np.diff(first) + 1, pa.int64()),
                pa.array(known[first[1:]] - known[first[:-1]] + (trained > 0), pa.int64()), pa.array(np.full(len(texts), tokens), pa.int64()), pa.array(base), pa.array(np.concatenate([np.zeros(0), *score])),
            ],
            ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return finish(chunks, [answer(asked_strings, reply_strings, n), answer(asked_words, reply_words, n)], done, SCHEMA)


def _by_bucket(asked: DataFrame, n: int, f: Callable[[list[bytes]], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """f of each bucket's blobs, as rows."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blobs.setdefault(k, []).append(blob)
        for own in blobs.values():
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(f(own), kinds, strict=True)], names)

    return asked.select("bucket", "blob").repartitionById(n, "bucket").mapInArrow(run, schema)
