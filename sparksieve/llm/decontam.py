"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Words are runs of letters and digits, lower-cased; shingles are five words (fewer words: all of them).  A
document matches an item if one of its windows, with as many shingles as the item (or the whole document, if
that is shorter), has weighted Jaccard similarity of SIMILARITY or more with it: shingles weigh as often as
they occur, so it is the sum of the smaller counts over the sum of the larger ones.

1. A window of m shingles and an item of n can only reach similarity s if m (n + m) / (1 + s) of them are
   shared, so only windows with that many shingles of any item are looked at; running sums find them.
2. Their SimHash fingerprints (64 bits) are looked up among the items' of that size.  The index has eight blocks
   of eight bits; an item is listed under all block values within two bits of its own, so each item within
   23 bits shares a list in one block at least (24 differing bits would need three in every block).  tests/llm
   measures how many windows of similarity 0.8 to 0.85 are within that radius.
3. Exact weighted similarity decides about what is found.

The benchmark is the query set: it is read in blocks of BLOCK_BYTES at most, each of which is sent to the
executors once and meets all documents.  Documents are not shuffled.

Cases: null and empty texts have no words and match nothing, also not an empty item; texts with fewer than five
words match items of the very same words; repeated documents give repeated matches, items of one id and text are one
(so that blocks by hash have an even size); a null id stays null; extra columns are left out (or kept, by without_benchmark); no documents or no items give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import hash_words, shingle_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of item texts in a block of the benchmark, at most (one item may be larger).
BLOCK_BYTES = 4 << 20
#: Blocks of a fingerprint, and differing bits of a block that are looked up.
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Bytes of text, and windows, that are worked on at a time.
READ, WINDOWS = 1 << 20, 4096
SIEVE_BITS = 22

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = False

MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


class Shingles(NamedTuple):
    hashes: np.ndarray
    first: np.ndarray  # where each text's shingles begin, one more at the end
    words: np.ndarray  # number of words of each text


def shingles(texts: pa.Array) -> Shingles:
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data = np.frombuffer(b"\n".join(t.as_buffer().to_pybytes() for t in texts) + b"\n", np.uint8)
    cuts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    starts, ends = words_of(data, cuts, _OUTSIDE)
    word = hash_words(data, starts, ends, 0xDEC0)
    begin = np.searchsorted(starts, cuts)
    return Shingles(*shingle_hashes(word, begin, SHINGLE), np.diff(begin))


def simhash(bits: np.ndarray) -> np.ndarray:
    """Fingerprints from (..., 64) counts of set bits less half the shingles."""
    return np.packbits(bits > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def needed(window: int, item: int) -> int:
    """Shingles that a window must share with an item to be similar."""
    return int(np.ceil(SIMILARITY * (window + item) / (1 + SIMILARITY) - 1e-9))


class Index(NamedTuple):
    ids: list[int | None]
    bags: list[dict[int, int]]
    sizes: dict[int, tuple[np.ndarray, np.ndarray, list[dict[int, list[int]]]]]  # shingles -> (items, fingerprints, lists by block value)
    known: np.ndarray  # sorted hashes of all items' shingles
    sieve: np.ndarray


def build_index(ids: list[int | None], texts: pa.Array) -> Index:
    s = shingles(texts)
    bags, prints, by_size = [], [], {}
    for i in range(len(ids)):
        own = s.hashes[s.first[i] : s.first[i + 1]]
        key, count = np.unique(own, return_counts=True)
        bags.append(dict(zip(key.tolist(), count.tolist(), strict=True)))
        prints.append(simhash(_bits(own).sum(axis=0)[None])[0] if len(own) else np.uint64(0))
        if len(own):
            by_size.setdefault(len(own), []).append(i)
    near = [v for v in range(256) if v.bit_count() <= BLOCK_RADIUS]
    sizes = {}
    for n, items in sorted(by_size.items()):
        own = np.array([prints[i] for i in items], np.uint64)
        lists: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for k, x in enumerate(own.view(np.uint8).reshape(-1, 8).tolist()):
            for b in range(BLOCKS):
                for v in near:
                    lists[b].setdefault(x[b] ^ v, []).append(k)
        sizes[n] = np.array(items), own, lists
    known = np.unique(s.hashes)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(known >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    return Index(ids, bags, sizes, known, sieve)


def _similarity(window: np.ndarray, bag: dict[int, int], size: int) -> float:
    key, count = np.unique(window, return_counts=True)
    shared = sum(min(c, bag.get(k, 0)) for k, c in zip(key.tolist(), count.tolist(), strict=True))
    return shared / (len(window) + size - shared)


def _in_document(index: Index, own: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first shingle, shingles) of each item's best window; the first of equals."""
    total = np.concatenate([[0], np.cumsum(hit)])
    for n, (items, prints, lists) in index.sizes.items():
        m = min(n, len(own))
        if total[-1] < needed(m, n) or m < SIMILARITY * n:
            continue
        at = np.flatnonzero(total[m:] - total[:-m] >= needed(m, n))
        best: dict[int, tuple[float, int]] = {}
        for i in range(0, len(at), WINDOWS):
            part = at[i : i + WINDOWS]
            for run in np.split(part, np.flatnonzero(np.diff(part) > m) + 1):
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(own[run[0] : run[-1] + m]), axis=0)])
                marks = simhash(sums[run - run[0] + m] - sums[run - run[0]])
                for w, mark, block in zip(run.tolist(), marks, marks.view(np.uint8).reshape(-1, 8).tolist(), strict=True):
                    for k in {k for b, v in enumerate(block) for k in lists[b].get(v, ())}:
                        if int(prints[k] ^ mark).bit_count() <= RADIUS:
                            s = _similarity(own[w : w + m], index.bags[items[k]], n)
                            if s >= SIMILARITY - 1e-12 and s > best.get(k, (0.0, 0))[0]:
                                best[k] = s, w
        for k, (s, w) in best.items():
            yield int(items[k]), s, w, m


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of all texts that match an item."""
    out, i = [], 0
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    while i < len(texts):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + READ, "right")))
        s = shingles(texts[i:j])
        hit = index.sieve[(s.hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
        maybe = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(index.known, s.hashes[maybe]), max(0, len(index.known) - 1))
        hit[maybe] = index.known[place] == s.hashes[maybe] if len(index.known) else False
        upto = np.concatenate([[0], np.cumsum(hit)])
        for k in np.flatnonzero(upto[s.first[1:]] > upto[s.first[:-1]]).tolist():
            a, b = s.first[k], s.first[k + 1]
            for item, similarity, w, m in _in_document(index, s.hashes[a:b], hit[a:b]):
                out.append((i + k, item, similarity, w, min(int(s.words[k]) - w, m + SHINGLE - 1)))
        i = j
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's items in blocks of a checked size, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) * (1 if size <= block_bytes else 2)  # twice as many: blocks by hash are uneven
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = own.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if len(rows):
            yield build_index(rows["item_id"].to_pylist(), pa.concat_arrays(rows["text"].chunks))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> a row for each document and item that match, with the best window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], MATCHES)
    for index in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = matches(index, b.column(1))
                ids = b.column(0).take(pa.array([x[0] for x in got], pa.int64()))
                items = pa.array([index.ids[x[1]] for x in got], pa.int64())
                rest = [pa.array([x[k] for x in got], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, items, *rest], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.unionByName(rows.mapInArrow(run, MATCHES))
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that match an item, all columns as they are."""
    text = docs.columns.index("text")
    for index in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[x[0] for x in matches(index, b.column(text))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
