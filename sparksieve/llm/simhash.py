"""SimHash near-dedup, by anchor points of a covering code.

A document's fingerprint has 64 bits, the majority of the bits of its shingles' XXH64 (seed 42).  Two
fingerprints link if they differ in at most two bits, and links' components are groups of copies.

The anchors are the code words of a product code: nine perfect Hamming codes of length 7 and one free bit.
Every 64-bit word has one home, the code word that its blocks decode to, at most one bit away in each block.
If x and y differ in two bits or fewer, a word z is within one bit of both, and the anchor home(z) is within
the covering radius plus one of both.  So each fingerprint goes to the homes of itself and of its 64
one-bit neighbours (25 anchors or so), and at an anchor, x and y link exactly if they have such a neighbour
z in common.  At most 65 fingerprints can share a z, so comparing is a sort of these neighbours: linear in
the fingerprints of an anchor however many it has, with no pairs made.

Equal fingerprints are one row before anything is compared, so a group of copies of any size costs its
aggregation only.  Components are found in tables (components.py).

similar_groups() is for texts that share most words rather than nearly all: five-word shingles, similarity 0.8 or
more.  SimHash links of these shingles give the first candidates.  At similarity 0.8 fingerprints differ in more bits
than anchors can cover, so texts that agree on one of BANDS bands are candidates too, each band being ROWS least hashes
of the shingles (the k-th occurrence of a shingle is a shingle of its own); exact similarity decides about all.  A
least hash agrees with a chance equal to the similarity, wherever the texts differ, so a pair of similarity 0.8 is
missed with a chance of (1 - 0.8^5)^20, 0.035 %, be its difference scattered or in one piece.  Lists of candidates are
compared whole, by products of 0-1 matrices of shingles (64-bit hashes), without a row for a pair.

Cases: null and empty texts (no words) have fingerprint zero and link like any other, and are copies of each other;
fewer words than a shingle has are one shingle; repeated rows are rows of their own (one_of_each() keeps one); a
component's id is its smallest doc_id that is not null, or null if all are; extra columns are left out (one_of_each()
keeps all, whatever their names); no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import groups, hash_words, mix64, shingle_hashes, words_of
from .common import fresh, saved, shuffle_partitions
from .components import components

#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    import xxhash

    words, one = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(map(len, words), lambda a, n: a + n + 1)]
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.array([one(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=False)], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        count += np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, bits long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64), pa.int64())], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bits long")


def _nearest() -> np.ndarray:
    """The Hamming code word next to each 7-bit word: the XOR of its set bits' places (1 to 7) is the place to flip."""
    word = np.arange(128, dtype=np.uint64)
    place = np.zeros(128, np.uint64)
    for j in range(7):
        place ^= (word >> np.uint64(j) & np.uint64(1)) * np.uint64(j + 1)
    return np.where(place > 0, word ^ (np.uint64(1) << (place - np.uint64(place > 0))), word).astype(np.uint64)


def _homes(x: np.ndarray, nearest: np.ndarray, bits: int) -> np.ndarray:
    """Anchors of words whose lowest `bits` are coded in blocks of seven; the rest stays as it is."""
    coded = bits - bits % 7
    out = x & ~np.uint64((1 << coded) - 1)
    for k in range(0, coded, 7):
        out |= nearest[(x >> np.uint64(k) & np.uint64(127)).astype(np.intp)] << np.uint64(k)
    return out


def anchors(distinct: DataFrame, bits: int = 64) -> DataFrame:
    """(bits, id) -> (anchor, bits, id): each fingerprint at the homes of all words within one bit (of the lowest `bits`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, flips = _nearest(), np.array([0, *(1 << j for j in range(bits))], np.uint64)
        for b in batches:
            x, ids = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))
            for i in range(0, len(x), 4096):
                own = x[i : i + 4096]
                home = np.sort(_homes(own[:, None] ^ flips[None, :], nearest, bits), axis=1)
                new = np.ones(home.shape, bool)
                new[:, 1:] = home[:, 1:] != home[:, :-1]
                times = new.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home[new].view(np.int64)), pa.array(np.repeat(own, times).view(np.int64)), pa.array(np.repeat(ids[i : i + 4096], times))], ["anchor", "bits", "id"])

    return distinct.select("bits", "id").mapInArrow(run, "anchor long, bits long, id long")


def _neighbours(anchor: np.ndarray, x: np.ndarray, nearest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words within one bit of each x whose home is its anchor: (index of x, word)."""
    word = np.arange(128, dtype=np.uint64)
    flip = np.zeros((128, 128), np.uint64)  # [7-bit word, code word] -> bits of the word that lead there
    for j in range(7):
        flip[word.astype(np.intp), nearest[(word ^ np.uint64(1 << j)).astype(np.intp)].astype(np.intp)] |= np.uint64(1 << j)
    off, coded = anchor ^ _homes(x, nearest, bits), bits - bits % 7
    mask = np.zeros(len(x), np.uint64)
    for k in range(0, coded, 7):
        here = (off & ~(np.uint64(127) << np.uint64(k))) == 0
        got = flip[(x >> np.uint64(k) & np.uint64(127)).astype(np.intp), (anchor >> np.uint64(k) & np.uint64(127)).astype(np.intp)]
        mask |= np.where(here, got << np.uint64(k), np.uint64(0))
    for k in range(coded, bits):  # bits outside the blocks are their own code
        mask |= np.where(off == np.uint64(1 << k), np.uint64(1 << k), np.uint64(0))
    row, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    same = np.flatnonzero(off == 0)
    return np.concatenate([same, row]), np.concatenate([x[same], x[row] ^ (np.uint64(1) << bit.astype(np.uint64))])


def links(at_anchors: DataFrame, bits: int = 64) -> DataFrame:
    """(anchor, bits, id) -> (u, v): for each word that several fingerprints are near, their ids with the least of them."""
    n = shuffle_partitions(at_anchors.sparkSession)

    def compare(anchor: np.ndarray, x: np.ndarray, ids: np.ndarray, nearest: np.ndarray) -> pa.RecordBatch:
        index, z = _neighbours(anchor, x, nearest, bits)
        order = np.lexsort((ids[index], z))
        z, own = z[order], ids[index][order]
        new = np.ones(len(z), bool)
        new[1:] = z[1:] != z[:-1]
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(z) else own
        pair = np.stack([own, least], axis=1)[own != least]
        pair = np.unique(pair, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, left = _nearest(), [np.zeros(0, np.int64)] * 3
        for b in batches:  # sorted by anchor; an anchor's rows wait until all are there
            rows = [np.concatenate([y, np.asarray(b.column(i))]) for i, y in enumerate(left)]
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if whole:
                yield compare(rows[0][:whole].view(np.uint64), rows[1][:whole].view(np.uint64), rows[2][:whole], nearest)
            left = [r[whole:] for r in rows]
        if len(left[0]):
            yield compare(left[0].view(np.uint64), left[1].view(np.uint64), left[2], nearest)

    return at_anchors.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, bits, component_id (smallest doc_id that links reach)."""
    marked = saved(fingerprints(docs, shingle))
    distinct = saved(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(links(anchors(distinct.select("bits", F.col("bits").alias("id")))))
    named = distinct.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("bits").alias("b"), "component_id")
    return marked.join(of, F.col("bits") == F.col("b")).select("doc_id", "bits", "component_id")


#: Bands of a document and least hashes in each; words of a shingle, and the least similarity.
BANDS, ROWS, SHINGLE, SIMILARITY = 20, 5, 5, 0.8
#: Bytes of text whose words are hashed at a time; shingles whose BANDS * ROWS hashes are made at a time.
READ, HASHED = 1 << 18, 1 << 11
#: Shingles of a list's texts that are compared in one task; shingles that are compared at a time.
LIST, COLUMNS = 1 << 21, 1 << 11

MARKS = "doc_id long, raw string, copy binary, size long, print long, bands array<bigint>"


def _numbered(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes in which the k-th occurrence of a shingle in its document is one of its own; a document's stay together."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    place = np.arange(len(h))
    new = groups(h) | groups(d)
    return mix64(h + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a text's (numbered) shingles."""
    low = hashes.astype(np.uint32)
    factors = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), HASHED):
        np.minimum(least, (low[i : i + HASHED, None] * factors).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + column)
    return key.view(np.int64)


def _majority(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        count += np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def marks(texts: list[bytes]) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
    """Of each text: a digest of its words, the number of its shingles, their SimHash, and the keys of its bands."""
    import xxhash

    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= READ):
            size += len(texts[j])
            j += 1
        part = [t.lower() for t in texts[i:j]]
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        data = np.frombuffer(b"".join(part), np.uint8)
        starts, ends = words_of(data, cuts)
        hashes, first = shingle_hashes(hash_words(data, starts, ends, 0x51A5), np.searchsorted(starts, cuts), SHINGLE)
        numbered = _numbered(hashes, np.repeat(np.arange(len(part)), np.diff(first)))
        for k, t in enumerate(part):
            a, b = int(first[k]), int(first[k + 1])
            yield xxhash.xxh3_128_digest(b" ".join(t.split())), b - a, _majority(hashes[a:b]), band_keys(numbered[a:b])
        i = j


def marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> MARKS; raw is the text's own digest, copy that of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(marks([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(2).cast(pa.large_binary())]))
            columns = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array([x[3] for x in got], pa.list_(pa.int64()))], ["doc_id", "raw", "copy", "size", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("raw"), "text").mapInArrow(run, MARKS)


def exact_similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of five-word shingles, each as often as it occurs; texts without words are equal."""
    bags = []
    for t in (a, b):
        words = (t or "").encode().lower().split()
        bags.append(Counter(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))
    shared = sum((bags[0] & bags[1]).values())
    return shared / (sum(bags[0].values()) + sum(bags[1].values()) - shared)


def shingled(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, shingles binary): sorted hashes of the text's (numbered) shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(1).cast(pa.large_binary()):
                text = np.frombuffer((t.as_buffer().to_pybytes() if t.is_valid else b"").lower(), np.uint8)
                starts, ends = words_of(text, np.array([0, len(text)]))
                hashes, _ = shingle_hashes(hash_words(text, starts, ends, 0x51A5), np.array([0, len(starts)]), SHINGLE)
                got.append(np.sort(_numbered(hashes, np.zeros(len(hashes), np.int64))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of one and each of other have in common."""
    out = np.zeros((len(one), len(other)), np.float32)
    token, column = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(other)), [len(x) for x in (*one, *other)])
    again = np.bincount(column, minlength=len(token)) > 1  # what stands once is shared by none
    place = (np.cumsum(again) - 1)[column]
    keep = again[column]
    row, place = row[keep], place[keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for k in range(0, int(again.sum()), COLUMNS):
        own = slice(*np.searchsorted(place, [k, k + COLUMNS]))
        part = np.zeros((len(one) + len(other), COLUMNS), np.float32)
        part[row[own], place[own] - k] = 1
        out += part[: len(one)] @ part[len(one) :].T
    return out


def _classes(nodes: list[int], first: list[bool], shingles: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the similar texts of a list: those marked first are compared with all (and with each other)."""
    leads = [i for i, f in enumerate(first) if f]
    size = np.array([len(x) for x in shingles], np.float64)
    shared = _shared([shingles[i] for i in leads], shingles)
    alike = shared / np.maximum(size[leads][:, None] + size[None, :] - shared, 1) >= SIMILARITY
    label = np.array(nodes, np.int64)
    own = np.array(leads)
    while True:  # the least node of the component, by links of the leads
        least = np.where(alike, label[None, :], label[own][:, None]).min(axis=1)
        label_new = np.minimum(label, np.where(alike, least[:, None], label[None, :]).min(axis=0)) if len(own) else label
        if (label_new == label).all():
            return [(n, int(x)) for n, x in zip(nodes, label, strict=True) if n != x]
        label = label_new


def _linked(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """entries(list, part, node, first), sets(node, shingles) -> (u, v) that join the similar texts of each (list, part)."""
    n = shuffle_partitions(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            nodes: dict[int, list] = {}
            for node, first, x in rows:
                nodes.setdefault(node, [False, x])[0] |= first
            got = _classes([*nodes], [f for f, _ in nodes.values()], [np.frombuffer(x, np.uint64) for _, x in nodes.values()])
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())], ["u", "v"])

        for b in batches:  # sorted by list and part
            for key, part, node, first, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, part) != at and rows:
                    yield done()
                    rows = []
                at = key, part
                rows.append((node, first, x))
        if rows:
            yield done()

    dealt = entries.join(sets, "node").select("list", "part", "node", "first", "shingles").repartition(n, "list", "part").sortWithinPartitions("list", "part")
    return dealt.mapInArrow(run, "u long, v long")


def compared(lists: DataFrame, sets: DataFrame, most: int = LIST) -> DataFrame:
    """lists(list, node, size), sets(node, shingles) -> (u, v) that join the similar texts of every list.

    A list of `most` shingles or fewer is compared in one task.  A larger one first meets its leader, the node that
    stands in the largest lists; a copy of a common source usually is like that.  Those that are unlike the leader are
    dealt into blocks, and each block meets all of the list, in blocks too.
    """
    facts = lists.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("size") + 1).alias("weight"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("n > 1")
    # Lists of the same nodes are compared once.
    facts = saved(facts.groupBy("n", "weight", "x", "lo", "hi").agg(F.min("list").alias("list")).select("list", "n", "weight"))
    small = lists.join(facts.filter(F.col("weight") <= most).select("list"), "list").select("list", F.lit(0).alias("part"), "node", F.lit(True).alias("first"))
    found = _linked(small, sets)
    large = facts.filter(F.col("weight") > most)
    if large.isEmpty():
        return found
    own = saved(lists.join(large, "list"))
    degree = own.groupBy("node").agg(F.sum("n").alias("degree"))
    leader = own.join(degree, "node").groupBy("list").agg(F.max(F.struct("degree", -F.col("node"))).alias("d")).select("list", (-F.col("d.col2")).alias("lead"))
    pairs = own.join(leader, "list").filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                one, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(one) + len(other) - len(np.union1d(one, other))
                keep.append(shared / max(1, len(one) + len(other) - shared) >= SIMILARITY)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_shingles"))
    stars = saved(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_shingles", "v_shingles").mapInArrow(decide, "u long, v long"))
    like = leader.join(stars, F.col("lead") == F.col("v")).select("list", F.col("u").alias("node"))
    strays = own.join(like, ["list", "node"], "left_anti").join(leader, "list").filter("node <> lead").select("list", "node", "size")
    weights = saved(strays.groupBy("list").agg(F.sum(F.col("size") + 1).alias("stray")).join(large, "list"))
    half = F.lit(most / 2)
    blocks = weights.select("list", F.ceil(F.col("stray") / half).cast("int").alias("rows"), F.ceil(F.col("weight") / half).cast("int").alias("columns"))
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    part = lambda r, c: (r * F.col("columns") + c).cast("int").alias("part")
    up = strays.join(blocks, "list").select("list", block("rows").alias("r"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"), "columns", "node")
    across = own.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), block("columns").alias("c"), "columns", "node")
    dealt = up.select("list", part(F.col("r"), F.col("c")), "node", F.lit(True).alias("first")).unionByName(across.select("list", part(F.col("r"), F.col("c")), "node", F.lit(False).alias("first")))
    return found.unionByName(stars).unionByName(_linked(dealt, sets))


def similar_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (doc_id, raw) of the rows that are copies of others, or similar, but not their group's first; and of the rows that are there several times.

    Texts with the same words are one node, whose size in rows doesn't matter from then on.  Candidates are lists of
    nodes: those of a component of SimHash links (of five-word shingles), and those that agree on a band.
    """
    rows = saved(marked(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "size", "print", "bands")
    nodes = saved(rows.groupBy("copy").agg(F.min(order).alias("first")).select("copy", "first.*").withColumn("node", F.monotonically_increasing_id()))
    prints = nodes.select("print").distinct()
    near = components(links(anchors(prints.select(F.col("print").alias("bits"), F.col("print").alias("id")))))
    by_print = nodes.join(near.withColumnsRenamed({"node": "n", "root": "r"}), F.col("print") == F.col("n"), "left").select(F.xxhash64(F.coalesce("r", "print"), F.lit("SimHash")).alias("list"), "node", "size")
    every = nodes.select(F.explode("bands").alias("list"), "node", "size").unionByName(by_print)
    several = every.groupBy("list").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("list")
    lists = saved(every.join(several, "list"))
    wanted = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("raw").alias("of"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("raw"), "text")
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("raw").eqNullSafe(F.col("of")))
    sets = saved(shingled(texts).dropDuplicates(["node"]))  # a row that is there several times has one node
    roots = components(compared(lists, sets))
    named = nodes.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("copy", "none", "doc_id", "raw", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct("none", "doc_id", "raw")).alias("first"))
    of = named.select(F.col("copy").alias("c"), "root").join(first, "root").select("c", F.col("first.doc_id").alias("id"), F.col("first.raw").alias("of"))
    gone = rows.join(of, F.col("copy") == F.col("c")).filter(~(F.col("doc_id").eqNullSafe(F.col("id")) & F.col("raw").eqNullSafe(F.col("of"))))
    often = rows.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).filter("n > 1")
    return gone.select("doc_id", "raw").distinct(), often.select("doc_id", "raw")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are similar to a document that stays; all columns as they are.

    Of a group the document with the least id stays (a null id is the largest; then the least digest), once if its row
    is there several times.
    """
    gone, often = similar_groups(docs)
    often = saved(often)
    raw, i, d = fresh(docs, "raw", "i", "d")
    keyed = docs.withColumn(raw, F.md5("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col(raw).eqNullSafe(F.col(d))
    kept = keyed.join(gone.toDF(i, d), same, "left_anti")
    if not often.isEmpty():
        once = kept.join(often.toDF(i, d), same, "left_semi").dropDuplicates(["doc_id", raw])
        kept = kept.join(often.toDF(i, d), same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
