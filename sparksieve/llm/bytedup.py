"""Suffix-array dedup: removes bytes that a long string covers which also starts elsewhere.

Texts are UTF-8 bytes.  Each byte covered by a string of LENGTH bytes that starts at another place of any
document too (the same one included) is removed; matches stay within documents.

A suffix array of all texts doesn't fit one machine, so shards are cut such that equal strings share one.  An
anchor of a string is the least-hashed 64-byte piece in it (the first of equals), so equal strings have equal
anchors, and the strings of one anchor start in one run of places.

1. Chunks send distinct anchor hashes; buckets answer which stand in several places.  Other runs can't repeat.
2. Of the rest, a run's fragment (its starts and LENGTH - 1 bytes more) goes to the anchor's bucket; equal
   fragments of a chunk go once, with a mark.  The bucket packs anchors into shards of SHARD_BYTES, builds each
   shard's suffix array by induced sorting with permuted common prefixes (suffix.py), and answers which starts
   repeat.  Equal fragments enter a shard once; one that came twice repeats as a whole.
3. Chunks remove what such starts cover.

A passage that very many documents share has anchors with as many distinct fragments, for what stands around it
differs.  Anchors of HOT or more chunks are therefore cut finer before anything is sent: into pieces of four starts by
their places relative to the anchor.  All strings of a piece hold the same core.  Another exchange, of hashes of cores
and pieces, tells which pieces stand elsewhere too as they are, and which differ from others with their core; of the
latter, one chunk each sends the piece to the bucket of its core.  They differ in three bytes at each end at most, so
no bucket gathers more than a bounded number of them.
In a bucket, an anchor with more fragments than a shard holds is split likewise, by 32 places.

With keep_first, of equal strings the first stays: the one in the smallest doc_id (a null id is the largest, equal ids
go by chunk), there the one that starts first.  Fragments and pieces then go with the place of the first of their
kind, answers tell which starts have an equal string before them, and these starts' bytes are removed.

Cases: null and empty texts have no bytes; repeated rows remove each other, or all but one (keep_first); a text of one
repeated letter has all of it removed, or all but its first LENGTH bytes; extra columns are left out (without_repeats()
keeps them, whatever their names); no rows give no rows.  Text that is cut within a character loses the rest of the
character in the column `kept` only; the digest is of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Answers, Texts, answer, ask, bits, buckets, chunked, finish, groups, mix64, planes, split_sorted, unbits, unplanes
from .common import fresh
from .substring import ANCHOR_BYTES, _unsigned, repeated_keys
from .suffix import repeated_groups

LENGTH = 400
#: Bytes of a piece whose hash can make it an anchor.
PIECE = 64
#: Starts that are looked at at a time (their arrays fit a cache); bytes of fragments in a shard.
STARTS, SHARD_BYTES = 1 << 16, 1 << 20
CELL = 32
#: Chunks that have an anchor from which on it is cut finer, and the places of its pieces.
HOT, HOT_CELL = 32, 4

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_sha256 string, kept string"

_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs(texts: Texts, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: first start, last start, anchor's place (in the chunk's bytes), and its hash."""
    data, size = texts.data, len(texts.data)
    up, down = _powers(min(size, STARTS + length) + 1)
    ends = texts.offsets[1:]
    window = length - PIECE + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    for a in range(0, max(0, size - length + 1), STARTS):
        b = min(a + STARTS, size - length + 1)
        part = data[a : b + length - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * up[: len(part)])])
        pieces = len(part) - PIECE + 1
        mark = mix64((sums[PIECE:] - sums[:-PIECE])[:pieces] * down[:pieces])
        # The hash's top half orders pieces, the place breaks ties.
        least = (mark & ~np.uint64(0xFFFFFFFF)) | np.arange(pieces, dtype=np.uint64)
        reach = 1
        while reach < window:
            step = min(reach, window - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(a, b)
        own = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b - 1, "right") + 1]  # of documents with starts in [a, b)
        fits = start + length <= np.repeat(own, np.diff(np.concatenate([[a], np.minimum(own, b)])))
        new = np.concatenate([[True], at[1:] != at[:-1]]) | np.concatenate([[True], fits[1:] != fits[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        keep = fits[first]
        first, last = first[keep], last[keep]
        # Least hashes are small ones: mixed again, they spread over all buckets.
        key = mix64(mark[at[first]] + np.uint64(0x5A))
        for out, x in zip(found, (first + a, last + a, at[first] + a, key), strict=True):
            out.append(x)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(found, (np.int64, np.int64, np.int64, np.uint64), strict=True))


class Chunk:
    """Runs of a chunk, sorted by their anchors' hashes."""

    def __init__(self, texts: Texts, length: int):
        self.length = length
        found = runs(texts, length)
        key = found[3] & ~np.uint64(0x1FF)
        order = np.argsort(key, kind="stable")
        self.first, self.last, self.at = (x[order] for x in found[:3])
        key = key[order]
        new = groups(key)
        self.group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        several = np.diff(np.append(begin, len(key))) > 1
        self.keys = key[begin] | (several.astype(np.uint64) << np.uint64(8))

    def fragments(self, texts: Texts, wanted: np.ndarray) -> Fragments:
        """Distinct fragments of the wanted runs (by anchor), in the order of their anchors' hashes."""
        kept = np.flatnonzero(wanted[self.group])
        # In the order of documents and places: the first run of a fragment is the one that may stay.
        doc = texts.ids[np.searchsorted(texts.offsets, self.first[kept], "right") - 1]
        order = np.lexsort((self.first[kept], doc, self.keys[self.group[kept]]))
        kept, doc = kept[order], doc[order]
        seen: dict[tuple[int, int, bytes], int] = {}
        number = []
        keys = (self.keys[self.group[kept]] & ~np.uint64(0x1FF)).tolist()
        data = memoryview(np.ascontiguousarray(texts.data))
        for k, a, b, p in zip(keys, self.first[kept].tolist(), self.last[kept].tolist(), self.at[kept].tolist(), strict=True):
            number.append(seen.setdefault((k, p - a, bytes(data[a : b + self.length])), len(seen)))
        count = np.bincount(np.array(number, np.int64), minlength=len(seen))
        lead = np.unique(np.array(number, np.int64), return_index=True)[1]
        ranks = list(zip(doc[lead].tolist(), [texts.chunk] * len(lead), self.first[kept[lead]].tolist(), strict=True))
        return Fragments([f for _, _, f in seen], [k for k, _, _ in seen], [p for _, p, _ in seen], count.tolist(), kept, np.array(number, np.int64), ranks, lead)


#: A place in the order of all bytes: document's id, chunk, byte of the chunk.
Rank = tuple[int, int, int]


def _after(rank: Rank, n: int) -> Rank:
    return rank[0], rank[1], rank[2] + n


class Fragments(NamedTuple):
    fragments: list[bytes]
    keys: list[int]
    places: list[int]  # of the anchor in the fragment
    counts: list[int]
    runs: np.ndarray  # the chunk's runs that have them
    number: np.ndarray  # and which one each has
    ranks: list[Rank]  # where the first of each starts
    lead: np.ndarray  # the place in `runs` of the first of each


class Piece(NamedTuple):
    fragment: int
    start: int  # first start in the fragment
    starts: int
    place: int  # of the anchor in the piece
    core: int  # hash of what all its strings hold
    mark: int  # hash of the whole piece


def cells(f: int, fragment: bytes, place: int, length: int, cell: int) -> Iterator[tuple[Piece, bytes]]:
    """A fragment's pieces by `cell` places of a start relative to the anchor, each with its core."""
    starts, far = len(fragment) - length + 1, place
    while far > place - starts:  # starts are `place` to `place - starts + 1` bytes before the anchor
        low = far // cell * cell
        near = max(low, place - starts + 1)
        # Strings that start low to low + cell - 1 bytes before the anchor all hold these bytes.
        core = fragment[place - low : place - (low + cell - 1) + length]
        yield Piece(f, place - far, far - near + 1, far, 0, 0), core
        far = near - 1


def hot_pieces(found: Fragments, hot: list[int], length: int) -> list[Piece]:
    """Pieces of the fragments `hot` with their hashes (of places too)."""
    import xxhash

    out, one = [], xxhash.xxh3_64_intdigest
    for i in hot:
        f = found.fragments[i]
        for piece, core in cells(i, f, found.places[i], length, HOT_CELL):
            out.append(piece._replace(core=one(core, piece.place // HOT_CELL), mark=one(f[piece.start : piece.start + piece.starts + length - 1], piece.place)))
    return out


class PieceList:
    """Distinct (core, piece) hashes of a chunk in order, and which one each piece has."""

    def __init__(self, found: Fragments, pieces: list[Piece]):
        self.pieces = pieces
        core, mark = (np.array([getattr(p, k) for p in pieces], np.uint64) for k in ("core", "mark"))
        ranks = [_after(found.ranks[p.fragment], p.start) for p in pieces]
        ids, places = np.array([r[0] for r in ranks], np.int64), np.array([r[2] for r in ranks], np.int64)
        order = np.lexsort((places, ids, mark, core))
        core, mark = core[order], mark[order]
        new = groups(core) | groups(mark)
        self.own = np.empty(len(pieces), np.int64)
        self.own[order] = np.cumsum(new) - 1
        self.core, self.mark, self.ids, self.places = core[new], mark[new], ids[order][new], places[order][new]
        self.lead = np.zeros(len(pieces), bool)  # the first piece of each kind
        self.lead[order[new]] = True
        self.chunk = ranks[0][1] if ranks else 0
        self.several = np.bincount(self.own, [found.counts[p.fragment] for p in pieces], len(self.core)) > 1

    def asked(self, n: int) -> Iterator[tuple[int, bytes]]:
        cuts = split_sorted(self.core, n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            rank = planes(_unsigned(self.ids[own])) + planes(_unsigned(self.places[own]))
            yield k, np.array([cuts[k + 1] - cuts[k], self.chunk], np.int64).tobytes() + planes(self.core[own]) + planes(self.mark[own]) + rank + bits(self.several[own])

    def answered(self, got: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece: it stands elsewhere too; this chunk is to send it (it has the first); an equal one stands before it."""
        cuts = split_sorted(self.core, n)
        three = [[np.zeros(0, bool)], [np.zeros(0, bool)], [np.zeros(0, bool)]]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            size = int(cuts[k + 1] - cuts[k])
            for i, own in enumerate(three):
                own.append(unbits(got[k][-(-size // 8) * i :], size))
        again, send, later = (np.concatenate(x)[self.own] for x in three)
        return again, send, later | ~self.lead


def judged_pieces(blobs: list[bytes]) -> list[bytes]:
    """For each list: which pieces stand several times; which are to be sent: the first of each kind, where a core has several kinds; and which have an equal one before them."""
    sizes, chunks = (np.array(x, np.int64) for x in zip(*(np.frombuffer(b[:16], np.int64).tolist() for b in blobs), strict=True))
    column = lambda i: np.concatenate([unplanes(b[16 + 8 * n * i : 16 + 8 * n * (i + 1)], np.uint64) for b, n in zip(blobs, sizes.tolist(), strict=True)])
    core, mark, ids, places = map(column, range(4))
    several = np.concatenate([unbits(b[16 + 32 * n :], n) for b, n in zip(blobs, sizes.tolist(), strict=True)])
    order = np.lexsort((places, np.repeat(chunks, sizes), ids, mark, core))
    new_core = groups(core[order])
    new = new_core | groups(mark[order])
    kind = np.cumsum(new) - 1
    often = np.bincount(kind, several[order] + 1)[kind] > 1
    group = np.cumsum(new_core) - 1
    kinds = np.bincount(group, new)[group] > 1
    again, send, later = (np.zeros(len(core), bool) for _ in range(3))
    again[order], send[order], later[order] = often, new & kinds, ~new
    ends = np.cumsum(sizes)[:-1]
    return [bits(a) + bits(b) + bits(c) for a, b, c in zip(*(np.split(x, ends) for x in (again, send, later)), strict=True)]


#: What a chunk sends: anchor's or core's hash, anchor's place, bytes; how often, and where the first is.
Unit = tuple[int, int, bytes, int, Rank]


def _sent(units: list[Unit]) -> bytes:
    keys, place, fragments, count, ranks = zip(*units, strict=True)
    size = np.array([len(f) for f in fragments], np.uint64)
    numbers = [np.array(keys, np.uint64), size * np.uint64(2) | (np.array(count) > 1).astype(np.uint64), np.array(place, np.uint64), *(_unsigned(np.array([r[i] for r in ranks], np.int64)) for i in (0, 2))]
    raw = b"".join(map(planes, numbers)) + b"".join(fragments)
    return np.array([len(fragments), len(raw), ranks[0][1]], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _received(blob: bytes) -> tuple[list[bytes], list[int], list[int], list[bool], list[Rank]]:
    n, size, chunk = np.frombuffer(blob[:24], np.int64).tolist()
    raw = pa.decompress(blob[24:], decompressed_size=size, codec="zstd", asbytes=True)
    keys, sizes, place, ids, at = (unplanes(raw[8 * n * i : 8 * n * (i + 1)], np.uint64) for i in range(5))
    ends = np.cumsum(sizes >> np.uint64(1)).astype(np.int64) + 40 * n
    begins = ends - (sizes >> np.uint64(1)).astype(np.int64)
    ranks = [(i, chunk, p) for i, p in zip(_signed(ids).tolist(), _signed(at).tolist(), strict=True)]
    return [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], keys.tolist(), place.tolist(), (sizes & np.uint64(1)).astype(bool).tolist(), ranks


#: Flags of starts, and where the first of them is.
View = tuple[np.ndarray, Rank]


def _mark_later(views: list[View]) -> View:
    """Of views of equal bytes, all but the first have an equal string before each start; returns the first."""
    first = min(views, key=lambda v: v[1])
    for v in views:
        if v is not first:
            v[0][:] = True
    return first


class _Shard:
    """Fragments that wait for a suffix array, each with views of the flags of its starts."""

    def __init__(self, length: int, most: int, keep_first: bool):
        self.length, self.most, self.keep_first, self.size = length, most, keep_first, 0
        self.waiting: list[tuple[bytes, list[View]]] = []

    def add(self, fragments: list[tuple[bytes, list[View]]]) -> None:
        """Fragments that belong in one suffix array."""
        size = sum(len(f) for f, _ in fragments)
        if self.size + size > self.most:
            self.build()
        self.waiting += fragments
        self.size += size

    def build(self) -> None:
        if self.waiting:
            found = repeated_groups([f for f, _ in self.waiting], self.length)
            if self.keep_first:
                self._later([_mark_later(views) for _, views in self.waiting], found)
            else:
                for (_, views), got in zip(self.waiting, found, strict=True):
                    for flags, _ in views:
                        flags |= got >= 0
        self.size, self.waiting = 0, []

    def _later(self, views: list[View], found: list[np.ndarray]) -> None:
        """Flags the starts that have an equal string at a start of a smaller rank."""
        at = [np.flatnonzero(g >= 0) for g in found]
        number = np.repeat(np.arange(len(at)), [len(x) for x in at])
        start = np.concatenate(at)
        group = np.concatenate([g[x] for g, x in zip(found, at, strict=True)])
        ids, chunk, place = (np.array([r[i] for _, r in views], np.int64)[number] for i in range(3))
        order = np.lexsort((place + start, chunk, ids, group))
        later = ~groups(group[order])
        for i, t in zip(number[order][later].tolist(), start[order][later].tolist(), strict=True):
            views[i][0][t] = True


def _split(fragments: list[tuple[bytes, int, View]], length: int, shard: _Shard) -> None:
    """Compares fragments of one anchor that are too many for a shard, by the starts' places relative to the anchor."""
    parts: dict[tuple[int, bytes], dict[bytes, list[View]]] = {}
    for f, place, (flags, rank) in fragments:
        for piece, core in cells(0, f, place, length, CELL):
            own = parts.setdefault((piece.place // CELL, core), {})
            own.setdefault(f[piece.start : piece.start + piece.starts + length - 1], []).append((flags[piece.start : piece.start + piece.starts], _after(rank, piece.start)))
    for group in parts.values():
        for same in group.values():
            if shard.keep_first:
                _mark_later(same)
            else:
                for flags, _ in same:
                    flags |= len(same) > 1
        if len(group) > 1:
            shard.add([*group.items()])


def repeated_or_hot(blobs: list[bytes], hot: int) -> list[bytes]:
    """As repeated_keys(), followed by which keys stand in `hot` lists or more."""
    lists = [unplanes(b, np.uint64, ANCHOR_BYTES) & ~np.uint64(0x1FF) for b in blobs]
    key, count = np.unique(np.concatenate(lists), return_counts=True)
    return [r + bits(count[np.searchsorted(key, x)] >= hot) for r, x in zip(repeated_keys(blobs), lists, strict=True)]


def repeats(blobs: list[bytes], length: int, shard_bytes: int, keep_first: bool = False) -> list[bytes]:
    """For each chunk's fragments, which of their starts repeat (keep_first: have an equal string before them), as bits."""
    lists = [_received(b) for b in blobs]
    place: dict[tuple[int, int, bytes], int] = {}
    number = [[place.setdefault((k, p, f), len(place)) for f, k, p in zip(fs, ks, ps, strict=True)] for fs, ks, ps, *_ in lists]
    count = np.bincount(np.concatenate([np.array(n, np.int64) for n in number]), np.concatenate([np.array(m, np.int64) + 1 for *_, m, _ in lists]), len(place))
    first: dict[int, Rank] = {}
    for n, (*_, ranks) in zip(number, lists, strict=True):
        for i, r in zip(n, ranks, strict=True):
            first[i] = min(r, first.get(i, r))
    flags = [np.full(len(f) - length + 1, c > 1 and not keep_first) for (_, _, f), c in zip(place, count.tolist(), strict=True)]
    by_anchor: dict[int, list[int]] = {}
    for i, (k, _, _) in enumerate(place):
        by_anchor.setdefault(k, []).append(i)
    every = [(f, p, (own, first[i])) for i, ((_, p, f), own) in enumerate(zip(place, flags, strict=True))]
    shard = _Shard(length, shard_bytes, keep_first)
    for own in by_anchor.values():
        if sum(len(every[i][0]) for i in own) <= shard_bytes:
            shard.add([(every[i][0], [every[i][2]]) for i in own])
        else:
            _split([every[i] for i in own], length, shard)
    shard.build()
    # Equal fragments of other chunks than the first's have an equal string before every start.
    answer = lambda i, r: flags[i] if not keep_first or r == first[i] else np.ones(len(flags[i]), bool)
    return [bits(np.concatenate([np.zeros(0, bool), *(answer(i, r) for i, r in zip(n, ranks, strict=True))])) for n, (*_, ranks) in zip(number, lists, strict=True)]


def _long_enough(texts: Texts, start: np.ndarray, length: int, words: int) -> np.ndarray:
    """start without runs whose bytes hold `words` whole words or fewer and are fewer than LENGTH."""
    word = _IN_WORD[texts.data]
    edge = np.zeros(len(word) + 1, bool)
    edge[texts.offsets] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    step = np.diff(np.concatenate([[0], start.astype(np.int8), [0]]))
    first, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + length - 1
    short = (np.searchsorted(ends, stop, "right") - np.searchsorted(begins, first) <= words) & (stop - first < LENGTH)
    out = start.copy()
    for a, b in zip(first[short].tolist(), stop[short].tolist(), strict=True):
        out[a : b - length + 1] = False
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, with_text: bool = True, hot_chunks: int = HOT, words: int = 0, keep_first: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_sha256 and kept (null without with_text).

    With keep_first, the first of equal strings stays.

    With words, repeated passages (runs of starts, with the bytes they cover) of that many words or fewer stay if they
    are shorter than LENGTH.
    """
    if length <= PIECE:
        raise ValueError(f"length must be over {PIECE}")
    n = buckets(docs)
    chunks = chunked(docs)

    def anchors(texts: Texts, _: Answers) -> Iterator[tuple[int, bytes]]:
        keys = Chunk(texts, length).keys
        cuts = split_sorted(keys, n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, planes(keys[cuts[k] : cuts[k + 1]], ANCHOR_BYTES)

    def judged(texts: Texts, got: dict[int, bytes]) -> tuple[Chunk, np.ndarray, np.ndarray]:
        """A chunk, and which of its anchors repeat and are hot."""
        c = Chunk(texts, length)
        cuts = split_sorted(c.keys, n)
        both = [[np.zeros(0, bool)], [np.zeros(0, bool)]]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            size = int(cuts[k + 1] - cuts[k])
            both[0].append(unbits(got[k][: -(-size // 8)], size))
            both[1].append(unbits(got[k][-(-size // 8) :], size))
        return c, np.concatenate(both[0]), np.concatenate(both[1])

    def hot_list(c: Chunk, found: Fragments, hot: np.ndarray) -> PieceList:
        keys = set((c.keys[hot] & ~np.uint64(0x1FF)).tolist())
        return PieceList(found, hot_pieces(found, [i for i, k in enumerate(found.keys) if k in keys], length))

    def pieces(texts: Texts, got: Answers) -> Iterator[tuple[int, bytes]]:
        c, repeated, hot = judged(texts, got[0])
        yield from hot_list(c, c.fragments(texts, repeated & hot), hot).asked(n)

    def units(texts: Texts, got: Answers):
        """What a chunk sends, by bucket, each unit with the (fragment, first start, starts) it stands for; and flags that are known before."""
        c, repeated, hot = judged(texts, got[0])
        found = c.fragments(texts, repeated)
        listed = hot_list(c, found, hot)
        flags = [np.zeros(len(f) - length + 1, bool) for f in found.fragments]
        made: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}
        for p, again, send, later, lead in zip(listed.pieces, *(x.tolist() for x in listed.answered(got[1], n)), listed.lead.tolist(), strict=True):
            if later if keep_first else again:
                flags[p.fragment][p.start : p.start + p.starts] = True
            if send and (lead or not keep_first):
                made.setdefault((p.core, p.place, found.fragments[p.fragment][p.start : p.start + p.starts + length - 1]), []).append((p.fragment, p.start, p.starts))
        cut_up = {p.fragment for p in listed.pieces}
        for i, (f, k, place) in enumerate(zip(found.fragments, found.keys, found.places, strict=True)):
            if i not in cut_up:
                made[k, place, f] = [(i, 0, len(f) - length + 1)]
        out: dict[int, list[tuple[Unit, list[tuple[int, int, int]]]]] = {}
        for (k, place, f), owners in made.items():
            rank = min(_after(found.ranks[i], start) for i, start, _ in owners)
            out.setdefault((k * n) >> 64, []).append(((k, place, f, sum(found.counts[i] for i, *_ in owners), rank), owners))
        return c, found, flags, out

    def send(texts: Texts, got: Answers) -> Iterator[tuple[int, bytes]]:
        for k, own in units(texts, got)[3].items():
            yield k, _sent([u for u, _ in own])

    def cut(texts: Texts, got: Answers) -> Iterator[pa.RecordBatch]:
        c, found, flags, sent = units(texts, got)
        for k, own in sent.items():
            sizes = [owners[0][2] for _, owners in own]
            for (_, owners), hit in zip(own, np.split(unbits(got[2][k], sum(sizes)), np.cumsum(sizes)[:-1]), strict=True):
                for f, start, starts in owners:
                    flags[f][start : start + starts] |= hit
        start = np.zeros(len(texts.data), bool)  # runs share no starts
        some, lead = [bool(f.any()) for f in flags], set(found.lead.tolist())
        for i, (a, b, f) in enumerate(zip(c.first[found.runs].tolist(), c.last[found.runs].tolist(), found.number.tolist(), strict=True)):
            if keep_first and i not in lead:
                start[a : b + 1] = True
            elif some[f]:
                start[a : b + 1] = flags[f]
        if words:
            start = _long_enough(texts, start, length, words)
        step = start.astype(np.int32)
        step[length:] -= start[:-length]
        gone = np.cumsum(step, dtype=np.int32) > 0
        removed = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        at = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        opens[at] = gone[at]
        spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(opens, dtype=np.int32)])
        kept = []
        for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
            kept.append((texts.data[a:b][~gone[a:b]] if removed[b] > removed[a] else texts.data[a:b]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(texts.ids, pa.int64(), mask=texts.null), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(np.diff(removed[texts.offsets]), pa.int64()), pa.array(np.diff(spans[texts.offsets]), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([hashlib.sha256(texts.text(i)).hexdigest() if with_text else None for i in range(len(texts))], pa.string()),
                pa.array([x.decode("utf-8", "ignore") for x in kept] if with_text else [None] * len(kept), pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_sha256", "kept"],
        )

    def reply(blobs: list[bytes]) -> list[bytes]:
        return repeats(blobs, length, shard_bytes, keep_first)

    repeated = answer(ask(chunks, [], anchors), lambda blobs: repeated_or_hot(blobs, hot_chunks), n)
    hot = answer(ask(chunks, [repeated], pieces), judged_pieces, n)
    starts = answer(ask(chunks, [repeated, hot], send), reply, n)
    return finish(chunks, [repeated, hot, starts], cut, SCHEMA)


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs without repeated strings but their first occurrence (see dedup_bytes); texts that lose all their bytes go.

    Columns stay as they are but for text, and n_chars where there is one.  Only texts that lose something are joined
    to what is left of them; rows are told by id and digest, so rows of one id and text all have left what the one that
    loses least has.
    """
    i, digest, left, of = fresh(docs, "id", "digest", "left", "of")
    each = dedup_bytes(docs, length, words=words, keep_first=True).select(F.col("doc_id").alias(i), F.col("text_sha256").alias(digest), "n_removed", F.when(F.col("n_removed") > 0, F.col("kept")).alias(left))
    least = each.groupBy(i, digest).agg(F.min(F.struct("n_removed", left)).alias("least")).filter("least.n_removed > 0").select(i, digest, F.col("least")[left].alias(left))
    joined = docs.withColumn(of, F.sha2("text", 256)).join(least, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(of) == F.col(digest)), "left")
    kept = joined.filter(F.col(left).isNull() | (F.col(left) != ""))
    changed = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(changed).select(*docs.columns)
