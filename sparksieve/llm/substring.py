"""Substring dedup on word windows, by difference-cover anchors.

A window of W words is removed from a document if it also starts in a document with a smaller id.  Only
the positions of a difference cover are looked at first: residues D modulo a period P such that every
residue is a difference of two of D.  Two equal windows at i and j then have a shift d < P at which both
i + d and j + d are cover positions, so they share the anchor of A = W - P + 1 words there.  With W = 13 and
P = 7, D = {1, 2, 4} puts anchors of seven words at three positions of seven.

1. Chunks send the distinct hashes of their anchors; a bucket of hashes answers which stand in two or more
   documents.
2. Anchors that do extend: a chunk takes the windows that hold a repeated anchor at a cover position, and
   sends each distinct window (96 bits of hash) with the smallest id that has it in the chunk.  The bucket
   answers whether a smaller id has it elsewhere.
3. Words covered by such windows go.

Every step is linear in words: no pairs of documents are made, a passage that a third of all documents
share is one row of a chunk, and nothing is collected or broadcast.

Cases: null and empty texts have no words and lose none; a null id counts as larger than any other; equal
ids are one document to each other (neither is smaller); extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Answers, Texts, answer, ask, bits, buckets, chunk_words, chunked, finish, groups, mix64, multipliers, planes, split_sorted, unbits, unplanes

WINDOW = 13
#: Period and residues of the difference cover (every residue modulo 7 is a difference of two of these).
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR_BYTES = 7

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _sums(words: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for t, m in enumerate(factors):
        total += words[at + t] * m
    return mix64(total)


class Chunk:
    """Words of a chunk with their anchors, sorted by hash."""

    def __init__(self, texts: Texts, window: int):
        self.words, self.first = chunk_words(texts)
        self.window, n = window, np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.last = self.first[1:][self.doc]  # where the words of a word's document end
        residue = (np.arange(len(self.words)) - self.first[:-1][self.doc]) % PERIOD
        anchor = window - PERIOD + 1
        fits = np.arange(len(self.words)) + anchor <= self.last
        at = np.flatnonzero(np.isin(residue, COVER) & fits)
        keys = _sums(self.words, at, multipliers(anchor, 1)) & ~np.uint64(0x1FF)
        order = np.argsort(keys, kind="stable")
        self.at, keys = at[order], keys[order]
        new = groups(keys)
        self.group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(keys)) - 1
        doc = self.doc[self.at]
        several = doc[begin] != doc[end] if len(begin) else np.zeros(0, bool)
        self.keys = keys[begin] | (several.astype(np.uint64) << np.uint64(8))

    def candidates(self, repeated: np.ndarray, ids: np.ndarray) -> None:
        """Windows that hold a repeated anchor, with their distinct hashes in order."""
        hit, n = self.at[repeated[self.group]], len(self.words)
        step = np.zeros(n + 2, np.int32)
        np.add.at(step, np.maximum(hit - PERIOD + 1, self.first[:-1][self.doc[hit]]), 1)
        np.add.at(step, hit + 1, -1)
        starts = np.flatnonzero((np.cumsum(step)[:n] > 0) & (np.arange(n) + self.window <= self.last))
        one, two = _sums(self.words, starts, multipliers(self.window, 2)), _sums(self.words, starts, multipliers(self.window, 3)) >> np.uint64(32)
        order = np.argsort(one, kind="stable")
        self.starts, one, two = starts[order], one[order], two[order].astype(np.uint32)
        new = groups(one) | groups(two)
        self.own = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.one, self.two = one[self.begin], two[self.begin]
        self.id = ids[self.doc[self.starts]]
        self.least = np.minimum.reduceat(self.id, self.begin) if len(self.begin) else np.zeros(0, np.int64)


def _flags(got: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    parts = [unbits(got[k], int(b - a)) if b > a else np.zeros(0, bool) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return np.concatenate(parts)


def repeated_keys(blobs: list[bytes]) -> list[bytes]:
    """Which keys stand in several lists, or are marked (bit 8) as standing in several documents of one."""
    lists = [unplanes(b, np.uint64, ANCHOR_BYTES) for b in blobs]
    every = np.concatenate(lists)
    keys, marked = every & ~np.uint64(0x1FF), (every & np.uint64(0x100)) > 0
    order = np.argsort(keys)
    new = groups(keys[order])
    again = ~new
    again[:-1] |= ~new[1:]
    out = np.zeros(len(every), bool)
    out[order] = again
    out |= marked
    return [bits(x) for x in np.split(out, np.cumsum([len(x) for x in lists])[:-1])]


def _unsigned(ids: np.ndarray) -> np.ndarray:
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def smaller_elsewhere(blobs: list[bytes]) -> list[bytes]:
    """For each window of each list, whether another list has it with a smaller id."""
    size = [len(b) // 20 for b in blobs]
    one = np.concatenate([unplanes(b[: 8 * n], np.uint64) for b, n in zip(blobs, size, strict=True)])
    two = np.concatenate([unplanes(b[8 * n : 12 * n], np.uint32) for b, n in zip(blobs, size, strict=True)])
    ids = np.concatenate([unplanes(b[12 * n :], np.uint64) for b, n in zip(blobs, size, strict=True)])
    order = np.argsort(one)
    new = groups(one[order]) | groups(two[order])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(one), bool)
    out[order] = least < ids[order]
    return [bits(x) for x in np.split(out, np.cumsum(size)[:-1])]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept: the words that stay, joined by one space (null without with_text)."""
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window has {2 * PERIOD - 1} words or more")
    n = buckets(docs)
    chunks = chunked(docs)

    def anchors(texts: Texts, _: Answers) -> Iterator[tuple[int, bytes]]:
        keys = Chunk(texts, window).keys
        cuts = split_sorted(keys, n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, planes(keys[cuts[k] : cuts[k + 1]], ANCHOR_BYTES)

    def extended(texts: Texts, got: Answers) -> Chunk:
        c = Chunk(texts, window)
        c.candidates(_flags(got[0], split_sorted(c.keys, n)), texts.ids)
        return c

    def windows(texts: Texts, got: Answers) -> Iterator[tuple[int, bytes]]:
        c = extended(texts, got)
        cuts = split_sorted(c.one, n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[k], cuts[k + 1])
            yield k, planes(c.one[own]) + planes(c.two[own]) + planes(_unsigned(c.least[own]))

    def cut(texts: Texts, got: Answers) -> Iterator[pa.RecordBatch]:
        c = extended(texts, got)
        gone = _flags(got[1], split_sorted(c.one, n))[c.own] | (c.id > c.least[c.own])
        starts = c.starts[gone]
        step = np.zeros(len(c.words) + window + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        stays = np.cumsum(step)[: len(c.words)] <= 0
        removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[c.first])
        kept = []
        for i in range(len(texts)):
            words = texts.text(i).split()
            kept.append(b" ".join(compress(words, stays[c.first[i] : c.first[i + 1]].tolist()) if removed[i] else words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(texts.ids, pa.int64(), mask=texts.null),
                pa.array(np.diff(c.first), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                pa.array(kept, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    repeated = answer(ask(chunks, [], anchors), repeated_keys, n)
    elsewhere = answer(ask(chunks, [repeated], windows), smaller_elsewhere, n)
    return finish(chunks, [repeated, elsewhere], cut, SCHEMA)
