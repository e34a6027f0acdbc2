"""Suffix arrays of shards by induced sorting, and which long strings repeat in a shard.

The steps are those of induced sorting, each as array operations:

1. Suffixes are classified: S if smaller than the next suffix, L if larger; LMS if S after an L.
2. LMS substrings (from one LMS place to the next) get names in their order.  The names in text order are a
   shorter text, whose suffixes are sorted by these steps again, until all names differ.  Many different names are
   written as two digits each (equally long, so they compare as their digits do): then a text has few letters at
   each depth, and a bucket's work is done on arrays that are worth a step.
3. Sorted LMS suffixes induce the L suffixes, bucket by bucket upwards, and those induce the S suffixes, bucket by
   bucket downwards.  A bucket's suffixes induce their predecessors in one step; only predecessors in the same
   bucket need further steps.
4. Permuted common prefixes: phi[i] is the suffix before i in the array, and common prefixes with it are found in
   text order: where phi moves on with the text, they shrink by one from a place to the next.  So every 32nd
   place is compared at length, and most places between follow.

Suffixes that agree on more bytes than asked for may stand in any order, which changes no answer.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 32
#: Different names that a text may have, and a name for each so many places more, before they are written as two digits.
FEW = 256


def _classified(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last is S."""
    n = len(text)
    step = np.diff(text)
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.ones(n, bool)
    known = following < n - 1
    smaller[:-1][known] = step[following[known]] > 0
    smaller[:-1][~known] = False
    return smaller


def _names(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings.  Letters with their class: then none is a prefix of another."""
    size = np.diff(np.append(lms, lms[-1])) + 1
    wide = (2 * int(text.max()) + 2).bit_length()
    step = 62 // wide
    symbol = np.concatenate([text.astype(np.int64) * 2 + smaller, np.zeros(step + 2, np.int64)])

    def key(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for t in range(step):
            out = (out << wide) | np.where(t < left, symbol[np.minimum(at + t, len(symbol) - 1)] + 1, 0)
        return out

    _, name = np.unique(key(lms, size), return_inverse=True)
    done, active = step, np.flatnonzero(size > step)
    while len(active):
        more = key(lms[active] + done, size[active] - done)
        order = np.lexsort((more, name[active]))
        a, k = name[active][order], more[order]
        new_name = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_name | np.concatenate([[True], k[1:] != k[:-1]])
        # Within its old name, a substring's rank is the number of smaller distinct ones.
        rank = np.cumsum(new) - 1
        rank -= np.maximum.accumulate(np.where(new_name, rank, 0))
        extra = np.zeros(int(name.max()) + 1, np.int64)
        np.maximum.at(extra, a, rank)
        before = np.concatenate([[0], np.cumsum(extra + 1)[:-1]])
        own = np.empty(len(active), np.int64)
        own[order] = rank
        name = before[name]
        name[active] += own
        done += step
        active = active[size[active] > done]
    return name


def _names_spanning(lms: np.ndarray, length: int) -> int:
    """The fewest LMS substrings in a row that have `length` letters wherever they begin (but at the text's end)."""
    low, high = 1, max(1, length // 2)  # LMS places are two letters apart or more
    while low < high:
        k = (low + high) // 2
        if k < len(lms) and (lms[k:] - lms[:-k]).min() + 1 < length:
            low = k + 1
        else:
            high = k
    return low


def _sorted_lms(name: np.ndarray, n: int, length: int) -> np.ndarray:
    """The order of the shorter text's suffixes by `length` names; `name` ends with the least, n letters made it."""
    kinds = int(name.max()) + 1
    if kinds == len(name):
        order = np.empty(kinds, np.int64)
        order[name] = np.arange(kinds)
        return order
    if length == 1:
        return np.argsort(name, kind="stable")
    if kinds <= FEW + len(name) // FEW or 2 * len(name) > 0.9 * n:
        return suffix_array(name.astype(np.int32), length)
    base = int(np.ceil(np.sqrt(kinds)))
    digits = np.empty(2 * len(name) - 1, np.int32)
    digits[:-1:2], digits[1::2] = name[:-1] // base + 1, name[:-1] % base + 1
    digits[-1] = 0
    array = suffix_array(digits, 2 * length)
    return array[array % 2 == 0] // 2


def _deal(places: np.ndarray, letters: np.ndarray, array: np.ndarray, edge: np.ndarray, way: int) -> None:
    """Puts places into their letters' buckets of the array, in their order, from each bucket's edge upwards or downwards (way), and moves the edges."""
    if len(places) < 2:
        for place, c in zip(places, letters, strict=True):
            array[edge[c]] = place
            edge[c] += way
        return
    order = letters.argsort(kind="stable")
    size = np.bincount(letters, minlength=len(edge))
    first = size.cumsum()
    first -= size
    array[(edge - way * first)[letters[order]] + way * np.arange(len(places))] = places[order]
    edge += way * size


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of text (integers from 0, ends with a letter less than all others) in the order of their first `length` letters at least."""
    n, letters = len(text), int(text.max()) + 1
    if letters <= 1 << 15:
        text = text.astype(np.int16, copy=False)  # which numpy sorts by radix
    smaller = _classified(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    ordered = lms[_sorted_lms(_names(text, smaller, lms), n, _names_spanning(lms, length))].astype(np.int32)
    ordered = ordered[np.argsort(text[ordered], kind="stable")]  # in order already but for what `length` left open
    starts = np.searchsorted(text[ordered], np.arange(letters + 1)).tolist()
    before = np.concatenate([text[:1], text[:-1]])
    larger_before = np.concatenate([[False], ~smaller[:-1]])
    smaller_before = np.concatenate([[False], smaller[:-1]])

    # A letter's bucket: its L suffixes, then its S suffixes.
    begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
    middle = (begin[:-1] + np.bincount(text[~smaller], minlength=letters)).tolist()
    array = np.empty(n, np.int32)
    array[0] = n - 1
    edge = begin[:-1].copy()
    for c in range(letters):
        done, filled = int(begin[c]), int(edge[c])
        while done < filled:
            now = array[done:filled]
            now = now[larger_before[now]]
            _deal(now - 1, before[now], array, edge, 1)
            done, filled = filled, int(edge[c])
        now = ordered[starts[c] : starts[c + 1]]  # what stands before an LMS place is larger
        _deal(now - 1, before[now], array, edge, 1)

    edge = begin[1:] - 1
    for c in range(letters - 1, 0, -1):
        done, filled = int(begin[c + 1]) - 1, int(edge[c])
        while done > filled:
            now = array[filled + 1 : done + 1][::-1]
            now = now[smaller_before[now]]
            _deal(now - 1, before[now], array, edge, -1)
            done, filled = filled, int(edge[c])
        now = array[int(begin[c]) : middle[c]][::-1]
        now = now[smaller_before[now]]
        _deal(now - 1, before[now], array, edge, -1)
    return array


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of common prefixes at places a and b, up to `most` (a multiple of 8); words[i]: the eight bytes from i on."""
    out = np.full(len(a), most, np.int32)
    live = np.arange(len(a))
    for k in range(0, most, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = x != 0
        if differ.any():
            low = x[differ] & (~x[differ] + np.uint64(1))  # the lowest set bit; bytes are in little-endian order
            out[live[differ]] = k + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
            live = live[~differ]
            if not len(live):
                break
    return out


def repeated_starts(fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment, at which places a string of `length` bytes starts that starts at another place of the fragments too; length is 8 or more."""
    return [g >= 0 for g in repeated_groups(fragments, length)]


def repeated_groups(fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment and start, the number of its string of `length` bytes among those that start at several places; -1 for others."""
    size = np.array([len(f) for f in fragments], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = np.ones(int(size.sum()) + len(fragments) + 1, np.int16)  # 1 ends a fragment, 0 the text
    text[-1] = 0
    joined = np.frombuffer(b"".join(fragments), np.uint8)
    text[np.arange(len(joined)) + np.repeat(np.arange(len(fragments)), size)] = joined.astype(np.int16) + 2
    array = suffix_array(text, length)
    phi = np.full(len(text), -1, np.int32)
    phi[array[1:]] = array[:-1]
    starts = np.maximum(size - length + 1, 0)
    valid = np.zeros(len(text), bool)
    valid[np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(first, starts)] = True
    # 0xFF is no letter of a text in UTF-8; it stands for separators, and the compared bytes end in padding.
    most = -(-(length + SAMPLED) // 8) * 8
    flat = np.concatenate([np.where(text > 1, text - 2, 0xFF).astype(np.uint8), np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(flat, 8)[: len(flat) - 7]
    words = np.ascontiguousarray(words).view(np.uint64).ravel()

    places = np.flatnonzero(valid & (phi >= 0))
    sampled = places[places % SAMPLED == 0]
    shared = np.zeros(len(text), np.int32)  # of sampled places
    shared[sampled] = _common(words, sampled, phi[sampled], most)
    base = places - places % SAMPLED
    # A place whose phi moved on with its sampled place's shares what is left of that one's common prefix.
    follows = (phi[places] == phi[base] + (places - base)) & (shared[base] - (places - base) >= length)
    rest = places[~follows]
    long = follows.copy()
    # The string's last bytes first: most places that don't repeat differ there.
    maybe = rest[words[rest + length - 8] == words[phi[rest] + length - 8]]
    long[np.searchsorted(places, maybe[_common(words, maybe, phi[maybe], -(-length // 8) * 8) >= length])] = True
    same = np.zeros(len(text), bool)  # as the suffix before it in the array
    same[places[long]] = True
    group = np.empty(len(text), np.int32)
    group[array] = np.cumsum(~same[array])
    alone = ~same
    alone[phi[places[long]]] = False
    group[alone] = -1
    return [group[f : f + s] for f, s in zip(first.tolist(), starts.tolist(), strict=True)]
