"""Media columns: cropped and edited copies of images, by local descriptors.

An image (binary PGM, P5, one byte a pixel) is described at three scales.  Corners are local maxima of the Harris
response, the strongest PER_SCALE of each scale (of images larger than AREA pixels, as many for each AREA); a corner's orientation is that of its patch's intensity centroid,
and its descriptor is 128 binary comparisons of smoothed pixels, turned by the orientation.  Brightness, contrast,
cropping and small noise leave most descriptors nearly as they are.

1. Hamming tables: a descriptor's four 32-bit parts are its keys in four tables, so descriptors that differ in three
   bits share a key surely, and those that differ in a few more usually do; an image has many.
2. In each list of a table every two corners of different images vote for the turn, scale and shift that takes one to the
   other.  Images are dealt to groups of GROUP; a task takes two groups, makes the votes of their lists in blocks, and keeps
   those of pairs that have MIN_VOTES at least, so no vote is shuffled or left out.  Votes grow with the square of a list.
3. Geometric consensus: MIN_VOTES corners of an image that agree on the transformation link it to the other.  Votes for a
   pair count together whichever list they come from.
   All links are counted, but a task gives a row for each linked image only (its number of links there and the least
   image they join it to), so many near copies don't become all their pairs.
4. Components of links are classes (components.py).

Equal images are one node from the start, told by 60 bits of their digest.  Nothing is broadcast or collected; an image's
packed corners are sent once for each group, and a large group of equal copies costs its corners.

Cases: null or unreadable images and those without corners have no votes; equal ones are one class still, null
ones are classes of their own; repeated ids are rows of their own; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

#: Scales of an image, corners at each, and the corners that must agree.
SCALES, PER_SCALE, MIN_VOTES = (1.0, 2 / 3, 4 / 9), (20, 12, 6), 4
AREA = 96 * 96
BITS, RADIUS, TURNS = 128, 8, 32
MARGIN = 12  # pixels that turned tests and smoothing reach
#: Sizes of a bin of agreement: pixels of shift, and parts of a turn.
SHIFT_BIN, TURN_BIN = 10.0, 8
#: Images of AREA pixels that are worked on at a time.
BATCH = 64
#: Images of a group; votes, and pairs of images, that a task makes at a time (one image's with a group at least).
GROUP, VOTES, CELLS = 8192, 1 << 21, 1 << 23

#: CORNERS: key long, node long, spot long.
#: A spot packs a corner's turn (5 bits), scale (2 bits), and y and x in quarters of a pixel (24 bits each).
PLACE_BITS = 24

_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def read_pgm(image: bytes | None) -> np.ndarray | None:
    head = _HEADER.match(image) if image else None
    if not head:
        return None
    w, h = int(head[1]), int(head[2])
    return np.frombuffer(image, np.uint8, w * h, head.end()).reshape(h, w) if len(image) - head.end() >= w * h else None


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the compared pixels for each turn: (TURNS, BITS, 2 pixels) rows and columns."""
    r = np.random.default_rng(1234)
    at = np.clip(r.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
    at /= np.maximum(1, np.hypot(at[..., 0], at[..., 1]) / RADIUS)[..., None]
    turn = 2 * np.pi * np.arange(TURNS) / TURNS
    y = at[None, ..., 0] * np.cos(turn)[:, None, None] + at[None, ..., 1] * np.sin(turn)[:, None, None]
    x = -at[None, ..., 0] * np.sin(turn)[:, None, None] + at[None, ..., 1] * np.cos(turn)[:, None, None]
    return np.rint(y).astype(np.int64), np.rint(x).astype(np.int64)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 pixels (edges repeated) of the last two axes."""
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float32)
        n = s.shape[axis]
        a = (np.take(s, np.arange(2 * r + 1, n), axis) - np.take(s, np.arange(0, n - 2 * r - 1), axis)) / (2 * r + 1)
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, after smoothing."""
    if scale == 1:
        return a
    a = _box(a, 1)
    for axis in (-2, -1):
        n = a.shape[axis]
        at = np.clip((np.arange(max(1, int(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(0, n - 2))
        part = (at - low).astype(np.float32)
        part = part[:, None] if axis == -2 else part
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, n - 1), axis) * part
    return a


def corners(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of images (n, h, w): image number, x, y (in the image's pixels), scale number, turn and descriptor (bits) of each corner."""
    test_y, test_x = _tests()
    dy, dx = np.mgrid[-RADIUS + 1 : RADIUS, -RADIUS + 1 : RADIUS]
    disc = dy**2 + dx**2 < RADIUS**2
    dy, dx = dy[disc], dx[disc]
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for number, (scale, most) in enumerate(zip(SCALES, PER_SCALE, strict=True)):
        a = _resized(images.astype(np.float32), scale)
        n, h, w = a.shape
        if min(h, w) <= 2 * MARGIN + 2:
            continue
        smooth = _box(a, 1)
        gy, gx = np.zeros_like(a), np.zeros_like(a)
        gy[:, 1:-1], gx[:, :, 1:-1] = smooth[:, 2:] - smooth[:, :-2], smooth[:, :, 2:] - smooth[:, :, :-2]
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
        strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        top = strength
        for axis in (1, 2):
            parts = [np.roll(top, s, axis) for s in (-2, -1, 0, 1, 2)]
            top = np.maximum.reduce(parts)
        inner = np.zeros((h, w), bool)
        inner[MARGIN : h - MARGIN, MARGIN : w - MARGIN] = True
        rank = np.where((strength == top) & inner & (strength > 1.0), strength, 0).reshape(n, -1)
        order = np.argsort(-rank, axis=1, kind="stable")[:, : max(most, most * images.shape[1] * images.shape[2] // AREA)]
        image, place = np.repeat(np.arange(n), order.shape[1]), order.ravel()
        keep = rank[image, place] > 0
        image, y, x = image[keep], place[keep] // w, place[keep] % w
        patch = smooth[image[:, None], y[:, None] + dy, x[:, None] + dx]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        ty, tx = test_y[turn], test_x[turn]
        soft = _box(a, 2)
        # Offsets are turned with the patch: rows by the sine, columns by the cosine.
        value = soft[image[:, None, None], y[:, None, None] + ty, x[:, None, None] + tx]
        for o, v in zip(out, (image, (x + 0.5) / scale, (y + 0.5) / scale, np.full(len(image), number), turn, np.packbits(value[..., 0] < value[..., 1], axis=1)), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros((0, BITS // 8) if k == 5 else 0, np.uint8) for k, o in enumerate(out))


def described(images: DataFrame) -> DataFrame:
    """images(node long, image binary) -> (node, corners binary): of each corner its keys (four of 32 bits) and its spot (64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_shape: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            for node, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pixels = read_pgm(image.as_py())
                if pixels is not None:
                    by_shape.setdefault(pixels.shape, []).append((node, pixels))
            for own in by_shape.values():
                few = max(1, BATCH * AREA // max(AREA, own[0][1].size))
                for i in range(0, len(own), few):
                    part = own[i : i + few]
                    image, x, y, scale, turn, bits = corners(np.stack([p for _, p in part]))
                    spot = (((turn.astype(np.int64) << 2 | scale.astype(np.int64)) << PLACE_BITS | np.rint(y * 4).astype(np.int64)) << PLACE_BITS) | np.rint(x * 4).astype(np.int64)
                    packed = np.concatenate([np.ascontiguousarray(bits).reshape(-1, BITS // 8), spot.view(np.uint8).reshape(-1, 8)], axis=1)
                    image = image.astype(np.int64)
                    blobs = [packed[image == k].tobytes() for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array(blobs, pa.binary())], ["node", "corners"])

    return images.select("node", "image").mapInArrow(run, "node long, corners binary")


def _unpacked(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, corners) -> key, node and spot of each corner and table, equal ones once."""
    tables = BITS // 32
    raw = part["corners"].to_pylist()
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BITS // 8 + 8)
    node = np.repeat(part["node"].to_numpy(), [len(x) // (BITS // 8 + 8) for x in raw])
    keys = np.ascontiguousarray(rows[:, : BITS // 8]).view(np.uint32).astype(np.int64) + (np.arange(tables) << 32)
    spot = np.ascontiguousarray(rows[:, BITS // 8 :]).view(np.int64).ravel()
    return _distinct(keys.ravel(), np.repeat(node, tables), np.repeat(spot, tables))


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, in the order of the columns from the last to the first."""
    order = np.lexsort(columns)
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[new] for c in columns)


def _spot(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, scale and turn of spots."""
    place = (1 << PLACE_BITS) - 1
    return (c & place) / 4.0, (c >> PLACE_BITS & place) / 4.0, c >> 2 * PLACE_BITS & 3, c >> (2 * PLACE_BITS + 2)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))


def _agreed(pair: np.ndarray, spot: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Votes of pairs: which pairs have MIN_VOTES that agree."""
    spot, lead, pair = _distinct(spot, lead, pair)
    (x, y, scale, turn), (lx, ly, lead_scale, lead_turn) = _spot(spot), _spot(lead)
    ratio = SCALES[1] ** (lead_scale - scale).astype(np.float64)  # size of the image's corner over the leader's
    angle = (turn - lead_turn) * (2 * np.pi / TURNS)
    zoom, turned = scale - lead_scale, (turn - lead_turn) % TURNS
    sx, sy = x - ratio * (np.cos(angle) * lx - np.sin(angle) * ly), y - ratio * (np.sin(angle) * lx + np.cos(angle) * ly)
    place = spot & ((1 << (2 * PLACE_BITS + 2)) - 1)
    size, found = TURNS // TURN_BIN, []
    # Eight grids, each axis half a bin apart or not, so votes within half a bin on every axis share a bin of one of them.
    for half_turn, half_x, half_y in itertools.product((0.0, 0.5), repeat=3):
        bins = np.floor((turned + half_turn * size) % TURNS / size), np.floor(sx / SHIFT_BIN + half_x), np.floor(sy / SHIFT_BIN + half_y)
        votes = _distinct(place, *bins, zoom, pair)
        cuts = _runs(*votes[1:])
        found.append(np.unique(votes[-1][cuts[:-1][np.diff(cuts) >= MIN_VOTES]]))
        rest = ~np.isin(pair, found[-1])
        pair, place, zoom, turned, sx, sy = (c[rest] for c in (pair, place, zoom, turned, sx, sy))
    return np.concatenate(found)


def _linked(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key, node and spot of the corners of two groups (or of one, twice) -> u and v of links."""
    key, node, spot = (c[np.argsort(one[1], kind="stable")] for c in one)
    other_key, other_node, other_spot = (c[np.argsort(two[0], kind="stable")] for c in two)
    names, number = np.unique(other_node, return_inverse=True)
    first = np.searchsorted(other_key, key)
    count = np.searchsorted(other_key, key, "right") - first
    cuts = _runs(node)
    votes = np.append(0, np.cumsum(count))[cuts]
    i = 0
    while i + 1 < len(cuts):
        j = max(i + 1, min(i + CELLS // max(1, len(names)), int(np.searchsorted(votes, votes[i] + VOTES, "right")) - 1, len(cuts) - 1))
        low, many = cuts[i], count[cuts[i] : cuts[j]]
        mine = np.repeat(np.arange(low, cuts[j]), many)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + first[mine]
        if same:
            keep = node[mine] < other_node[other]
            mine, other = mine[keep], other[keep]
        image = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))  # of the rows from low on
        cell = image[mine - low] * len(names) + number[other]
        keep = (np.bincount(cell, minlength=1) >= MIN_VOTES)[cell]
        mine, other, cell = mine[keep], other[keep], cell[keep]
        # The greater image's corner votes, the lesser's leads.
        up = node[mine] > other_node[other]
        pair = _agreed(cell, np.where(up, spot[mine], other_spot[other]), np.where(up, other_spot[other], spot[mine]))
        a, b = node[cuts[i + pair // max(1, len(names))]], names[pair % max(1, len(names))]
        yield np.maximum(a, b), np.minimum(a, b)
        i = j


def _listed(_: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    u, v = zip((np.zeros(0, np.int64),) * 2, *found, strict=True)
    return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})


def _joined(nodes: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Distinct nodes, and links in blocks -> node, root (the least node that the links join it to) and n (its links), of nodes with links."""
    root, n = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    for u, v in found:
        a, b = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
        n += np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
        while (root[a] != root[b]).any():
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root != root[root]).any():
                root = root[root]
    own = np.flatnonzero(n)
    return pa.table({"node": nodes[own], "root": nodes[root[own]], "n": n[own]})


def _by_groups(images: DataFrame, read: Callable[[pa.Table], tuple[np.ndarray, ...]], make: Callable[[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """images(node, ...), a row for each, that read makes key, node and spot of -> what make does with the links of each two groups."""
    n = images.count()
    groups = max(-(-n // GROUP), min(4, -(-n // 1024)), 1)
    own = images.withColumn("own", F.pmod(F.xxhash64("node", F.lit(17)), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = own.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")

    def run(part: pa.Table) -> pa.Table:
        low, high = part["low"][0].as_py(), part["high"][0].as_py()
        one = read(part.filter(pc.equal(part["own"], low)))
        two = one if low == high else read(part.filter(pc.equal(part["own"], high)))
        return make(np.union1d(one[1], two[1]), _linked(one, two, low == high))

    return dealt.repartition(groups * (groups + 1) // 2, "low", "high").groupBy("low", "high").applyInArrow(run, schema)


def links(rows: DataFrame) -> DataFrame:
    """CORNERS -> (u, v): all pairs of images that enough corners agree on; as many as the square of a group of copies."""

    def read(part: pa.Table) -> tuple[np.ndarray, ...]:
        lists = part["lists"].combine_chunks()
        key, spot = (lists.flatten().field(c).to_numpy() for c in ("key", "spot"))
        return _distinct(key, np.repeat(part["node"].to_numpy(), pc.list_value_length(lists).to_numpy()), spot)

    return _by_groups(saved(rows.groupBy("node").agg(F.collect_list(F.struct("key", "spot")).alias("lists"))), read, _listed, "u long, v long")


def image_classes(images: DataFrame) -> DataFrame:
    """images(image_id, image) -> image_id, class_id (the least id of its copies), n_links (of its node)."""
    digest = F.conv(F.substring(F.sha2("image", 256), 1, 15), 16, 10).cast("long")
    ids = F.col("image_id").cast("long").alias("image_id")
    nodes = saved(images.select(ids, digest.alias("node")))
    packed = described(images.filter("image is not null").select(digest.alias("node"), "image"))
    # Equal images have equal corners.
    found = saved(_by_groups(saved(packed.groupBy("node").agg(F.min("corners").alias("corners"))), _unpacked, _joined, "node long, root long, n long"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    distinct = nodes.filter("node is not null").groupBy("node").agg(F.min("image_id").alias("least"))
    named = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = named.join(least, "root").join(degree, "node", "left").select("node", "class_id", "n_links")
    return nodes.join(classes, "node", "left").select("image_id", F.when(F.col("node").isNull(), F.col("image_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


SIDE = 96


def _basis(width: int) -> np.ndarray:
    """Smooth random pictures, one for each component of a vector."""
    r = np.random.default_rng(99)
    a = r.normal(0, 1, (width, SIDE, SIDE)).astype(np.float32)
    a = _box(_box(a, 2), 1)
    return (a / a.std(axis=(1, 2), keepdims=True)).reshape(width, -1)


def rendered(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> (image_id, image): each vector as a picture, a sum of fixed pictures weighted by its components.

    Vectors that are near each other give pictures that look like edited copies.  Of ids divisible by ten
    there is a cropped copy with other brightness and contrast too, under -id - 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, len(b), 256):
                ids, images = [], []
                for k, v in zip(b.column(0)[i : i + 256].to_pylist(), b.column(1)[i : i + 256].to_pylist(), strict=True):
                    v = np.array([0.0 if c is None else c for c in v or []], np.float32)
                    if len(v) and len(v) not in basis:
                        basis[len(v)] = _basis(len(v))
                    raw = (v @ basis[len(v)] if len(v) else np.zeros(SIDE * SIDE, np.float32)).reshape(SIDE, SIDE)
                    ids.append(k)
                    images.append(write_pgm(np.clip(128 + 50 * raw, 0, 255).astype(np.uint8)))
                    if k is not None and k % 10 == 0:
                        ids.append(-k - 1)
                        images.append(write_pgm(edited(raw, k)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, image binary")


def edited(raw: np.ndarray, k: int) -> np.ndarray:
    """A crop of 80 pixels, brighter and of less contrast, as k says."""
    top, left = k // 10 % 5 * 4, k // 50 % 5 * 4
    return np.clip(140 + (30 + k % 3 * 10) * raw[top : top + 80, left : left + 80], 0, 255).astype(np.uint8)
