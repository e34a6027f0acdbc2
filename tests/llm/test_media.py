import itertools
import math

import numpy as np
import pyarrow as pa

from sparksieve.llm import media
from sparksieve.llm.media import _basis, _box, corners, image_classes, links, read_pgm, rendered, write_pgm

SCHEMA = "image_id long, image binary, class_id string, node int"


def pictures(n, seed):
    r = np.random.default_rng(seed)
    basis = _basis(64)
    v = r.normal(0, 1, (n, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(128 + 50 * (x @ basis).reshape(96, 96)) for x in v], r


def to_image(a):
    return write_pgm(np.clip(a, 0, 255).astype(np.uint8))


def test_copies_are_found(spark):
    base, r = pictures(60, 3)
    rows = [(i, to_image(a)) for i, a in enumerate(base)]
    kinds = {
        100: lambda a: a[8:90, 4:88],  # cropped
        200: lambda a: 0.6 * a + 60,  # contrast and brightness
        300: lambda a: a + r.normal(0, 4, a.shape),  # noise
        400: lambda a: np.rot90(a),
        500: lambda a: np.pad(a, 10, constant_values=128),  # bordered
    }
    for offset, edit in kinds.items():
        rows += [(offset + i, to_image(edit(base[i]))) for i in range(20)]
    rows += [(600 + i, rows[i][1]) for i in range(5)] + [(700, None), (701, None), (702, b"no image"), (703, b""), (704, to_image(np.full((96, 96), 7))), (705, to_image(np.full((96, 96), 7))), (706, b"P5 90 90 255\nshort"), (None, rows[2][1]), (707, to_image(np.zeros((3, 2))))]
    got = image_classes(spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    of = {x.image_id: x.class_id for x in got}
    for offset in kinds:
        found = np.mean([of[offset + i] == of[i] for i in range(20)])
        assert found >= 0.9, (offset, found)
    assert all(of[600 + i] == of[i] == i for i in range(5)) and of[None] == 2
    assert of[700] == 700 and of[701] == 701 and of[702] == 702 and of[705] == of[704] == 704
    # Different pictures stay apart.
    assert len({of[i] for i in range(60)}) == 60
    assert {x.image_id for x in got if x.n_links} >= {100 + i for i in range(20) if of[100 + i] == i}


def test_crops_of_large_pictures(spark):
    """A quarter of a picture of 320 x 320 is found, for the number of corners grows with the area."""
    r = np.random.default_rng(21)
    base = _box(_box(r.normal(0, 1, (12, 320, 320)).astype(np.float32), 2), 1)
    base = 128 + 50 * base / base.std()
    rows = [(i, to_image(a)) for i, a in enumerate(base)] + [(100 + i, to_image(0.8 * a[20 + 10 * i : 180 + 10 * i, 130 - 9 * i : 290 - 9 * i] + 20)) for i, a in enumerate(base)]
    of = {x.image_id: x.class_id for x in image_classes(spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA)).collect()}
    assert np.mean([of[100 + i] == i for i in range(12)]) >= 0.9 and len({of[i] for i in range(12)}) == 12


def test_descriptors_ignore_contrast():
    base, _ = pictures(4, 5)
    a = np.stack([np.clip(x, 0, 255).astype(np.uint8) for x in base])
    one, two = corners(a), corners((a // 2 + 40).astype(np.uint8))
    same = [np.unpackbits(x ^ y).sum() for x, y in zip(one[5], two[5])] if len(one[5]) == len(two[5]) else [0]
    assert np.median(same) <= 8


def test_pgm():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (read_pgm(write_pgm(a)) == a).all() and read_pgm(None) is None and read_pgm(b"P5 4 4 255\n") is None


def test_recall_on_vectors(spark):
    """Classes of rendered vectors against brute force over all pairs of vectors."""
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (300, 64))
    v = np.concatenate([v, v[:100] + r.normal(0, 0.1, (100, 64)), np.repeat(v[:1], 150, axis=0) + r.normal(0, 0.1, (150, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1001, None), (1003, [])]
    of = {x.image_id: x.class_id for x in image_classes(rendered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect()}
    near = v @ v.T > 0.95
    pairs = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    assert np.mean([of[a] == of[b] for a, b in pairs]) >= 0.9
    assert all(near[a, b] or near[a, near[b]].any() for a in range(300) for b in range(a) if of[a] == of[b])


def test_links_past_leaders(spark):
    """Copies of which a stray lesser image shares half the lists; and a leader that shows a key twice."""
    spot = lambda y, x: (4 * y) << 24 | 4 * x
    rows = []
    for k in range(6):
        rows += [(k, 2, spot(20 + 7 * k, 30 + 5 * k)), (k, 3, spot(21 + 7 * k, 31 + 5 * k))] + ([(k, 1, spot(40 * k, 5))] if k < 3 else [])
    for k in range(10, 14):
        rows += [(k, 11, spot(3 * (k - 10), 90 - 20 * (k - 10))), (k, 11, spot(50 + 7 * (k - 10), 30)), (k, 12, spot(51 + 7 * (k - 10), 31))]
    assert sorted(map(tuple, links(spark.createDataFrame(rows, "key long, node long, spot long")).collect())) == [(3, 2), (12, 11)]


def test_votes_across_edges_of_bins(spark):
    """Shifts on both sides of an edge in x of one grid and in y of the other."""
    rows = []
    for k, (sx, sy) in enumerate([(9.5, 4.5), (9.5, 5.5), (10.5, 4.5), (10.5, 5.5)]):
        x, y = 20 + 15 * k, 70 - 9 * k
        rows += [(k, 1, (4 * y) << 24 | 4 * x), (k, 2, int(4 * (y + sy)) << 24 | int(4 * (x + sx)))]
    assert sorted(map(tuple, links(spark.createDataFrame(rows, "key long, node long, spot long")).collect())) == [(2, 1)]


def test_empty_table(spark):
    assert image_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def by_loops(rows):
    """links() by loops over all pairs of images and grids."""
    of = {}
    for key, node, spot in rows:
        of.setdefault(node, set()).add((key, spot))
    read = lambda s: ((s & (1 << 24) - 1) / 4, (s >> 24 & (1 << 24) - 1) / 4, s >> 48 & 3, s >> 50)
    found = []
    for u in of:
        for v in (v for v in of if v < u):
            best = 0
            for grid in itertools.product((0, 0.5), repeat=3):
                bins = {}
                for (key, spot), (lead_key, lead) in itertools.product(of[u], of[v]):
                    if key == lead_key:
                        (x, y, s, t), (lx, ly, ls, lt) = read(spot), read(lead)
                        ratio, angle = (2 / 3) ** (ls - s), (t - lt) * 2 * math.pi / 32
                        sx, sy = x - ratio * (math.cos(angle) * lx - math.sin(angle) * ly), y - ratio * (math.sin(angle) * lx + math.cos(angle) * ly)
                        where = s - ls, ((t - lt) % 32 + grid[0] * 4) % 32 // 4, math.floor(sx / 10 + grid[1]), math.floor(sy / 10 + grid[2])
                        bins.setdefault(where, set()).add((x, y, s))
                best = max([best, *map(len, bins.values())])
            if best >= 4:
                found.append((u, v))
    return sorted(found)


def test_links_behind_the_ends_of_lists(spark):
    """Two copies that share five lists, each with another least and another greatest image."""
    spot = lambda y, x: (4 * y) << 24 | 4 * x
    rows = []
    for k in range(5):
        rows += [(k, 5, spot(20 + 7 * k, 30 + 5 * k)), (k, 6, spot(21 + 7 * k, 31 + 5 * k)), (k, -k - 1, spot(9 * k, 80)), (k, 20 + k, spot(70, 9 * k))]
    assert sorted(map(tuple, links(spark.createDataFrame(rows, "key long, node long, spot long")).collect())) == [(6, 5)]


def test_all_links_of_all_lists(spark, monkeypatch):
    """Against loops, in one group and in several, and in one block of votes and in many."""
    r = np.random.default_rng(31)
    rows = []
    for family in range(6):
        corner = r.integers(0, 70, (14, 2))
        for node in range(family * 5, family * 5 + 5):
            dy, dx, scale, turn = r.integers(0, 20), r.integers(0, 20), int(r.integers(0, 2)), int(r.integers(0, 32))
            own = corner if node % 6 else r.integers(0, 70, (14, 2))
            for k in np.flatnonzero(r.random(14) < 0.7).tolist():
                y, x = (int(4 * v) for v in (own[k] + [dy, dx]))
                rows.append((int(r.integers(0, 4)) if r.random() < 0.2 else family % 3 * 20 + k, node * 37 % 101, (5 if node % 5 < 4 else turn) << 50 | (0 if node % 7 else scale) << 48 | y << 24 | x))
    want = by_loops(rows)
    assert 10 <= len(want) < 200
    for group, votes in ((8192, 1 << 21), (7, 40)):
        monkeypatch.setattr(media, "GROUP", group)
        monkeypatch.setattr(media, "VOTES", votes)
        assert sorted(map(tuple, links(spark.createDataFrame(rows, "key long, node long, spot long")).collect())) == want


def test_links_are_counted(spark, monkeypatch):
    """Classes and numbers of links in several groups, against components and degrees of the links listed."""
    base, r = pictures(30, 13)
    rows = [(i, to_image(a)) for i, a in enumerate(base)] + [(100 + i, to_image(base[i % 3][i % 5 * 2 : 90, i % 4 : 84] + r.normal(0, 2, (90 - i % 5 * 2, 84 - i % 4)))) for i in range(24)]
    images = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA)
    packed = {n: c for n, c in media.described(images.selectExpr("image_id node", "image")).collect()}
    key, node, spot = media._unpacked(pa.table({"node": pa.array(packed), "corners": pa.array(map(bytes, packed.values()), pa.binary())}))
    pairs = list(map(tuple, links(spark.createDataFrame(list(zip(key.tolist(), node.tolist(), spot.tolist())), "key long, node long, spot long")).collect()))
    least = {i: i for i, _ in rows}
    for _ in rows:
        for u, v in pairs:
            least[u] = least[v] = min(least[u], least[v])
    monkeypatch.setattr(media, "GROUP", 9)
    got = {x.image_id: (x.class_id, x.n_links) for x in image_classes(images).collect()}
    assert got == {i: (least[i], sum(i in p for p in pairs)) for i, _ in rows} and max(n for _, n in got.values()) >= 5


def test_links_of_few_rows(spark):
    """No rows, and one image alone."""
    for rows in ([], [(1, 1, 5), (1, 1, 6)]):
        assert links(spark.createDataFrame(rows, "key long, node long, spot long")).collect() == []
