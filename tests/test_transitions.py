"""Transition candidates against a plain walk over small maps, and box sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import grid as G
from driftlens.operators import transitions as T

SIDE = 14


def flood(mask):
    """8-connected components as {position id of the first pixel: set of pixels}."""
    left, out = set(zip(*map(list, np.nonzero(mask)))), {}
    while left:
        todo, part = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.discard((y, x))
                part.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        y, x = min(part)
        out[(int(y) << 31) + int(x)] = part
    return out


def near(mask):
    wide = np.pad(mask, 1)
    return np.max([wide[a: a + SIDE, b: b + SIDE] for a in range(3) for b in range(3)], axis=0)


def by_hand(old, new, support, min_pixels, min_support, min_fraction, context, sizes):
    known, rows = support & (old != 0) & (new != 0), []
    has = lambda plane, c: (plane >> c) & 1 == 1
    raw_gain, raw_loss = ({c: known & has(b, c) & ~has(a, c) for c in range(2)} for a, b in ((old, new), (new, old)))
    gain, loss = ({c: known & has(b, c) & ~near(has(a, c)) for c in range(2)} for a, b in ((old, new), (new, old)))
    layers = [("appearance", -1, c, raw_gain[c], gain[c]) for c in range(2)] + [("disappearance", c, -1, raw_loss[c], loss[c]) for c in range(2)]
    layers += [("replacement", a, b, raw_loss[a] & raw_gain[b], loss[a] & gain[b]) for a in range(2) for b in range(2)]
    for event, a, b, raw, robust in layers:
        parents, taken = flood(raw), set()
        for component, part in sorted(flood(robust).items()):
            if len(part) < min_pixels:
                continue
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            boxes = [(min(ys), min(xs), max(ys) + 1, max(xs) + 1, None)]
            if sizes:
                low = lambda v, s: min(max(0, round(float(np.mean(v)) - (s - 1) / 2)), SIDE - s)
                boxes = [(low(ys, s), low(xs, s), low(ys, s) + s, low(xs, s) + s, s) for s in sizes if s <= SIDE]
            for y0, x0, y1, x1, size in boxes:
                inside = lambda y, x: y0 <= y < y1 and x0 <= x < x1
                area, count = (y1 - y0) * (x1 - x0), sum(inside(*p) for p in part)
                if (y0, x0, y1, x1) in taken or count < min_pixels or known[y0:y1, x0:x1].sum() / area < min_support or count / area < min_fraction:
                    continue
                taken.add((y0, x0, y1, x1))
                crop = (y0, x0, y1, x1) if sizes else (max(0, y0 - context), max(0, x0 - context), min(SIDE, y1 + context), min(SIDE, x1 + context))
                within = lambda p: crop[0] <= p[0] < crop[2] and crop[1] <= p[1] < crop[3]
                parent = [p for p in next(v for v in parents.values() if part <= v) if within(p)]
                ignored, own = sum(not robust[p] for p in parent), sum(within(p) for p in part)
                rows.append((event, a, b, component, size, y0, x0, y1, x1, *crop, int(known[crop[0]:crop[2], crop[1]:crop[3]].sum()), own, len(parent), ignored, len(parent) - ignored - own))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sizes,seed", [(None, 1), ((3, 6, 20), 2), ((5,), 3)])
def test_candidates_equal_a_plain_walk(spark, sizes, seed):
    rng, pixels, want = np.random.default_rng(seed), [], {}
    for image in range(3):
        # Blobs, so that components are large and lie inside larger raw ones.
        old, new = (np.kron(rng.integers(1, 4, (5, 5)), np.ones((3, 3), int))[:SIDE, :SIDE] for _ in range(2))
        new = np.where(rng.random((SIDE, SIDE)) < 0.1, rng.integers(0, 4, (SIDE, SIDE)), new)
        support = rng.random((SIDE, SIDE)) < 0.9
        pixels += [(image, y, x, int(old[y, x]), int(new[y, x]), bool(support[y, x])) for y in range(SIDE) for x in range(SIDE)]
        want[image] = by_hand(old, new, support, 2, 0.4, 0.1, 2, sizes)
    frame = spark.createDataFrame(pixels, "image int, y int, x int, old_bits int, new_bits int, support boolean")
    out = T.transition_candidates(frame, "image", 2, 1, 2, 0.4, 0.1, SIDE, 2, sizes)
    size = F.col("window_size") if sizes else F.lit(None)
    names = ["event", "from_class", "to_class", "component", size, "y0", "x0", "y1", "x1", "crop_y0", "crop_x0", "crop_y1", "crop_x1", "common_pixels", "candidate_pixels", "raw_pixels", "ignored_boundary_pixels", "other_robust_pixels"]
    got = {k: [] for k in want}
    for r in out.select("image", *names).collect():
        got[r[0]].append(tuple(r[1:]))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == want
    assert any(r[-2] for v in want.values() for r in v) and sum(map(len, want.values())) > 5


def test_no_changes_no_candidates(spark):
    frame = spark.createDataFrame([(1, y, x, 1, 1, True) for y in range(4) for x in range(4)], "image int, y int, x int, old_bits int, new_bits int, support boolean")
    for sizes in (None, (2,)):
        assert T.transition_candidates(frame, "image", 2, 1, 1, 0.1, 0.1, 4, 1, sizes).count() == 0


def test_box_counts(spark):
    rng = np.random.default_rng(0)
    plane = rng.integers(0, 5, (9, 7))
    points = spark.createDataFrame([(1, y + 3, x - 2, int(plane[y, x])) for y in range(9) for x in range(7) if plane[y, x]], "k int, y int, x int, n int")
    frames = spark.createDataFrame([(1, 3, -2, 12, 5), (2, 0, 0, 2, 2)], "k int, fy0 int, fx0 int, fy1 int, fx1 int")
    boxes = [(1, b, *v) for b, v in enumerate([(3, -2, 12, 5), (4, 0, 6, 3), (0, -9, 5, 1), (11, 4, 40, 40), (20, 20, 30, 30), (-5, -5, 0, 0), (5, 1, 5, 3)])]
    out = G.box_counts(points, ["k"], frames, ["n"], spark.createDataFrame(boxes, "k int, b int, y0 int, x0 int, y1 int, x1 int"), ["b"])
    cut = lambda v, low, high: max(low, min(high, v))
    want = {b: int(plane[cut(y0, 3, 12) - 3: cut(y1, 3, 12) - 3, cut(x0, -2, 5) + 2: cut(x1, -2, 5) + 2].sum()) for _, b, y0, x0, y1, x1 in boxes}
    assert {r["b"]: r["n"] for r in out.collect()} == want


@pytest.mark.parametrize("sizes", [None, (5, 70)])
def test_components_across_blocks_equal_a_plain_walk(spark, monkeypatch, sizes):
    """Four blocks and a few pixels of five more; robust and raw components cross their borders."""
    side = 130
    monkeypatch.setitem(globals(), "SIDE", side)
    rng = np.random.default_rng(4)
    old, new = (np.kron(rng.integers(1, 4, (15, 15)), np.ones((9, 9), int))[:side, :side] for _ in range(2))
    new[62:66, :] = 1
    old[62:66, :] = 2
    support = rng.random((side, side)) < 0.97
    pixels = [(7, y, x, int(old[y, x]), int(new[y, x]), bool(support[y, x])) for y in range(side) for x in range(side)]
    want = by_hand(old, new, support, 2, 0.4, 0.1, 2, sizes)
    frame = spark.createDataFrame(pixels, "image int, y int, x int, old_bits int, new_bits int, support boolean")
    out = T.transition_candidates(frame, "image", 2, 1, 2, 0.4, 0.1, side, 2, sizes)
    size = F.col("window_size") if sizes else F.lit(None)
    names = ["event", "from_class", "to_class", "component", size, "y0", "x0", "y1", "x1", "crop_y0", "crop_x0", "crop_y1", "crop_x1", "common_pixels", "candidate_pixels", "raw_pixels", "ignored_boundary_pixels", "other_robust_pixels"]
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=repr) == want
    assert any(r[5] < 64 < r[7] for r in want) and any(r[-1] for r in want)


def test_changes_of_many_classes_stay_inside_tasks(spark, monkeypatch):
    """No table between two steps has a row per pixel and class pair: 19 changes a pixel here."""
    frame = spark.range(32 * 32).selectExpr("1 AS image", "CAST(id DIV 32 AS INT) AS y", "CAST(id % 32 AS INT) AS x", "15 AS old_bits", "112 AS new_bits", "true AS support")
    kept, rows = T.stored, []

    def counted(df, name):
        table = kept(df, name)
        rows.append(table.count())
        return table

    monkeypatch.setattr(T, "stored", counted)
    assert T.transition_candidates(frame, "image", 7, 1, 2, 0.5, 0.5, 32, 3).count() == 19
    assert max(rows) <= 32 * 32
