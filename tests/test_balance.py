"""Split search and canvas checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import geometry as G
from driftlens.operators import split as S

PARTS = {"train": 0.7, "val": 0.1, "test": 0.2}


def objective(rows):
    total = sum(w for _, w, _ in rows)
    return sum((sum(w for _, w, p in rows if p == s) - f * total) ** 2 for s, f in PARTS.items())


def neighbours(rows, held):
    """All assignments one move or one swap of free buildings away."""
    for i, (b, w, s) in enumerate(rows):
        if b in held:
            continue
        if sum(p == s for *_, p in rows) > 1:
            for t in PARTS:
                if t != s:
                    yield [*rows[:i], (b, w, t), *rows[i + 1:]]
        for j in range(i + 1, len(rows)):
            c, v, t = rows[j]
            if c not in held and s != t:
                out = list(rows)
                out[i], out[j] = (b, w, t), (c, v, s)
                yield out


@pytest.mark.parametrize("seed", [2])
def test_search_ends_where_no_exchange_helps(spark, seed):
    rng = np.random.default_rng(seed)
    weights = [(k, float(w)) for k, w in enumerate(rng.integers(1, 60, 18) * (1.5 if seed == 2 else 1))]
    held = {3: "test", 11: "train"}
    buildings = spark.createDataFrame(weights, "building_id int, weight double")
    fixed = spark.createDataFrame(list(held.items()), "building_id int, split string")
    rows = [tuple(r) for r in S.balanced_split(buildings, fixed, PARTS).select("building_id", "weight", "split").collect()]
    before = [tuple(r) for r in S.assign_split(buildings, fixed, PARTS).select("building_id", "weight", "split").collect()]
    assert sorted(r[:2] for r in rows) == weights and all(s == held[b] for b, _, s in rows if b in held)
    assert objective(rows) <= objective(before) + 1e-9
    assert all(objective(other) >= objective(rows) - 1e-6 for other in neighbours(rows, held))


@pytest.mark.parametrize("off", [7.3, -4.0, 0.4])
def test_best_swap_is_found_among_all_pairs(spark, off):
    rng = np.random.default_rng(8)
    rows = [(s, float(w), f"{s}{k}") for s in ("train", "val") for k, w in enumerate(rng.choice(200, 25, replace=False))]
    free = spark.createDataFrame(rows, "split string, weight double, id string")
    got = S._nearest_differences(free, [(0, "train", "val", off)], buckets=8).first()
    gaps = [a[1] - b[1] for a in rows for b in rows if a[0] == "train" and b[0] == "val" and a[1] != b[1]]
    assert abs(got["wa"] - got["wb"] - off) == min(abs(g - off) for g in gaps)


def test_few_buildings(spark):
    none = spark.createDataFrame([], "building_id int, split string")
    one = spark.createDataFrame([(1, 5.0)], "building_id int, weight double")
    assert S.balanced_split(one, none, PARTS).count() == 1
    assert S.balanced_split(one.filter("building_id > 1"), none, PARTS).count() == 0


@pytest.mark.parametrize("matrix,problem", [
    (np.eye(3), None), (np.eye(3) * 1e-14, None), (np.eye(3) * 1e200, None), (np.zeros((3, 3)), "not_finite"), (np.full((3, 3), np.nan), "not_finite"),
    ([[1, 0, 0], [0, 1, 0], [0.2, 0, -1]], "horizon"), ([[1, 2, 3], [2, 4, 6], [0, 0, 1]], "singular"), (np.outer([1, 2, 3], [1.1, 0.02, -3]), "singular"), ([[1, 0, 1e5], [0, 1, 0], [0, 0, 1]], "unsafe_size"),
])
def test_canvas_does_not_depend_on_the_matrix_scale(spark, matrix, problem):
    canvas = G.expanded_canvas(F.lit(16), F.lit(12), F.lit(16), F.lit(12), G.homography(*np.asarray(matrix, float).reshape(-1)))
    row = spark.range(1).select(*[c.alias(n) for n, c in canvas.items()]).first()
    assert row["problem"] == problem
    if problem is None:
        assert (row["left"], row["top"], row["canvas_width"], row["canvas_height"]) == (0, 0, 16, 12)
