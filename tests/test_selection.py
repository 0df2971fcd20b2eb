"""Ranks, budgets, greedy picks, splits, pairs and cleaning against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import clean as C
from driftlens.operators import pairs as P
from driftlens.operators import ranks as R
from driftlens.operators import select as S
from driftlens.operators import split as T


def test_ranks_and_totals_match_sorting(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.random(500)))]
    frame = spark.createDataFrame(rows, "k int, v double, i int")
    ranked = {r.i: r.rank for r in R.bucketed_rank(frame, ["k"], R.unit_bucket(F.col("v"), 7), ["v", "i"]).collect()}
    summed = {r.i: (r.cum_v, r.all_v) for r in R.running_totals(frame, ["k"], R.unit_bucket(F.col("v"), 7), ["v"], ["v"]).collect()}
    for k in range(3):
        mine = sorted((v, i) for kk, v, i in rows if kk == k)
        total = 0.0
        for n, (v, i) in enumerate(mine, 1):
            total += v
            assert ranked[i] == n and summed[i][0] == pytest.approx(total)
            assert summed[i][1] == pytest.approx(sum(v for v, _ in mine))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(np.round(v, 2))) for k, v in zip(rng.integers(0, 2, 301), rng.random(301))]
    out = R.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0.1, 0.5, 0.99], R.unit_bucket(F.col("v"), 16)).collect()
    assert len(out) == 6
    for r in out:
        assert r.quantile == pytest.approx(np.quantile([v for k, v in rows if k == r.k], float(r.fraction)))


def test_first_n_is_pruned_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = R.first_n(frame, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > 0


@pytest.mark.parametrize("budget", [0, 7, 100, 333, 10_000])
def test_water_filling(spark, budget):
    rng = np.random.default_rng(2)
    caps = [int(c) for c in rng.integers(0, 40, 25)]
    frame = spark.createDataFrame([(1, i, c) for i, c in enumerate(caps)], "k int, i int, cap int")
    out = {r.i: r.allocated for r in S.allocate(frame, ["k"], "cap", ["i"], F.col("i"), F.lit(budget)).collect()}
    expected, left = [0] * len(caps), min(budget, sum(caps))
    while left:
        for i, c in enumerate(caps):
            if left and expected[i] < c:
                expected[i] += 1
                left -= 1
    assert [out[i] for i in range(len(caps))] == expected


def test_nonoverlap_equals_sequential_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", f"p{rng.integers(2)}", f"b{rng.integers(3)}", int(rng.integers(0, 20)), int(rng.integers(0, 20)), 8, 8, int(rng.integers(0, 50))) for i in range(80)]
    frame = spark.createDataFrame(rows, "crop_id string, parent string, building string, x int, y int, w int, h int, changed int")
    got = {(r.building, r.pick): r.crop_id for r in S.nonoverlap_pick(frame, "building", "parent", F.struct((-F.col("changed")).alias("a"), "crop_id"), 3).collect()}

    def iou(a, b):
        dx, dy = max(0, min(a[3] + 8, b[3] + 8) - max(a[3], b[3])), max(0, min(a[4] + 8, b[4] + 8) - max(a[4], b[4]))
        return dx * dy / (128 - dx * dy)

    for building in {r[2] for r in rows}:
        chosen = []
        for row in sorted((r for r in rows if r[2] == building), key=lambda r: (-r[7], r[0])):
            if len(chosen) < 3 and not any(row[1] == c[1] and iou(row, c) > 0.25 for c in chosen):
                chosen.append(row)
        assert [got[building, i + 1] for i in range(len(chosen))] == [c[0] for c in chosen]


def test_constrained_split_counts(spark):
    rows = [(f"m{i:02d}", "medium") for i in range(25)] + [(f"s{i:02d}", "short") for i in range(20)] + [(f"l{i:02d}", "long") for i in range(10)]
    series = spark.createDataFrame(rows, "building_id string, series string")
    fixed = spark.createDataFrame([], "building_id string, split string")
    out = T.assign_split_constrained(series, fixed, {"train": 0.7, "val": 0.1, "test": 0.2})
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 38, "val": 6, "test": 11}
    assert out.filter("series != 'medium' AND split != 'train'").count() == 0
    again = T.assign_split_constrained(series.repartition(7).orderBy(F.rand(1)), fixed, {"train": 0.7, "val": 0.1, "test": 0.2})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_fixed_owners_never_move(spark):
    buildings = spark.createDataFrame([(f"b{i}", float(i % 5 + 1)) for i in range(40)], "building_id string, weight double")
    fixed = spark.createDataFrame([("b1", "test"), ("b2", "val"), ("b3", "train")], "building_id string, split string")
    out = {r.building_id: r.split for r in T.assign_split(buildings, fixed, {"train": 0.7, "val": 0.1, "test": 0.2}).collect()}
    assert len(out) == 40 and (out["b1"], out["b2"], out["b3"]) == ("test", "val", "train")


IMAGE = "image_id int, file_name string, view_id string, year int, building_id string, split string, sha256 string"


def test_pair_policies(spark):
    rows = [(1, "a.jpg", "v", 2000, "A", "train", "h1"), (2, "b.jpg", "v", 2000, "A", "train", "h2"), (3, "c.jpg", "v", 2003, "A", "train", "h1"), (4, "d.jpg", "v", 2007, "A", "val", "h4"), (5, "e.jpg", "v", 2007, "B", "train", "h5")]
    images = spark.createDataFrame(rows, IMAGE)
    anchored = {(r.reference_id, r.source_id): r.reason for r in P.first_anchor(images).collect()}
    assert anchored == {(1, 3): "identical_bytes", (1, 4): "different_partitions", (1, 5): "conflicting_or_partial_building"}
    for policy, steps in (("adjacent", {(2000, 2003), (2003, 2007)}), ("all", {(2000, 2003), (2003, 2007), (2000, 2007)})):
        counted = {(r.reference_year, r.source_year): r for r in P.step_counts(images, policy).collect()}
        assert set(counted) == steps
        listed = P.expand(P.year_steps(images, policy), images).collect()
        for key, row in counted.items():
            mine = [p for p in listed if (p.reference_year, p.source_year) == key]
            reasons = [p.reason for p in mine]
            assert row.pairs == len(mine) and row.eligible_pairs == reasons.count(None)
            assert row.identical_bytes == reasons.count("identical_bytes") and row.different_partitions == reasons.count("different_partitions")
            assert row.conflicting_building == reasons.count("conflicting_or_partial_building")


def test_rename_chains_and_cycles(spark):
    maps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "old_name string, new_name string")
    out = {r.name: (r.final_name, r.in_cycle) for r in C.rename_closure(maps).collect()}
    assert out == {"a": ("c", False), "b": ("c", False), "c": ("c", False), "x": (None, True), "y": (None, True), "s": ("s", False)}
    bad = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "c")], "old_name string, new_name string")
    assert {(r.name, r.problem) for r in C.rename_problems(bad).collect()} == {("a", "conflicting_source"), ("c", "conflicting_target")}


def test_leakage_gate(spark):
    schema = "image_id int, file_name string, sha256 string, building_id string, view_id string, year int, split string, metadata_status string, temporal_eligible boolean"
    good = [(1, "1", "h1", "A", "va", 2000, "train", "reviewed", True), (2, "2", "h2", "A", "va", 2001, "train", "reviewed", True), (3, "3", "h3", "B", "vb", 2000, "val", "reviewed", True), (4, "4", "h4", "C", "vc", 2000, "test", "reviewed", True)]
    assigned = spark.createDataFrame([("A", "train"), ("B", "val"), ("C", "test")], "building_id string, split string")
    empty = spark.createDataFrame([], schema)
    images = spark.createDataFrame(good, schema)
    assert T.leakage_audit(images, assigned, empty).count() == 0
    pairs = spark.createDataFrame([("1-2", 1, 2, "train", "A", "va")], "pair_id string, reference_id int, source_id int, split string, building_id string, view_id string")
    assert T.pair_audit(pairs, images).count() == 0
    leak = spark.createDataFrame([*good, (5, "5", "h3", "D", " VA ", 2002, "test", "inferred", True)], schema)
    found = {(r.violation, r.item) for r in T.leakage_audit(leak, assigned, empty).collect()}
    assert found == {("unreviewed_holdout_image", "5"), ("cross_split_identity", "sha256=h3"), ("cross_split_identity", "view_id=va"), ("view_has_multiple_buildings", "va")}


def test_address_overlap_counts(spark):
    views = spark.createDataFrame([("Main_1-5",), ("main_5-9",), ("main_10",), ("main_12-20",), ("other_3",), ("park",)], "view_id string")
    out = {r.view_id: (r.overlaps, r.cluster) for r in P.address_overlaps(views).collect()}
    assert out == {"Main_1-5": (1, 1), "main_5-9": (1, 1), "main_10": (0, 10), "main_12-20": (0, 12), "other_3": (0, 3)}


def test_score_buckets_spread_small_scores_and_keep_order(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.random(400) * 1e-4, rng.random(400), rng.normal(size=200) * 50, [0.0, 1.0, -1.0, 2.0**-10, float("inf"), float("-inf"), float("nan")]]).astype(np.float32)
    frame = spark.createDataFrame([(float(v),) for v in values], "value float").select("value", R.score_bucket(F.col("value")).alias("b"))
    rows = sorted(((r.value, r.b) for r in frame.collect()), key=lambda r: (np.isnan(r[0]), r[0]))
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    assert len({b for v, b in rows if 0 < v < 1e-4}) > 15
