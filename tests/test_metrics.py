"""Hand-computed examples of counts, policies, calibration and ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import metrics as M
from driftlens.operators import aggregate as A
from driftlens.operators import calibrate as C
from driftlens.operators import decide as D


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_float32_boundary_is_strict(spark):
    t = np.float32(0.2)
    values = [float(t), float(np.nextafter(t, np.float32(1))), float(np.nextafter(t, np.float32(0)))]
    rows = spark.createDataFrame([(v,) for v in values], "score float").select(D.above(F.col("score"), 0.2).alias("m")).collect()
    assert [r.m for r in rows] == [False, True, False]


def test_linear_buckets_equal_strict_comparison(spark):
    rng = np.random.default_rng(5)
    grid = np.linspace(0, 1, 101, dtype=np.float32)
    values = np.concatenate([grid, np.nextafter(grid, np.float32(2)), np.nextafter(grid, np.float32(-1)), rng.random(200).astype(np.float32)])
    frame = spark.createDataFrame([(float(v),) for v in values], "score float").select("score", C.linear_bucket(F.col("score")).alias("k"))
    for row in frame.collect():
        assert row.k == int((np.float32(row.score) > grid).sum())


def test_geometric_buckets(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([10 ** rng.uniform(-37, 0, 300), [0.0, 0.5, 1.0]]).astype(np.float32)
    frame = spark.createDataFrame([(float(v),) for v in values], "score float")
    grid = [r.t for r in spark.range(769).select(C.geometric_threshold(F.col("id")).alias("t")).collect()]
    for row in frame.select("score", C.geometric_bucket(F.col("score")).alias("k")).collect():
        assert row.k == sum(np.float32(row.score) > np.float32(t) for t in grid)


PIXELS = [(1, 1, 1), (1, 1, 1), (1, 0, 1), (1, 0, 1), (1, 0, 0), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1), (None, 1, 1)]


def test_pair_counts(spark):
    # label, baseline, gate
    frame = spark.createDataFrame([(y, bool(b), bool(g)) for y, g, b in PIXELS], "label int, b boolean, a boolean")
    row = one(frame.agg(*M.pair_counts(F.col("a"), F.col("b"), F.col("label"))))
    assert [row[n] for n in M.PAIR_COUNTS] == [2, 0, 2, 2, 1, 1, 1, 0]
    rates = M.recall_rates(F.lit("H1"))
    counted = frame.agg(*M.pair_counts(F.col("a"), F.col("b"), F.col("label")))
    row = one(counted.select(rates["lost_recall"].alias("lost"), rates["rejected_tp_fraction"].alias("rejected"), rates["removed_h0_fpr"].alias("h0")))
    assert row["lost"] == pytest.approx(2 / 6) and row["rejected"] == pytest.approx(2 / 4) and row["h0"] is None


def test_buildings_weigh_equally(spark):
    rows = [("A", 1.0, None)] * 10 + [("B", 0.0, None)]
    frame = spark.createDataFrame([("val", *r) for r in rows], "split string, building_id string, fpr double, f1 double")
    row = one(A.building_macro(frame, ["split"], ["fpr", "f1"]))
    assert row["fpr"] == 0.5 and row["f1"] is None and row["f1_buildings"] == 0 and row["cases"] == 11


def test_policies_differ_only_where_stated(spark):
    frame = spark.createDataFrame([(0, 0, 3, 5), (0, 0, 0, 5), (0, 2, 0, 3)], "tp long, fp long, fn long, tn long")
    plain = [r.asDict() for r in frame.select(*[c.alias(n) for n, c in M.plain_metrics().items()]).collect()]
    zero = [r.asDict() for r in frame.select(*[c.alias(n) for n, c in M.zero_metrics().items()]).collect()]
    assert [r["precision"] for r in plain] == [0.0, None, 0.0]
    assert [r["precision"] for r in zero] == [0.0, 0.0, 0.0]
    assert [r["recall"] for r in plain] == [0.0, None, None]


def test_f1_calibration_takes_highest_tied_threshold(spark):
    pixels = [("h1", 0.6, 1), ("h1", 0.1, 0), ("h0", 0.1, 0), ("sham", 0.99, 0)]
    frame = spark.createDataFrame([("m", *p) for p in pixels], "method string, unit_id string, score float, label int")
    units = spark.createDataFrame([("h1", "A"), ("h0", "B")], "unit_id string, building_id string")
    row = one(C.calibrate_f1(frame, units, ["method"], F.col("score")))
    assert row["threshold"] == pytest.approx(0.59) and row["f1"] == 1.0 and row["fpr"] == 0.0


def lofo_rows(spark, extra=()):
    rows = [("m", "A", "a1", 0.1), ("m", "A", "a1", 0.1), ("m", "A", "a2", 0.9)] + [("m", "B", "b1", 0.5)] * 100 + list(extra)
    return spark.createDataFrame(rows, "method string, building_id string, unit_id string, score double")


def test_leave_one_out_weights(spark):
    held = spark.createDataFrame([("m", "C")], "method string, building_id string")
    rows = {r.building_id: r for r in C.lofo_thresholds(lofo_rows(spark), ["method"], (0.25,), heldout=held).collect()}
    assert rows["C"].threshold == 0.5 and rows["C"].achieved_fpr == pytest.approx(0.25) and rows["C"].train_buildings == 2
    # The held-out building's own values never matter.
    more = C.lofo_thresholds(lofo_rows(spark, [("m", "C", "c1", 0.99)] * 7), ["method"], (0.25,)).filter("building_id = 'C'")
    assert one(more)["threshold"] == 0.5


def test_leave_one_out_unsupported(spark):
    rows = spark.createDataFrame([("m", "A", "a", 0.4)], "method string, building_id string, unit_id string, score double")
    assert one(C.lofo_thresholds(rows, ["method"], (0.05,)))["status"] == "unsupported"


def test_leave_one_out_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"b{rng.integers(5)}", f"u{rng.integers(12)}", float(np.float32(rng.integers(0, 60) / 60))) for _ in range(900)]
    rows = [(m, b, b + u, s) for m, b, u, s in rows]
    got = {r.building_id: (r.threshold, r.achieved_fpr) for r in C.lofo_thresholds(spark.createDataFrame(rows, "method string, building_id string, unit_id string, score double"), ["method"], (0.2,)).collect()}
    for held in {r[1] for r in rows}:
        train = [r for r in rows if r[1] != held]
        best = None
        for t in sorted({r[3] for r in train}):
            per = {}
            for _, b, u, s in train:
                per.setdefault(b, {}).setdefault(u, []).append(s > t)
            fpr = np.mean([np.mean([np.mean(v) for v in us.values()]) for us in per.values()])
            if fpr <= 0.2 + 1e-12:
                best = (t, fpr)
                break
        assert got[held] == (pytest.approx(best[0]), pytest.approx(best[1]))


@pytest.mark.parametrize("scores,labels,expected", [((0.8, 0.8, 0.1), (1, 0, 1), 7 / 12), ((0.5, 0.5, 0.5), (1, 0, 1), 2 / 3)])
def test_average_precision(spark, scores, labels, expected):
    frame = spark.createDataFrame([("u", float(s), y) for s, y in zip(scores, labels)], "unit_id string, score float, label int")
    row = one(C.average_precision(C.precision_recall(frame, ["unit_id"], F.col("score")), ["unit_id"]))
    assert row["average_precision"] == pytest.approx(expected)


def test_average_precision_without_positives(spark):
    frame = spark.createDataFrame([("u", 0.5, 0)], "unit_id string, score float, label int")
    assert C.precision_recall(frame, ["unit_id"], F.col("score")).count() == 0


def test_test_rows_never_move_thresholds(spark):
    rows = [("m", f"u{i % 6}", float(np.float32((i * 37 % 100) / 100)), int(i % 3 == 0 and i % 6 < 3)) for i in range(300)]
    units = spark.createDataFrame([(f"u{i}", f"b{i % 2}") for i in range(6)], "unit_id string, building_id string")
    schema = "method string, unit_id string, score float, label int"
    base = one(C.calibrate_f1(spark.createDataFrame(rows, schema), units, ["method"], F.col("score")))
    noisy = rows + [("m", "test-unit", 0.99, 0)] * 50
    assert one(C.calibrate_f1(spark.createDataFrame(noisy, schema).repartition(5), units, ["method"], F.col("score"))) == base


def test_coverage_keeps_missing_apart(spark):
    expected = spark.createDataFrame([(i, "val") for i in range(4)], "unit_id int, split string")
    actual = spark.createDataFrame([(0, "completed", None, True), (1, "failed", "x", False)], "unit_id int, status string, reason string, evaluable boolean")
    row = one(A.coverage(expected, actual, "unit_id", ["split"]))
    assert (row["expected"], row["completed"], row["failed"], row["missing"], row["status"]) == (4, 1, 1, 2, "partial")


def test_exposure_macro_merges_without_sorting(spark):
    rows = [("a", "val", "x", e, tp, fp, 1, 4, 0.5) for e, tp, fp in (("seen", 1, 0), ("unknown", 2, 1), ("verified_unseen", 0, 3))] + [("a", "val", "y", "seen", 1, 1, 0, 2, 0.25)]
    frame = spark.createDataFrame(rows, "method string, split string, building_id string, exposure string, tp long, fp long, fn long, tn long, fpr double")
    out = A.exposure_macro(frame, ["method"], ["fpr"])
    got = {(r.split_scope, r.training_scope): (r.buildings, r.pairs, r.seen_buildings, r.verified_unseen_buildings, r.unknown_buildings, r.fpr) for r in out.collect()}
    assert got["val", "all"] == got["all_selected", "all"] == (2, 4, 1, 1, 0, 0.375)
    assert got["val", "seen"] == (2, 2, 2, 0, 0, 0.375) and got["val", "unknown"] == (1, 1, 0, 0, 1, 0.5)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_lofo_counts_units_without_their_scores(spark, monkeypatch):
    """A unit's pixels are counted on their own; grouped by score as well they would be about as many rows as pixels."""
    plans, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = [("m", b, f"{b}{u}", s) for b, values in (("A", (0.1, 0.1, 0.7)), ("B", (0.2, 0.4)), ("C", (0.1, 0.9))) for u, s in enumerate(values * 2)]
    got = C.lofo_thresholds(spark.createDataFrame(rows, "method string, building_id string, unit_id string, score double"), ["method"], (0.3,))
    assert {r.building_id: (round(r.threshold, 6), round(r.achieved_fpr, 6)) for r in got.collect()} == {"A": (0.4, 0.25), "B": (0.7, 0.25), "C": (0.4, 0.166667)}
    assert plans[0].count("Aggregate") == 1
