"""Grids, labels, scores and segmentation on small fixtures."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import aggregate as A
from driftlens.operators import calibrate as K
from driftlens.operators import grid as G
from driftlens.operators import labels as L
from driftlens.operators import registry as V
from driftlens.operators import scoring as C
from driftlens.operators import segmentation as S


def test_class_slices_example(spark):
    # old, new, label, prediction; bit 7 and bit 3 classes
    rows = [(128, 8, 1, True), (8, 128, 1, False), (128, 128, 0, True), (8, 136, 1, True), (136, 8, 1, False), (8, 8, 0, False)]
    frame = spark.createDataFrame([(0, *r, True) for r in rows], "unit int, old_bits int, new_bits int, label int, pred boolean, support boolean")
    out = {(r.channel, r.direction): (r.tp, r.fp, r.fn, r.tn) for r in A.class_slices(frame, ["unit"], 8).collect()}
    assert out[7, "change"] == (2, 1, 2, 0) and out[7, "gain"] == (1, 1, 1, 0) and out[7, "loss"] == (1, 1, 1, 0)
    assert out[3, "change"] == (1, 0, 1, 1)


def test_two_denominators(spark):
    pixels = spark.range(9102).select(F.lit(0).alias("pair"), F.lit(1).alias("old_bits"), F.when(F.col("id") < 19, 2).otherwise(1).alias("new_bits"), F.lit(True).alias("support"))
    pixels = pixels.withColumn("label", L.derived_label(F.col("old_bits"), F.col("new_bits"), F.col("support")))
    row = L.pair_statistics(pixels, ["pair"], 2, F.lit(512 * 512).cast("bigint")).filter("channel = -1").first()
    assert row.changed == 19 and row.changed_known_percent == pytest.approx(1900 / 9102)
    assert row.changed_crop_percent == pytest.approx(1900 / 262144) and row.coverage_percent == pytest.approx(910200 / 262144)


def test_class_roi_example(spark):
    old, new, support = [1, 1, 3, 2, 1, 0], [1, 3, 2, 1, 3, 1], [True, True, True, True, False, True]
    frame = spark.createDataFrame([(0, o, n, s) for o, n, s in zip(old, new, support)], "pair int, old_bits int, new_bits int, support boolean")
    frame = frame.withColumn("label", L.derived_label(F.col("old_bits"), F.col("new_bits"), F.col("support")))
    out = {r.channel: (r.roi, r.changed, r.gain, r.loss, r.stable) for r in L.pair_statistics(frame, ["pair"], 2, F.lit(6).cast("bigint")).collect()}
    assert out[0] == (4, 2, 1, 1, 2) and out[1][:2] == (3, 2) and out[1][4] == 1


def test_inclusive_cutoffs(spark):
    frame = spark.createDataFrame([("A", -1, 100, 5, 1000), ("B", -1, 0, 0, 1000)], "building_id string, channel int, roi long, changed long, total_pixels long")
    out = {(r.denominator, r.cutoff): (r.pairs, r.buildings) for r in L.cutoff_sweep(frame).collect()}
    assert out["known", 5] == (1, 1) and out["known", 10] == (0, 0) and out["crop", 0] == (1, 1) and out["crop", 1] == (0, 0)


def dense(image, plane, name="value"):
    return [(image, y, x, int(v)) for y, row in enumerate(plane) for x, v in enumerate(row)]


def test_components_of_a_long_u_settle(spark):
    """Two arms over 150 blocks each, joined at the far end, with the least ids at both tops."""
    arm = spark.range(150).selectExpr("1 AS image", "CAST(id AS INT) AS y")
    mask = arm.selectExpr("image", "y", "0 AS x").unionByName(arm.selectExpr("image", "y", "2 AS x")).unionByName(spark.createDataFrame([(1, 149, 1)], "image int, y int, x int"))
    got = G.connected_components(mask.select("image", F.col("y").cast("int"), F.col("x").cast("int")), ["image"], block=1)
    assert got.select("component").distinct().count() == 1


def test_recall_threshold_is_the_optimum_of_many_scores(spark):
    rng = np.random.default_rng(8)
    score = rng.random(6000).astype(np.float32)
    scores = spark.createDataFrame([("m", float(s), 1 / 6000, 1 / 6000 * float(s < 0.9), 1) for s in np.unique(score)], "method string, score float, recall_mass double, fpr_mass double, h0_pixels long")
    values = np.unique(score)
    fpr = np.array([((values > v) & (values < np.float32(0.9))).sum() / 6000 for v in values])
    got = K.calibrate_recall(scores, ["method"], (0.0503,)).first()
    assert got.threshold == pytest.approx(float(values[fpr <= 0.0503 + 1e-12].min()), abs=1e-7)


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for image in range(3):
        plane = rng.random((40, 37)) < 0.42
        seen = np.zeros(plane.shape, bool)
        for y, x in zip(*np.nonzero(plane)):
            rows.append((image, int(y), int(x)))
            if seen[y, x]:
                continue
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                cy, cx = stack.pop()
                cells.append((cy, cx))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < 40 and 0 <= nx < 37 and plane[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            stack.append((ny, nx))
            first = min(cells)
            for c in cells:
                truth[image, c[0], c[1]] = (int(first[0]) << 31) + int(first[1])
    mask = spark.createDataFrame(rows, "image int, y int, x int")
    for block in (8, 64):
        got = {(r.image, r.y, r.x): r.component for r in G.connected_components(mask, ["image"], block=block).collect()}
        assert got == truth


def test_tile_ownership_counts_each_pixel_once(spark):
    images = spark.createDataFrame([(1, 1300, 900), (2, 100, 80), (3, 512, 1000)], "image_id int, width int, height int")
    owned = G.tile_ownership(G.tile_grid(images, 512, 448))
    areas = {r.image_id: r.a for r in owned.groupBy("image_id").agg(F.sum((F.col("x_to") - F.col("x_from")) * (F.col("y_to") - F.col("y_from"))).alias("a")).collect()}
    assert areas == {1: 1300 * 900, 2: 8000, 3: 512000} and owned.filter("gap").count() == 0


def test_runs_and_crowd(spark):
    rows = [(1, 5, 0, 0, 3, [2, 3, 4]), (2, 5, 1, 0, 3, [0, 1, 8]), (3, 5, 0, 1, 3, [4, 1, 4])]
    frame = spark.createDataFrame(rows, "annotation_id int, image_id int, channel int, iscrowd int, height int, counts array<int>")
    got = {(r.y, r.x): r.bits for r in G.rasterize_runs(frame).collect()}
    assert got == {(2, 0): 1, (0, 1): 1, (1, 1): 0, (0, 0): 2}


def test_runs_are_summed_inside_their_row(spark):
    """Ids may repeat, empty and null run lists set nothing, and pixels are sent to others only once they are merged."""
    rows = [(1, 5, 0, 0, 3, [2, 3, 4]), (1, 6, 1, 0, 3, [0, 1, 8, 2]), (1, 6, 1, 0, 3, []), (1, 6, 1, 0, 3, None)]
    frame = spark.createDataFrame(rows, "annotation_id int, image_id int, channel int, iscrowd int, height int, counts array<int>")
    out = G.rasterize_runs(frame)
    assert sorted(map(tuple, out.collect())) == [(5, 0, 1, 1), (5, 1, 1, 1), (5, 2, 0, 1), (6, 0, 0, 2), (6, 0, 3, 2), (6, 1, 3, 2)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window") == 0


def test_only_repeated_bases_are_told_apart(spark):
    from driftlens.plans import maps

    bases = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (1, 0, 0), (2, 5, 0), (3, 0, 0)], "base_id int, edit_pixels int, visible_edit_pixels int")
    bases = bases.selectExpr("*", "0 AS building_id", "'val' AS split", "1.0D AS comparable_fraction")
    cases = L.case_catalog(maps.repeats(bases), ("unchanged", "paint"), (("none", "none"),))
    by = ["state", "hypothesis", "hidden_edit"]
    got = maps.catalog_counts(cases, by)
    want = cases.groupBy(*by).agg(F.count("*").alias("cases"), F.countDistinct("case_id").alias("ids"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and {r.ids for r in got.collect()} == {1, 2, 3}
    assert cases.filter("repeated").select("base_id").distinct().collect()[0][0] == 1


def rgb_frame(spark, ref, src, support):
    rows = [(0, y, x, *map(int, ref[y, x]), *map(int, src[y, x]), bool(support[y, x])) for y in range(ref.shape[0]) for x in range(ref.shape[1])]
    return spark.createDataFrame(rows, "image int, y int, x int, r int, g int, b int, s_r int, s_g int, s_b int, support boolean")


CHANNELS = (("r", "g", "b"), ("s_r", "s_g", "s_b"))


def test_registry_refuses_unknowns(spark):
    frame = rgb_frame(spark, np.zeros((2, 2, 3), np.uint8), np.ones((2, 2, 3), np.uint8), np.ones((2, 2), bool))
    with pytest.raises(KeyError):
        V.score_pixels("nope", frame, "image", *CHANNELS)
    with pytest.raises(ValueError):
        V.score_pixels("ssim", frame, "image", *CHANNELS, radius=3)
    assert {round(r.score, 9) for r in V.score_pixels("rgb_difference", frame, "image", *CHANNELS).collect()} == {round(1 / 255, 9)}


def test_equal_images_have_zero_ssim_change(spark):
    ref = np.random.default_rng(3).integers(0, 256, (9, 9, 3), dtype=np.uint8)
    out = C.ssim_change(rgb_frame(spark, ref, ref, np.ones((9, 9), bool)), "image", *CHANNELS).collect()
    assert len(out) == 81 and all(r.score == 0 for r in out)


def test_segmentation_equal_buildings(spark):
    rows = [(1, "large", 0, 90, 0, 0), (2, "large", 0, 0, 0, 10), (3, "small", 0, 0, 0, 1), (4, None, 0, 5, 5, 0)]
    frame = spark.createDataFrame(rows, "image_id int, building_id string, channel int, tp long, fp long, fn long")
    out = {(r.scope, r.key): r.iou for r in S.segmentation_report(frame).collect()}
    assert out["primary", "all"] == pytest.approx(0.45)
    assert out["auxiliary_images", "all"] == pytest.approx(0.5)
    known = {(r.scope, r.key): r.iou for r in S.segmentation_report(frame.filter("building_id IS NOT NULL")).collect()}
    assert known["pooled_secondary", "all"] == pytest.approx(90 / 101)
    assert S.duplicate_images(frame.unionByName(frame.filter("image_id = 2"))).collect()[0].image_id == 2


def test_loss_is_tile_invariant(spark):
    rng = np.random.default_rng(8)
    rows = [(int(t), int(c), float(z), float(1 / (1 + np.exp(-z))), bool(rng.random() < 0.4)) for t in range(4) for c in range(3) for z in rng.normal(0, 20, 30)]
    frame = spark.createDataFrame(rows, "tile int, channel int, logit double, probability double, target boolean").withColumn("building_id", F.lit("A"))
    whole = S.loss_metrics(S.loss_sums(frame, ["building_id", "channel"]), ["building_id"]).first()
    tiles = S.loss_metrics(S.loss_sums(frame, ["building_id", "tile", "channel"]), ["building_id"]).first()
    assert whole.loss == pytest.approx(tiles.loss) and np.isfinite(whole.bce)


def test_tolerance_ignores_contour_jitter(spark):
    old, new = np.ones((6, 8), int), np.ones((6, 8), int)
    old[:, 4:], new[:, 5:] = 2, 2
    new[0, 0] = 4
    rows = [(0, y, x, int(old[y, x]), int(new[y, x]), True) for y in range(6) for x in range(8)]
    out = L.tolerant_labels(spark.createDataFrame(rows, "image int, y int, x int, old_bits int, new_bits int, support boolean"), "image", 1)
    got = {(r.y, r.x): r.label for r in out.collect()}
    assert all(got[y, 4] is None for y in range(6)) and got[0, 0] == 1 and got[5, 0] == 0


def test_groups_go_on_across_batches(spark):
    """Groups longer and shorter than a record batch, one with a NULL key, come whole and once."""
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 23), (3, 2), (None, 9), (5, 4)) for i in range(n)], "k int, i int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = C.sorted_groups(rows, ["k"], lambda g: {"n": [len(g["i"])], "total": [int(g["i"].sum())]}, "n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r.n, r.total) for r in out) == sorted((n, n * (n - 1) // 2) for n in (1, 23, 2, 9, 4))


def test_ssim_shuffles_colours_once(spark):
    """One exchange of colours by tile; weighted copies of moments are neither made nor aggregated."""
    ref = np.random.default_rng(1).integers(0, 256, (70, 70, 3))
    out = C.ssim_change(rgb_frame(spark, ref, ref, np.ones((70, 70), bool)), "image", *CHANNELS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    assert out.count() == 4900
