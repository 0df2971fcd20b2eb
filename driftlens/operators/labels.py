"""Ground truth from class bit-sets, temporal targets and change statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.metrics import ratio
from driftlens.operators import grid as G

# Review cutoffs in percent, inclusive (fixed values).
CUTOFFS = (0, 1, 5, 10, 15, 20, 30, 50)


def derived_label(old: Column, new: Column, support: Column) -> Column:
    """1 changed, 0 stable, NULL unknown; an empty bit-set is unknown, not healthy."""
    known = support & (old != 0) & (new != 0)
    return F.when(known, F.when(old != new, 1).otherwise(0))


def tolerant_labels(pixels: DataFrame, image, radius: int) -> DataFrame:
    """A change survives only outside the same-class dilation of the other date."""
    near = G.dilated_bits(pixels, image, ["old_bits", "new_bits"], radius)
    near = near.withColumnRenamed("old_bits", "_old_near").withColumnRenamed("new_bits", "_new_near")
    joined = pixels.join(near, [image, "y", "x"])
    old, new = F.col("old_bits"), F.col("new_bits")
    robust = (new.bitwiseAND(F.bitwise_not("_old_near")) != 0) | (old.bitwiseAND(F.bitwise_not("_new_near")) != 0)
    label = derived_label(old, new, F.col("support"))
    return joined.withColumn("label", F.when(label == 0, 0).when((label == 1) & robust, 1)).drop("_old_near", "_new_near")


def mode_labels(frames: DataFrame, sequence, mode: str) -> DataFrame:
    """Labels against the previous or the earliest frame of the same pixel.

    Windows span the dates of a single pixel. History scoring shares the
    step-event target of ``previous``.
    """
    w = Window.partitionBy(sequence, "y", "x").orderBy("frame")
    earlier = F.first("bits").over(w) if mode == "earliest" else F.lag("bits").over(w)
    target = "earliest_state" if mode == "earliest" else "step_event"
    staged = frames.withColumn("_before", earlier).withColumn("_n", F.row_number().over(w)).filter("_n > 1")
    return staged.withColumn("label", derived_label(F.col("_before"), F.col("bits"), F.lit(True))).withColumn(
        "target", F.lit(target)
    ).withColumn("mode", F.lit(mode)).drop("_before", "_n")


def pair_statistics(pixels: DataFrame, keys, channels: int, total: Column) -> DataFrame:
    """Known/changed/coverage with two denominators, and class rows (channel -1 = all)."""
    known = F.col("support") & F.col("label").isNotNull()
    aggs = [
        F.count_if("support").alias("support_pixels"),
        F.count_if(known).alias("_all_roi"), F.count_if(known & (F.col("label") == 1)).alias("_all_changed"),
        F.lit(0).cast("bigint").alias("_all_gain"), F.lit(0).cast("bigint").alias("_all_loss"),
    ]
    for c in range(channels):
        old, new = F.col("old_bits").bitwiseAND(F.lit(1 << c)) != 0, F.col("new_bits").bitwiseAND(F.lit(1 << c)) != 0
        aggs += [
            F.count_if(known & (old | new)).alias(f"_{c}_roi"), F.count_if(known & ~old & new).alias(f"_{c}_gain"),
            F.count_if(known & old & ~new).alias(f"_{c}_loss"),
        ]
    wide = pixels.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(-1).alias("channel"), *[F.col(f"_all_{n}").alias(n) for n in ("roi", "changed", "gain", "loss")])]
    rows += [
        F.struct(F.lit(c).alias("channel"), F.col(f"_{c}_roi").alias("roi"), (F.col(f"_{c}_gain") + F.col(f"_{c}_loss")).alias("changed"),
                 F.col(f"_{c}_gain").alias("gain"), F.col(f"_{c}_loss").alias("loss"))
        for c in range(channels)
    ]
    out = wide.select(*keys, "support_pixels", total.alias("total_pixels"), F.inline(F.array(*rows)))
    return out.withColumn("stable", F.col("roi") - F.col("changed")).select(
        "*", ratio(100.0 * F.col("changed"), F.col("roi")).alias("changed_known_percent"),
        ratio(100.0 * F.col("changed"), F.col("total_pixels")).alias("changed_crop_percent"),
        ratio(100.0 * F.col("roi"), F.col("total_pixels")).alias("coverage_percent"),
    )


def cutoff_sweep(statistics: DataFrame, building="building_id") -> DataFrame:
    """Pairs and distinct buildings that pass each inclusive cutoff, by integer comparison."""
    cut = F.explode(F.array(*[F.lit(c) for c in CUTOFFS]))
    kinds = F.explode(F.array(
        F.struct(F.lit("known").alias("denominator"), F.col("roi").alias("_den")),
        F.struct(F.lit("crop").alias("denominator"), F.col("total_pixels").alias("_den")),
    ))
    rows = statistics.select("*", kinds.alias("_k")).select("*", "_k.denominator", "_k._den").withColumn("cutoff", cut)
    passing = (F.col("roi") > 0) & (100 * F.col("changed") >= F.col("cutoff") * F.col("_den"))
    return rows.groupBy("channel", "denominator", "cutoff").agg(
        F.count_if(passing).alias("pairs"), F.countDistinct(F.when(passing, F.col(building))).alias("buildings")
    )


def change_summary(pixels: DataFrame, keys, channels: int) -> DataFrame:
    """Positive/negative/ignored counts, changed channels and why a pair is excluded."""
    changed_bits = F.bit_or(F.when(F.col("label") == 1, F.col("old_bits").bitwiseXOR(F.col("new_bits"))).otherwise(0))
    wide = pixels.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("positive_pixels"), F.count_if(F.col("label") == 0).alias("negative_pixels"),
        F.count_if(F.col("label").isNull()).alias("ignored_pixels"), F.count_if("support").alias("geometric_pixels"),
        changed_bits.alias("_bits"), (F.least(F.max("y") - F.min("y"), F.max("x") - F.min("x")) + 1).alias("_side"),
    )
    names = F.filter(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.when(F.getbit(F.col("_bits"), c) == 1, c.cast("string"))), lambda s: s.isNotNull())
    return wide.withColumn("changed_channels", F.concat_ws(",", names)).withColumn(
        "exclusion", F.when(F.col("geometric_pixels") == 0, "no_common_support").when(F.col("_side") < 8, "side_below_8")
    ).drop("_bits", "_side")


def task_labels(pixels: DataFrame) -> DataFrame:
    """Five tasks: H1 keeps pair labels, H0 is 0 on support and unknown elsewhere."""
    tasks = [("H1", "original"), ("H1", "exposure"), ("H1", "shadow"), ("H0", "exposure"), ("H0", "shadow")]
    rows = F.array(*[
        F.struct(F.lit(h).alias("hypothesis"), F.lit(c).alias("condition"),
                 (F.col("label") if h == "H1" else F.when(F.col("support"), 0)).alias("task_label")) for h, c in tasks
    ])
    return pixels.select("*", F.inline(rows))


def rank_views(frames: DataFrame, sequence, frame_counts: DataFrame) -> DataFrame:
    """Per pixel of a sequence: common support, change union and change count.

    Only pixels observed in every frame of the sequence are ranked.
    """
    labels = mode_labels(frames, sequence, "previous").groupBy(sequence, "y", "x").agg(
        F.count_if(F.col("label") == 1).alias("changes"), F.bool_or(F.col("label").isNotNull()).alias("known")
    )
    seen = frames.groupBy(sequence, "y", "x").agg(F.count("*").alias("_seen")).join(frame_counts, sequence)
    out = seen.join(labels, [sequence, "y", "x"], "left")
    common = F.col("_seen") == F.col("frame_count")
    return out.select(
        sequence, "y", "x", common.alias("common"), F.when(common, F.coalesce("changes", F.lit(0))).otherwise(0).alias("changes"),
        (common & F.coalesce("known", F.lit(False))).alias("known"),
    )


def rank_tiles(ranked: DataFrame, sequence, size, stride, side, min_support, min_known) -> DataFrame:
    """Tile candidates with their change counts and the reason for exclusion."""
    pixels = ranked.withColumn("width", F.lit(side)).withColumn("height", F.lit(side))
    area = size * size
    tiles = G.cover(pixels, size, stride).groupBy(sequence, "ty", "tx").agg(
        F.count_if("common").alias("common_pixels"), F.count_if("known").alias("known_pixels"),
        F.count_if(F.col("changes") > 0).alias("changed_pixels"), F.sum("changes").alias("change_observations"),
    )
    reason = (
        F.when(F.col("common_pixels") / area < min_support, "low_common_support")
        .when(F.col("known_pixels") < min_known, "too_few_known_pixels")
        .when(F.col("changed_pixels") == 0, "no_annotated_change")
    )
    return tiles.withColumn("reason", reason)


def case_catalog(bases: DataFrame, states, scenarios) -> DataFrame:
    """Bases x states x scenarios from fixed short lists; H0 without a planted edit. A column ``repeated`` of the bases is kept."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(i).alias("scenario_id"), F.lit(k).alias("nuisance_kind"))
        for s in states for i, k in scenarios
    ])
    cases = bases.select("*", F.inline(rows))
    edited = ~F.col("state").isin("unchanged", "self_paste")
    full = F.when(edited, F.col("edit_pixels")).otherwise(0)
    seen = F.when(edited, F.col("visible_edit_pixels")).otherwise(0)
    return cases.select(
        F.concat_ws("/", F.col("base_id").cast("string"), "state", "scenario_id").alias("case_id"), "base_id", "building_id", "split",
        "state", "scenario_id", "nuisance_kind", F.when(full > 0, "H1").otherwise("H0").alias("hypothesis"),
        (F.col("state") == "self_paste").alias("sham"), ((full > 0) & (seen == 0)).alias("hidden_edit"),
        ratio(seen, full).alias("retained_fraction"), "comparable_fraction", *[c for c in ("repeated",) if c in bases.columns],
    )


def case_problems(pixels: DataFrame, case: str) -> DataFrame:
    """Mask contract of a case, counted per violation kind."""
    c = F.col
    checks = F.array_compact(F.array(
        F.when(c("edit") & ~c("support"), "edit_outside_support"),
        F.when(c("comparable") != (c("support") & c("source_support") & c("visible")), "comparable_mismatch"),
        F.when(c("label").isNotNull() != c("comparable"), "label_support_mismatch"),
        F.when(c("visible_edit") != (c("edit") & c("comparable")), "visible_edit_mismatch"),
        F.when(c("comparable") & (c("label") != c("edit").cast("int")), "label_edit_mismatch"),
    ))
    return pixels.select(case, F.explode(checks).alias("problem")).groupBy("problem").agg(
        F.count("*").alias("pixels"), F.countDistinct(case).alias("cases")
    )


def view_coverage(images: DataFrame) -> DataFrame:
    """Available against usable years per view."""
    usable = F.when(F.col("temporal_eligible"), F.col("year"))
    return images.filter("view_id IS NOT NULL").groupBy("view_id").agg(
        F.countDistinct("year").alias("available_years"), F.countDistinct(usable).alias("usable_years"),
        F.count("*").alias("images"), F.count_if("temporal_eligible").alias("usable_images"),
    )


def candidate_problems(candidates: DataFrame, pairs: DataFrame, side: int) -> DataFrame:
    """Candidates against their pairs: identity, endpoints, boxes and saved counts."""
    box = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > side) | (F.col("y1") > side) | (F.col("x0") >= F.col("x1")) | (F.col("y0") >= F.col("y1"))
    joined = candidates.join(pairs.select("pair_id", F.col("reference_id").alias("_r"), F.col("source_id").alias("_s"), "saved_candidates"), "pair_id", "left")
    row_checks = F.array_compact(F.array(
        F.when(F.col("saved_candidates").isNull(), "unknown_pair"),
        F.when((F.col("_r") != F.col("reference_id")) | (F.col("_s") != F.col("source_id")), "endpoint_mismatch"),
        F.when(box, "invalid_box"),
    ))
    rows = joined.select(F.explode(row_checks).alias("problem"))
    twice = candidates.groupBy("candidate_id").count().filter("count > 1").select(F.lit("duplicate_candidate").alias("problem"))
    per_pair = candidates.groupBy("pair_id").agg(F.count("*").alias("_n"))
    wrong = pairs.join(per_pair, "pair_id", "left").filter(F.coalesce("_n", F.lit(0)) != F.col("saved_candidates"))
    wrong = wrong.select(F.lit("saved_count_mismatch").alias("problem"))
    return rows.unionByName(twice).unionByName(wrong).groupBy("problem").agg(F.count("*").alias("rows"))
