"""Multi-label segmentation metrics: pool inside a building, then equal buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import metrics as M
from driftlens.operators.grid import boundary
from driftlens.operators.ranks import exact_quantiles

CLASS_METRICS = ("iou", "f1", "recall", "precision")


def _bit(column, c):
    return F.col(column).bitwiseAND(F.lit(1 << c)) != 0


def multilabel_counts(pixels: DataFrame, keys, channels: int, pred="pred_bits", target="target_bits", valid="valid") -> DataFrame:
    """TP/FP/FN per class on valid pixels; classes become rows after the aggregate."""
    v = F.col(valid)
    aggs, rows = [], []
    for c in range(channels):
        p, t = _bit(pred, c), _bit(target, c)
        aggs += [F.count_if(v & p & t).alias(f"_{c}tp"), F.count_if(v & p & ~t).alias(f"_{c}fp"), F.count_if(v & ~p & t).alias(f"_{c}fn")]
        rows.append(F.struct(F.lit(c).alias("channel"), *[F.col(f"_{c}{n}").alias(n) for n in ("tp", "fp", "fn")]))
    return pixels.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def group_counts(pixels: DataFrame, keys, groups: dict[str, int], pred="pred_bits", target="target_bits", valid="valid") -> DataFrame:
    """Confusion of class groups given as bit masks: members are OR-ed per pixel first."""
    v = F.col(valid)
    aggs, rows = [], []
    for i, (name, mask) in enumerate(groups.items()):
        p, t = F.col(pred).bitwiseAND(F.lit(mask)) != 0, F.col(target).bitwiseAND(F.lit(mask)) != 0
        aggs += [F.count_if(v & p & t).alias(f"_{i}tp"), F.count_if(v & p & ~t).alias(f"_{i}fp"), F.count_if(v & ~p & t).alias(f"_{i}fn")]
        rows.append(F.struct(F.lit(name).alias("class_group"), *[F.col(f"_{i}{n}").alias(n) for n in ("tp", "fp", "fn")]))
    return pixels.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def loss_sums(values: DataFrame, keys, logit="logit", probability="probability", target="target") -> DataFrame:
    """Additive BCE and soft-Dice sums; stable BCE from logits. Merge by plain sums."""
    z, p, t = F.col(logit), F.col(probability), F.col(target).cast("double")
    softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return values.groupBy(*keys).agg(
        F.sum(softplus - z * t).alias("bce_sum"), F.sum(p).alias("probability_sum"), F.sum(t).alias("target_sum"),
        F.sum(p * t).alias("intersection"), F.count("*").alias("valid_pixels"),
    )


def loss_metrics(sums: DataFrame, keys) -> DataFrame:
    """0.5 BCE + 0.5 Dice over the classes present, from per-class sums."""
    merged = sums.groupBy(*keys, "channel").agg(
        *[F.sum(c).alias(c) for c in ("bce_sum", "probability_sum", "target_sum", "intersection", "valid_pixels")]
    )
    dice = 1 - (2 * F.col("intersection") + 1e-6) / (F.col("probability_sum") + F.col("target_sum") + 1e-6)
    out = merged.groupBy(*keys).agg(
        F.avg(F.col("bce_sum") / F.col("valid_pixels")).alias("bce"),
        F.coalesce(F.avg(F.when(F.col("target_sum") > 0, dice)), F.lit(0.0)).alias("dice"),
    )
    return out.withColumn("loss", 0.5 * F.col("bce") + 0.5 * F.col("dice"))


def class_metric_columns():
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {
        "iou": M.ratio(tp, tp + fp + fn), "f1": M.ratio(2 * tp, 2 * tp + fp + fn),
        "recall": M.ratio(tp, tp + fn), "precision": M.ratio(tp, tp + fp),
    }


def pooled_classes(counts: DataFrame, keys) -> DataFrame:
    """Counts summed per key, then class metrics."""
    pooled = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return pooled.select("*", *[c.alias(m) for m, c in class_metric_columns().items()])


def segmentation_report(counts: DataFrame, building="building_id", image="image_id") -> DataFrame:
    """Primary, per-class, per-building, pooled and auxiliary rows in one table.

    ``counts`` is (image, building or NULL, channel, tp, fp, fn). Images of an
    unknown building never join the building mean; they are averaged apart.
    """
    known, unknown = counts.filter(F.col(building).isNotNull()), counts.filter(F.col(building).isNull())
    cells = pooled_classes(known, [building, "channel"])
    means = [F.avg(m).alias(m) for m in CLASS_METRICS]
    eligible = [F.count(m).alias(f"eligible_{m}") for m in CLASS_METRICS]
    per_building = cells.groupBy(building).agg(*means, *eligible)
    shape = lambda df, scope, key: df.select(
        F.lit(scope).alias("scope"), key.cast("string").alias("key"), *CLASS_METRICS, *[f"eligible_{m}" for m in CLASS_METRICS]
    )
    everything = F.lit("all")
    pooled = pooled_classes(counts, ["channel"])
    auxiliary = pooled_classes(unknown, [image, "channel"]).groupBy(image).agg(*means)
    parts = [
        shape(per_building.agg(*means, *eligible), "primary", everything),
        shape(cells.groupBy("channel").agg(*means, *eligible), "per_class", F.col("channel")),
        shape(per_building, "per_building", F.col(building)),
        shape(pooled.agg(*means, *eligible), "pooled_secondary", everything),
        shape(auxiliary.agg(*means, *eligible), "auxiliary_images", everything),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_images(counts: DataFrame, image="image_id") -> DataFrame:
    """Images recorded more than once for one class; a report with any is refused."""
    return counts.groupBy(image, "channel").count().filter("count > 1").select(image).distinct()


def condition_delta(report: DataFrame, condition, baseline, keys, metrics) -> DataFrame:
    """Metric differences of every condition against its paired reference."""
    base = report.filter(F.col("condition") == baseline).select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    current = report.filter(F.col("condition").isin(condition))
    return current.join(base, list(keys)).select("condition", *keys, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics])


def feature_profile(pixels: DataFrame, image, features: dict, by=(), a="a", b="b") -> DataFrame:
    """Statistics of ten pixel groups split by baseline ``a``, gate ``b`` and truth.

    ``features`` maps a column to the function that buckets its value, so exact
    quantiles never gather a whole group.
    """
    edge = boundary(pixels, image).select(image, "y", "x", F.lit(True).alias("_edge"))
    marked = pixels.join(edge, [image, "y", "x"], "left").withColumn("_edge", F.coalesce("_edge", F.lit(False)))
    pos, neg, a, b = F.col("label") == 1, F.col("label") == 0, F.col(a), F.col(b)
    groups = {
        "kept_tp": pos & a & b, "rejected_tp": pos & a & ~b, "removed_fp": neg & a & ~b, "retained_fp": neg & a & b,
        "gate_only_tp": pos & ~a & b, "missed_by_both": pos & ~a & ~b,
        "rejected_tp_boundary": pos & a & ~b & F.col("_edge"), "rejected_tp_other": pos & a & ~b & ~F.col("_edge"),
        "kept_tp_boundary": pos & a & b & F.col("_edge"), "kept_tp_other": pos & a & b & ~F.col("_edge"),
    }
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in groups.items()]))
    long = marked.withColumn("pixel_group", F.explode(names)).withColumn("_f", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), bucket(F.col(f)).alias("bucket")) for f, bucket in features.items()
    ]))).select(*by, "pixel_group", "_f.feature", "_f.value", "_f.bucket")
    keys = [*by, "pixel_group", "feature"]
    base = long.groupBy(*keys).agg(
        F.count("value").alias("pixels"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    spots = exact_quantiles(long, keys, "value", [0.1, 0.5, 0.9], F.col("bucket"), carry=["bucket"])
    wide = spots.groupBy(*keys).agg(*[
        F.max(F.when(F.col("fraction") == f, F.col("quantile"))).alias(n) for f, n in (("0.1", "p10"), ("0.5", "p50"), ("0.9", "p90"))
    ])
    return base.join(wide, keys, "left")


def slice_macro(slices: DataFrame, by, building="building_id") -> DataFrame:
    """Class slices summed per building, metrics there, then equal buildings."""
    level = slices.groupBy(*by, building).agg(*[F.sum(c).alias(c) for c in M.COUNTS])
    plain = M.plain_metrics()
    names = ("precision", "recall", "f1", "fpr")
    level = level.select("*", *[plain[m].alias(m) for m in names])
    return level.groupBy(*by).agg(F.count("*").alias("buildings"), *[F.sum(c).alias(c) for c in M.COUNTS], *[F.avg(m).alias(m) for m in names])
