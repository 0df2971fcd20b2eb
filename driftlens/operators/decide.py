"""Decisions on score tables, fusion on exactly matched support, fixed controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import metrics as M


def above(score: Column, threshold) -> Column:
    """Strict single-precision comparison; ties stay below the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return score.cast("float") > limit.cast("float")


def decide(score, threshold, native=None, is_native=None, support=None) -> Column:
    """A method's own mask where it has one, else the strict threshold; both inside support."""
    mask = above(score, threshold)
    if native is not None:
        mask = F.when(is_native, native).otherwise(mask)
    return mask & support if support is not None else mask


def unit_counts(pixels: DataFrame, keys, predictions: dict[str, Column], label="label", attributes=None) -> DataFrame:
    """Confusion of several predictors in one pass, one row per (unit, method).

    The wide partial aggregate shuffles once; methods become rows only after
    pixels have been reduced to units. ``attributes`` (keys, more) join before
    that, so a join sorts one row per unit.
    """
    label = F.col(label)
    aggs = [c for name, pred in predictions.items() for c in M.confusion(pred, label, f"{name}__")]
    wide = pixels.groupBy(*keys).agg(*aggs)
    fields = (*M.COUNTS, "ignored")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("method"), *[F.col(f"{name}__{f}").alias(f) for f in fields])
            for name in predictions
        ]
    )
    more = []
    if attributes is not None:
        more = [c for c in attributes.columns if c not in keys]
        wide = wide.join(attributes, list(keys))
    return wide.select(*keys, *more, F.inline(rows)).select(*keys, "method", *fields, *more)


def match_support(left: DataFrame, right: DataFrame, keys, payload) -> DataFrame:
    """Pixels both sides support; ``label_conflict`` flags disagreeing labels."""
    other = right.select(*keys, F.col("label").alias("_other_label"), *payload)
    joined = left.join(other, list(keys))
    return joined.withColumn("label_conflict", ~F.col("label").eqNullSafe(F.col("_other_label"))).drop("_other_label")


def support_conflicts(matched: DataFrame, by) -> DataFrame:
    """Matched pixels and label disagreements per group; any conflict refuses a comparison."""
    return matched.groupBy(*by).agg(
        F.count("*").alias("matched_pixels"), F.count_if("label_conflict").alias("label_conflicts")
    )


def fuse(left: DataFrame, right: DataFrame, keys, operation: str) -> DataFrame:
    """AND / OR of two masks on identical unit, pixel and label."""
    joined = match_support(left, right.withColumnRenamed("mask", "_right_mask"), keys, ["_right_mask"])
    both = F.col("mask") & F.col("_right_mask") if operation == "AND" else F.col("mask") | F.col("_right_mask")
    return joined.filter(~F.col("label_conflict")).withColumn("mask", both).drop("_right_mask", "label_conflict")


def gated_roles(previous: DataFrame, history: DataFrame, keys, threshold) -> DataFrame:
    """A mask and the same mask gated by a history score, both on the shared support."""
    joined = match_support(previous, history, keys, ["history_score"]).filter(~F.col("label_conflict"))
    gate = F.col("mask") & above(F.col("history_score"), threshold)
    roles = F.array(
        F.struct(F.lit("baseline").alias("role"), F.col("mask").alias("role_mask")),
        F.struct(F.lit("candidate").alias("role"), gate.alias("role_mask")),
    )
    return joined.select(*keys, "label", F.inline(roles))


def control_counts(units: DataFrame) -> DataFrame:
    """Always-positive and always-negative rows derived from per-unit label counts."""
    p, n, zero = F.col("positives"), F.col("negatives"), F.lit(0).cast("bigint")
    rows = F.array(
        F.struct(F.lit("always_positive").alias("control"), p.alias("tp"), n.alias("fp"), zero.alias("fn"), zero.alias("tn")),
        F.struct(F.lit("always_negative").alias("control"), zero.alias("tp"), zero.alias("fp"), p.alias("fn"), n.alias("tn")),
    )
    return units.select("*", F.inline(rows)).drop("positives", "negatives")


def recipes(thresholds: DataFrame, predictors: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """One row per emitted prediction: components, frozen thresholds and operation.

    ``predictors`` maps a name to (component methods, operation); the number of
    components is fixed by the caller, so the list stays small.
    """
    members = F.array(
        *[
            F.struct(F.lit(name).alias("predictor"), F.lit(operation).alias("operation"), F.lit(part).alias("part"), F.lit(m).alias("method"))
            for name, (parts, operation) in predictors.items()
            for part, m in enumerate(parts)
        ]
    )
    spine = thresholds.sparkSession.range(1).select(F.inline(members))
    listed = F.array_sort(F.collect_list(F.struct("part", "method", "threshold")))
    return (
        thresholds.join(F.broadcast(spine), "method")
        .groupBy("predictor", "operation", "fpr_target")
        .agg(listed.alias("parts"))
        .select(
            "predictor", "operation", "fpr_target",
            F.concat_ws("+", F.transform("parts", lambda p: p["method"])).alias("components"),
            F.concat_ws(";", F.transform("parts", lambda p: F.round(p["threshold"], 6).cast("string"))).alias("thresholds"),
        )
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
