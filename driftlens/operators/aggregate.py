"""Metric aggregation: case -> building -> equal-weight mean, plus the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import metrics as M


def means(rows: DataFrame, keys, metrics, keep=()) -> DataFrame:
    return rows.groupBy(*keys).agg(*keep, *[F.avg(m).alias(m) for m in metrics])


def building_macro(rows: DataFrame, by, metrics, building="building_id") -> DataFrame:
    """Mean of defined case metrics per building, then of buildings, with counts."""
    level = means(rows, [*by, building], metrics, [F.count("*").alias("cases")])
    return level.groupBy(*by).agg(
        F.sum("cases").alias("cases"),
        F.count("*").alias("buildings"),
        *[F.avg(m).alias(m) for m in metrics],
        *[F.count(m).alias(f"{m}_buildings") for m in metrics],
    )


def sliced_macro(rows: DataFrame, by, dimensions, metrics, building="building_id") -> DataFrame:
    """The macro by ``by`` alone and by every single dimension, in one pass each level.

    Grouping sets are applied on per-building means, so the fact rows are
    expanded only inside the partial aggregate.
    """
    sets = [[*by, building]] + [[*by, building, d] for d in dimensions]
    columns = [*by, building, *dimensions]
    level = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in metrics]
    )
    # In the grouping id a 0 bit marks a dimension that is present.
    chosen = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        bit = 1 << (len(dimensions) - 1 - i)
        present = F.col("_set").bitwiseAND(F.lit(bit)) == 0
        chosen, value = F.when(present, F.lit(d)).otherwise(chosen), F.when(present, F.col(d).cast("string")).otherwise(value)
    level = level.withColumn("dimension", F.coalesce(chosen, F.lit("all"))).withColumn("value", F.coalesce(value, F.lit("all")))
    return level.groupBy(*by, "dimension", "value").agg(
        F.sum("cases").alias("cases"), F.count("*").alias("buildings"), *[F.avg(m).alias(m) for m in metrics]
    )


def subset_rows(rows: DataFrame) -> DataFrame:
    """Repeat each evaluable row in subset ``all`` and in ``positive`` or ``no_event``."""
    own = F.when(F.col("tp") + F.col("fn") > 0, "positive").otherwise("no_event")
    valid = sum((F.col(c) for c in M.COUNTS[1:]), F.col("tp")) > 0
    return rows.filter(valid).withColumn("subset", F.explode(F.array(F.lit("all"), own)))


def _pooled(rows, by, level):
    return rows.groupBy(*by, level).agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in M.COUNTS])


def pooled_macro(rows: DataFrame, by, level, metrics=M.METRICS) -> DataFrame:
    """Counts summed inside ``level``, metrics from the sums, then an equal mean."""
    plain = M.plain_metrics()
    level_rows = _pooled(rows, by, level).select("*", *[plain[m].alias(m) for m in metrics])
    return level_rows.groupBy(*by).agg(
        F.count("*").alias("units"), F.sum("pairs").alias("pairs"),
        *[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_units") for m in metrics],
    )


def frame_macro(rows: DataFrame, by, metrics=M.METRICS, building="building_id") -> DataFrame:
    """Frame metrics averaged inside a building, then over buildings."""
    out = building_macro(rows, by, metrics, building)
    for m in metrics:
        out = out.withColumnRenamed(f"{m}_buildings", f"{m}_units")
    return out.withColumnRenamed("cases", "pairs").withColumnRenamed("buildings", "units")


POSITIVE_ONLY = ("precision", "recall", "f1", "iou")


def guarded_macro(rows: DataFrame, by, metrics, building="building_id", spine=None) -> DataFrame:
    """P/R/F1/IoU from positive frames only, the rest from all; counts summed.

    ``spine`` keeps keys that have no evaluable row.
    """
    positive = F.col("tp") + F.col("fn") > 0
    gated = {m: F.when(positive, F.col(m)) if m in POSITIVE_ONLY else F.col(m) for m in metrics}
    level = rows.groupBy(*by, building).agg(
        F.count("*").alias("pairs"), F.count_if(positive).alias("positive_pairs"),
        *[F.sum(c).alias(c) for c in M.COUNTS], *[F.avg(gated[m]).alias(m) for m in metrics],
    )
    out = level.groupBy(*by).agg(
        F.count("*").alias("buildings"), F.sum("pairs").alias("pairs"), F.sum("positive_pairs").alias("positive_pairs"),
        *[F.sum(c).alias(c) for c in M.COUNTS],
        *[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_buildings") for m in metrics],
    )
    if spine is None:
        return out
    counted = ["buildings", "pairs", "positive_pairs", *M.COUNTS, *[f"{m}_buildings" for m in metrics]]
    return spine.join(out, list(by), "left").fillna(0, counted)


def exposure_macro(rows: DataFrame, by, metrics, building="building_id") -> DataFrame:
    """Each row counts in its split and in ``all_selected``, in its exposure and in ``all``.

    Exposures are numbered in their alphabetical order: a maximum of strings would
    have all repeated rows sorted, one of numbers is merged in a hash table.
    """
    expanded = rows.withColumn("split_scope", F.explode(F.array("split", F.lit("all_selected")))).withColumn(
        "training_scope", F.explode(F.array(F.lit("all"), "exposure"))
    )
    keys, kinds = [*by, "split_scope", "training_scope"], ("seen", "verified_unseen", "unknown")
    positive = F.col("tp") + F.col("fn") > 0
    gated = {m: F.when(positive, F.col(m)) if m in POSITIVE_ONLY else F.col(m) for m in metrics}
    level = expanded.groupBy(*keys, building).agg(
        F.count("*").alias("pairs"), F.max(F.array_position(F.array(*[F.lit(k) for k in sorted(kinds)]), F.col("exposure"))).alias("exposure"),
        *[F.avg(gated[m]).alias(m) for m in metrics],
    )
    return level.groupBy(*keys).agg(
        F.count("*").alias("buildings"), F.sum("pairs").alias("pairs"),
        *[F.count_if(F.col("exposure") == sorted(kinds).index(k) + 1).alias(f"{k}_buildings") for k in kinds],
        *[F.avg(m).alias(m) for m in metrics],
    )


def fusion_macro(rows: DataFrame, by, building="building_id", persistent_frame=3) -> DataFrame:
    """Event metrics, three false-alarm rates and pooled facade metrics in two levels.

    Conditional averages share one pass: a filtered mean is an average over a
    value that is NULL outside the filter.
    """
    zero = M.zero_metrics()
    tp, fp, fn, tn = (F.col(c) for c in M.COUNTS)
    fpr = M.ratio(fp, fp + tn)
    positive = (F.col("hypothesis") == "H1") & (tp + fn > 0)
    stable = (F.col("arm") == "event") & (tp + fn == 0)
    persistent = stable & (F.col("frame") == persistent_frame) & (F.col("target") == "step_event")
    event = F.col("arm") == "event"
    names = list(zero)
    level = rows.groupBy(*by, building).agg(
        *[F.avg(F.when(positive, zero[m])).alias(m) for m in names],
        F.avg(F.when(F.col("hypothesis") == "H0", fpr)).alias("h0_fpr"),
        F.avg(F.when(stable, fpr)).alias("no_event_fpr"),
        F.avg(F.when(persistent, fpr)).alias("persistent_fpr"),
        F.avg(M.ratio(tp + fp, tp + fp + fn + tn)).alias("marked_fraction"),
        F.count("*").alias("n_units"), F.count_if(positive).alias("n_positive"),
        F.count_if(F.col("hypothesis") == "H0").alias("n_h0"), F.count_if(stable).alias("n_no_event"),
        F.count_if(persistent).alias("n_persistent"), F.count_if(event).alias("_events"),
        *[F.sum(c).alias(c) for c in M.COUNTS],
        *[F.sum(F.when(event, F.col(c)).otherwise(0)).alias(f"_e_{c}") for c in M.COUNTS],
    )
    for m, column in zero.items():
        level = level.withColumn(f"all_{m}", column)
    level = level.select("*", F.struct(*[F.col(f"_e_{c}").alias(c) for c in M.COUNTS]).alias("_e"))
    etp, efp, efn = F.col("_e.tp"), F.col("_e.fp"), F.col("_e.fn")
    nil = lambda a, b: F.when(F.col("_events") > 0, F.coalesce(M.ratio(a, b), F.lit(0.0)))
    event_metrics = {
        "precision": nil(etp, etp + efp), "recall": nil(etp, etp + efn),
        "f1": nil(2 * etp, 2 * etp + efp + efn), "iou": nil(etp, etp + efp + efn),
    }
    for m, column in event_metrics.items():
        level = level.withColumn(f"event_{m}", column)
    averaged = [*names, *[f"all_{m}" for m in names], *[f"event_{m}" for m in names], "h0_fpr", "no_event_fpr", "persistent_fpr", "marked_fraction"]
    summed = ["n_units", "n_positive", "n_h0", "n_no_event", "n_persistent", *M.COUNTS]
    return level.groupBy(*by).agg(
        F.count("*").alias("n_buildings"), *[F.avg(a).alias(a) for a in averaged], *[F.sum(s).alias(s) for s in summed]
    )


def unit_table_problems(units: DataFrame, key) -> DataFrame:
    """Consistency of a saved unit table: counts, hypothesis, metric and uniqueness."""
    tp, fp, fn, tn = (F.col(c) for c in M.COUNTS)
    recall = M.ratio(tp, tp + fn)
    row_checks = F.array(
        F.when(tp + fp + fn + tn != F.col("evaluated"), "counts_do_not_add_up"),
        F.when((F.col("hypothesis") == "H0") & (tp + fn > 0), "h0_has_positives"),
        F.when(~recall.eqNullSafe(F.col("saved_recall")), "saved_metric_differs"),
    )
    rows = units.select(F.explode(F.array_compact(row_checks)).alias("problem"))
    duplicates = units.groupBy(key).count().filter("count > 1").select(F.lit("duplicate_unit").alias("problem"))
    return rows.unionByName(duplicates).groupBy("problem").agg(F.count("*").alias("rows"))


def multi_level(rows: DataFrame, base, extras, metrics) -> DataFrame:
    """Unit aggregates by the base keys and by each extra key in turn."""
    sets = [list(base)] + [[*base, e] for e in extras]
    columns = [*base, *extras]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("units"),
        *[F.avg(m).alias(m) for m in metrics], *[F.sum(c).alias(c) for c in M.COUNTS],
    )
    value, level = F.lit("all"), F.lit("all")
    for i, e in enumerate(extras):
        present = F.col("_set").bitwiseAND(F.lit(1 << (len(extras) - 1 - i))) == 0
        level, value = F.when(present, F.lit(e)).otherwise(level), F.when(present, F.col(e).cast("string")).otherwise(value)
    return out.withColumn("level", level).withColumn("value", value).drop("_set", *extras)


def paired_deltas(rows: DataFrame, keys, role, baseline, candidate, metrics) -> DataFrame:
    """Rows of two roles matched on the same key, with their differences.

    One shuffle on the key serves both sides: roles are folded by conditional
    aggregates instead of a self-join.
    """
    is_base, is_cand = F.col(role) == baseline, F.col(role) == candidate
    folded = rows.filter(is_base | is_cand).groupBy(*keys).agg(
        F.count_if(is_base).alias("_nb"), F.count_if(is_cand).alias("_nc"),
        *[F.max(F.when(is_base, F.col(m))).alias(f"{baseline}_{m}") for m in metrics],
        *[F.max(F.when(is_cand, F.col(m))).alias(f"{candidate}_{m}") for m in metrics],
    )
    matched = folded.filter((F.col("_nb") == 1) & (F.col("_nc") == 1)).drop("_nb", "_nc")
    for m in metrics:
        matched = matched.withColumn(f"delta_{m}", F.col(f"{candidate}_{m}") - F.col(f"{baseline}_{m}"))
    return matched


def coverage(expected: DataFrame, actual: DataFrame, key, by) -> DataFrame:
    """Expected, completed, failed and missing units, and how many reasons were given."""
    merged = expected.join(actual.select(key, "status", "reason", "evaluable"), key, "left")
    return merged.groupBy(*by).agg(
        F.count("*").alias("expected"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("missing"),
        F.count_if(F.coalesce(F.col("evaluable"), F.lit(False))).alias("evaluable"),
        F.countDistinct("reason").alias("reasons"),
    ).withColumn(
        "status",
        F.when(F.col("completed") == F.col("expected"), "complete").when(F.col("completed") > 0, "partial").otherwise("unavailable"),
    )


def coverage_reasons(expected: DataFrame, actual: DataFrame, key, by) -> DataFrame:
    """The reasons themselves as rows: error texts are not bounded, so they stay a table."""
    return expected.join(actual.filter("reason IS NOT NULL").select(key, "reason"), key).groupBy(*by, "reason").agg(F.count("*").alias("units"))


def method_status(units: DataFrame, by, statuses=("completed", "failed", "pending")) -> DataFrame:
    return units.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        F.sum("elapsed").alias("elapsed"), F.count_if("initialised").alias("initialised"),
    )


def cost_totals(units: DataFrame, by) -> DataFrame:
    return units.groupBy(*by).agg(
        F.sum("elapsed").alias("seconds"), F.sum("supported_bytes").alias("supported_bytes"),
        F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("computed"),
    )


def runtime_projection(measured: DataFrame, jobs: DataFrame, key="method") -> DataFrame:
    """Low and high hours of planned jobs from the fastest and slowest measured unit."""
    seen = measured.groupBy(key).agg(F.min("elapsed").alias("_lo"), F.max("elapsed").alias("_hi"))
    planned = jobs.groupBy(key).agg(F.count("*").alias("jobs"))
    return planned.join(seen, key, "left").select(
        key, "jobs", (F.col("jobs") * F.col("_lo") / 3600).alias("low_hours"),
        (F.col("jobs") * F.col("_hi") / 3600).alias("high_hours"), F.col("_lo").isNull().alias("unmeasured"),
    )


def parity_violations(recomputed: DataFrame, saved: DataFrame, keys, values) -> DataFrame:
    """Full outer comparison: keys on one side only, and values that differ."""
    a = recomputed.select(*keys, F.struct(*values).alias("_a"))
    b = saved.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    problem = (
        F.when(F.col("_b").isNull(), "not_saved").when(F.col("_a").isNull(), "not_recomputed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "value_differs")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*keys, "problem")


def class_slices(pixels: DataFrame, keys, channels: int, pred="pred") -> DataFrame:
    """Per class and direction: ROI = old or new has the class; other changes ignored.

    Classes are unfolded inside the partial aggregate as conditional counts, so
    the pixel table is shuffled once and never multiplied.
    """
    known = F.col("label").isNotNull() & F.col("support")
    stable = known & (F.col("label") == 0)
    changed = known & (F.col("label") == 1)
    pred = F.col(pred)
    aggs, structs = [], []
    for c in range(channels):
        bit = F.lit(1 << c)
        old, new = F.col("old_bits").bitwiseAND(bit) != 0, F.col("new_bits").bitwiseAND(bit) != 0
        negative = stable & (old | new)
        aggs += [F.count_if(negative & pred).alias(f"_{c}_fp"), F.count_if(negative & ~pred).alias(f"_{c}_tn")]
        moves = {"change": (old & ~new) | (~old & new), "gain": ~old & new, "loss": old & ~new}
        for direction, move in moves.items():
            positive = changed & move
            aggs += [F.count_if(positive & pred).alias(f"_{c}_{direction}_tp"), F.count_if(positive & ~pred).alias(f"_{c}_{direction}_fn")]
            structs.append(
                F.struct(
                    F.lit(c).alias("channel"), F.lit(direction).alias("direction"),
                    F.col(f"_{c}_{direction}_tp").alias("tp"), F.col(f"_{c}_fp").alias("fp"),
                    F.col(f"_{c}_{direction}_fn").alias("fn"), F.col(f"_{c}_tn").alias("tn"),
                )
            )
    return pixels.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*structs)))


def region_pixels(pixels: DataFrame, regions: DataFrame, keys, unit) -> DataFrame:
    """Repeat pixels per annotated region; units without a region table keep one."""
    joined = pixels.join(regions.select(*keys, "sky", "known_region"), list(keys), "left")
    known, sky = F.coalesce("known_region", F.lit(False)), F.coalesce("sky", F.lit(False))
    names = F.array_compact(
        F.array(
            F.lit("annotated_support"), F.when(known, "with_sky"), F.when(known & ~sky, "without_sky"), F.when(known & sky, "sky_only")
        )
    )
    return joined.withColumn("region", F.explode(names)).drop("sky", "known_region")
