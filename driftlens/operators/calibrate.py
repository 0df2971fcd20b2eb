"""Thresholds under false-positive budgets, ranking curves and their lookup.

Pixels are reduced to counts per distinct score before anything else. Metrics
that are linear in counts (recall, FPR) become running sums of weights, so no
threshold grid is ever multiplied with pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.ranks import running_totals, score_bucket
from driftlens.session import cut_lineage

# The linear grid has 101 points; the extension is geometric.
LINEAR_POINTS, GEOMETRIC_POINTS, FLOAT32_TINY, GEOMETRIC_TOP = 101, 769, 1.1754943508222875e-38, 0.5
TOLERANCE = 1e-12


def linear_threshold(i: Column) -> Column:
    return (i / (LINEAR_POINTS - 1)).cast("float")


def linear_bucket(score: Column) -> Column:
    """Number of linear thresholds below a score, by strict float32 comparison."""
    s = score.cast("float")
    guess = F.greatest(F.lit(0), F.least(F.lit(LINEAR_POINTS), F.ceil(s * (LINEAR_POINTS - 1)))).cast("int")
    up = (guess < LINEAR_POINTS) & (s > linear_threshold(guess))
    down = (guess > 0) & (s <= linear_threshold(guess - 1))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def geometric_threshold(i: Column) -> Column:
    steps = GEOMETRIC_POINTS - 1
    return (F.exp(F.log(F.lit(FLOAT32_TINY)) + (F.log(F.lit(GEOMETRIC_TOP)) - F.log(F.lit(FLOAT32_TINY))) * i / steps)).cast("float")


def count_curves(pixels: DataFrame, keys, score: Column, label="label") -> DataFrame:
    """tp/fp/fn/tn at each of the 101 thresholds per key.

    A key holds at most 102 bucket counts, so its curve is computed on a small
    array; nothing is shuffled per threshold.
    """
    hist = histogram_arrays(pixels, keys, score, label)
    above = lambda field, i: F.aggregate(F.filter("_h", lambda h: h["k"] > i), F.lit(0).cast("bigint"), lambda a, h: a + h[field])
    curves = hist.withColumn("threshold_index", F.explode(F.sequence(F.lit(0), F.lit(LINEAR_POINTS - 1))))
    i = F.col("threshold_index")
    counted = curves.select(*keys, "threshold_index", "_p", "_n", above("p", i).alias("tp"), above("n", i).alias("fp"))
    return counted.select(*keys, "threshold_index", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def histogram_arrays(pixels: DataFrame, keys, score: Column, label="label") -> DataFrame:
    known = pixels.filter(F.col(label).isNotNull())
    buckets = known.groupBy(*keys, linear_bucket(score).alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_cp"), F.count_if(F.col(label) == 0).alias("_cn")
    )
    return buckets.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_cp").alias("p"), F.col("_cn").alias("n"))).alias("_h"),
        F.sum("_cp").alias("_p"), F.sum("_cn").alias("_n"),
    )


def geometric_bucket(score: Column) -> Column:
    """Number of geometric thresholds below a score."""
    s = score.cast("float")
    span = F.log(F.lit(GEOMETRIC_TOP)) - F.log(F.lit(FLOAT32_TINY))
    place = (GEOMETRIC_POINTS - 1) * (F.log(s.cast("double")) - F.log(F.lit(FLOAT32_TINY))) / span
    guess = F.greatest(F.lit(0), F.least(F.lit(GEOMETRIC_POINTS), F.ceil(place))).cast("int")
    up = (guess < GEOMETRIC_POINTS) & (s > geometric_threshold(guess))
    down = (guess > 0) & (s <= geometric_threshold(guess - 1))
    return F.when(s <= 0, 0).when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def grid_counts(pixels: DataFrame, keys, score: Column, label="label", extended=False) -> DataFrame:
    """Pooled counts above every distinct threshold of the (extended) grid.

    Both grids have closed-form buckets, so a key is reduced to at most 102 or
    770 counts before any threshold is looked at.
    """
    known = pixels.filter(F.col(label).isNotNull())
    grids = [(linear_bucket, linear_threshold, LINEAR_POINTS)] + ([(geometric_bucket, geometric_threshold, GEOMETRIC_POINTS)] if extended else [])
    linear = F.transform(F.sequence(F.lit(0), F.lit(LINEAR_POINTS - 1)), linear_threshold)
    above = lambda field: F.aggregate(F.filter("_h", lambda h: h["_k"] > F.col("_i")), F.lit(0).cast("bigint"), lambda a, h: a + h[field])
    out = None
    for bucket, threshold, points in grids:
        hist = known.groupBy(*keys, bucket(score).alias("_k")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
        arrays = hist.groupBy(*keys).agg(F.collect_list(F.struct("_k", "_p", "_n")).alias("_h"))
        rows = arrays.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("threshold", threshold(F.col("_i")))
        if out is not None:
            rows = rows.filter(~F.array_contains(linear, F.col("threshold")))
        part = rows.select(*keys, "threshold", above("_p").alias("tp"), above("_n").alias("fp"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate_f1(pixels: DataFrame, units: DataFrame, keys, score: Column, unit="unit_id", building="building_id") -> DataFrame:
    """Best building-macro F1 of visible H1, then least H0 FPR, then highest threshold.

    ``units`` carries the calibration units only (VAL, not sham).
    """
    keys = list(keys)
    rows = pixels.join(units.select(unit, building), unit)
    hist = histogram_arrays(rows, [*keys, unit, building], score)
    # A unit's curve only changes at its own buckets, so a unit contributes
    # differences there instead of one row per threshold.
    breaks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(F.transform("_h", lambda h: h["k"]), lambda k: k < LINEAR_POINTS))))
    above = lambda field, i: F.aggregate(F.filter("_h", lambda h: h["k"] > i), F.lit(0).cast("bigint"), lambda acc, h: acc + h[field])
    points = F.transform(breaks, lambda i: F.struct(i.alias("i"), above("p", i).alias("tp"), above("n", i).alias("fp")))
    value = F.transform("_points", lambda q: F.when(F.col("_p") > 0, 2 * q["tp"] / (q["tp"] + q["fp"] + F.col("_p"))).otherwise(q["fp"] / F.col("_n")))
    units_of = hist.withColumn("_points", points).withColumn("_value", value)
    moves = F.transform("_points", lambda q, j: F.struct(
        q["i"].alias("threshold_index"), (F.element_at("_value", j + 1) - F.when(j > 0, F.get("_value", j - 1)).otherwise(0.0)).alias("_d")))
    steps = units_of.select(*keys, building, (F.col("_p") > 0).alias("_h1"), F.inline(moves))
    first = F.col("threshold_index") == 0
    level = steps.groupBy(*keys, building, "threshold_index").agg(
        F.sum(F.when(F.col("_h1"), F.col("_d"))).alias("_df"), F.sum(F.when(~F.col("_h1"), F.col("_d"))).alias("_da"),
        F.count_if(F.col("_h1") & first).alias("_n1"), F.count_if(~F.col("_h1") & first).alias("_n0"),
    )
    spine = level.select(*keys, building).distinct().withColumn("threshold_index", F.explode(F.sequence(F.lit(0), F.lit(LINEAR_POINTS - 1))))
    run = Window.partitionBy(*keys, building).orderBy("threshold_index").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(run)
    level = spine.join(level, [*keys, building, "threshold_index"], "left").select(
        *keys, building, "threshold_index", F.when(total("_n1") > 0, total("_df") / total("_n1")).alias("_f1"), F.when(total("_n0") > 0, total("_da") / total("_n0")).alias("_fpr")
    )
    curve = level.groupBy(*keys, "threshold_index").agg(
        F.avg("_f1").alias("f1"), F.avg("_fpr").alias("fpr"), F.count("_f1").alias("h1_buildings"), F.count("_fpr").alias("h0_buildings")
    )
    # 101 rows per key from here on.
    key_window = Window.partitionBy(*keys)
    tied = curve.withColumn("_best", F.max("f1").over(key_window)).filter(F.col("f1") >= F.col("_best") - TOLERANCE)
    tied = tied.withColumn("_low", F.min("fpr").over(key_window)).filter(F.col("fpr") <= F.col("_low") + TOLERANCE)
    return tied.groupBy(*keys).agg(F.max_by(F.struct("threshold_index", "f1", "fpr", "h1_buildings", "h0_buildings"), "threshold_index").alias("_c")).select(
        *keys, "_c.*", linear_threshold(F.col("_c.threshold_index")).cast("double").alias("threshold")
    )


def weighted_scores(pixels: DataFrame, units: DataFrame, keys, score: Column, unit="unit_id", building="building_id") -> DataFrame:
    """Per distinct score: recall and FPR weight under equal units and buildings.

    A positive pixel of an H1 unit weighs 1 / (positives of the unit x H1 units
    of its building x buildings with H1); likewise for negatives of H0 units.
    """
    keys = list(keys)
    rows = pixels.join(units.select(unit, building), unit).filter(F.col("label").isNotNull())
    hist = rows.groupBy(*keys, building, unit, score.cast("float").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n")
    )
    per_unit = hist.groupBy(*keys, building, unit).agg(F.sum("_p").alias("_up"), F.sum("_n").alias("_un"))
    h1, h0 = F.col("_up") > 0, (F.col("_up") == 0) & (F.col("_un") > 0)
    per_building = per_unit.groupBy(*keys, building).agg(F.count_if(h1).alias("_u1"), F.count_if(h0).alias("_u0"))
    total = per_building.groupBy(*keys).agg(F.count_if(F.col("_u1") > 0).alias("_b1"), F.count_if(F.col("_u0") > 0).alias("_b0"))
    weighted = per_unit.join(per_building, [*keys, building]).join(total, keys).select(
        *keys, unit, F.when(h1, 1 / (F.col("_up") * F.col("_u1") * F.col("_b1"))).otherwise(0.0).alias("_wr"),
        F.when(h0, 1 / (F.col("_un") * F.col("_u0") * F.col("_b0"))).otherwise(0.0).alias("_wf"),
    )
    joined = hist.join(weighted, [*keys, unit])
    # One row per distinct score from here on; curves read it more than once.
    return cut_lineage(joined.groupBy(*keys, "score").agg(
        F.sum(F.col("_p") * F.col("_wr")).alias("recall_mass"), F.sum(F.col("_n") * F.col("_wf")).alias("fpr_mass"),
        F.sum(F.when(F.col("_wf") > 0, F.col("_n")).otherwise(0)).alias("h0_pixels"),
    ))


def rate_curve(scores: DataFrame, keys) -> DataFrame:
    """Recall and FPR strictly above every distinct score."""
    ranked = running_totals(scores, keys, score_bucket(F.col("score")), ["score"], ["recall_mass", "fpr_mass"])
    return ranked.select(
        *keys, "score", "h0_pixels", (F.col("all_recall_mass") - F.col("cum_recall_mass")).alias("recall"), (F.col("all_fpr_mass") - F.col("cum_fpr_mass")).alias("fpr"),
    )


def _with_budgets(curve: DataFrame, budgets) -> DataFrame:
    return curve.withColumn("fpr_target", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).filter(F.col("fpr") <= F.col("fpr_target") + TOLERANCE)


def calibrate_recall(scores: DataFrame, keys, budgets=(0.01, 0.05), minimum=0.0) -> DataFrame:
    """Highest recall under each FPR budget; ties take lower FPR, then higher threshold."""
    keys = list(keys)
    floor_rows = scores.groupBy(*keys).agg(F.max("score").alias("_any")).select(
        *keys, F.lit(minimum).cast("float").alias("score"), F.lit(0.0).alias("recall_mass"), F.lit(0.0).alias("fpr_mass"), F.lit(0).cast("bigint").alias("h0_pixels")
    )
    merged = scores.unionByName(floor_rows).groupBy(*keys, "score").agg(*[F.sum(c).alias(c) for c in ("recall_mass", "fpr_mass", "h0_pixels")])
    # Scores below the minimum never lie above a candidate threshold.
    curve = rate_curve(merged.filter(F.col("score") >= F.lit(minimum).cast("float")), keys)
    chosen = _with_budgets(curve, budgets)
    order = F.struct(F.round("recall", 12), -F.round("fpr", 12), F.col("score"))
    return chosen.groupBy(*keys, "fpr_target").agg(F.max_by(F.struct("score", "recall", "fpr"), order).alias("_c")).select(
        *keys, "fpr_target", F.col("_c.score").cast("double").alias("threshold"), "_c.recall", "_c.fpr"
    )


def calibrate_lowest(scores: DataFrame, keys, budgets=(0.01, 0.05)) -> DataFrame:
    """Lowest H0 score whose building-macro FPR fits the budget."""
    keys = list(keys)
    curve = rate_curve(scores.filter("h0_pixels > 0"), keys)
    chosen = _with_budgets(curve, budgets)
    return chosen.groupBy(*keys, "fpr_target").agg(F.min_by(F.struct("score", "fpr"), "score").alias("_c")).select(
        *keys, "fpr_target", F.col("_c.score").cast("double").alias("threshold"), "_c.fpr"
    )


def _first_reaching(queries: DataFrame, curve: DataFrame, keys, total: DataFrame) -> DataFrame:
    """Adds ``_at``: the first (score, _c) of the rising ``curve`` with _c >= ``_x``.

    Both sides are dealt by parts of the curve's range, so one merge per part
    answers its queries; what a part cannot answer starts a later part.
    """
    keys = list(keys)
    part = lambda v: F.greatest(F.lit(0), F.least(F.lit(1024), F.floor(v * 1024 / F.col("_buildings")))).cast("int")
    point = F.struct("score", "_c")
    placed = curve.join(total, keys).select(*keys, part(F.col("_c")).alias("_b"), F.col("_c").alias("_v"), F.lit(1).alias("_o"), point.alias("_g"))
    asked = queries.withColumn("_b", part(F.col("_x"))).withColumn("_v", F.col("_x")).withColumn("_o", F.lit(0))
    onward = Window.partitionBy(*keys, "_b").orderBy("_v", "_o").rowsBetween(0, Window.unboundedFollowing)
    merged = asked.unionByName(placed, allowMissingColumns=True).withColumn("_here", F.first("_g", ignorenulls=True).over(onward)).filter("_o = 0")
    starts = placed.groupBy(*keys, "_b").agg(F.min("_g").alias("_s"))
    spine = total.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(1024))).alias("_b")).join(starts, [*keys, "_b"], "left")
    # At most 1,025 parts per key.
    later = spine.withColumn("_later", F.min("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing))).select(*keys, "_b", "_later")
    return merged.join(later, [*keys, "_b"], "left").withColumn("_at", F.coalesce("_here", "_later")).drop("_b", "_v", "_o", "_g", "_here", "_later")


def lofo_thresholds(negatives: DataFrame, keys, budgets=(0.01, 0.05), building="building_id", unit="unit_id", heldout=None) -> DataFrame:
    """Leave-one-building-out thresholds in work linear in (building, score) rows.

    ``negatives`` is (keys, building, unit, score) of known negatives. A
    building's curve gives equal weight to its units; a fold's curve is the sum
    of all curves without its own. Between a fold's own scores its own share is
    constant, so the fold finds the stretch where it crosses a budget on its own
    rows and needs one look-up of the common curve there.
    ``heldout`` may list (keys, building) that have no negatives of their own.
    """
    keys = list(keys)
    # Scores of one unit seldom repeat, so a table of them per unit would hold about every row.
    rows = negatives.select(*keys, building, unit, F.col("score").cast("float").alias("score"))
    per_unit = cut_lineage(rows.groupBy(*keys, building, unit).agg(F.count("*").alias("_un")))
    per_building = per_unit.groupBy(*keys, building).agg(F.count("*").alias("_units"))
    weight = per_unit.join(per_building, [*keys, building]).select(*keys, building, unit, (1 / (F.col("_un") * F.col("_units"))).alias("_w"))
    mass = rows.join(weight, [*keys, building, unit]).groupBy(*keys, building, "score").agg(F.sum("_w").alias("_m"))
    mass = cut_lineage(mass)
    together = mass.groupBy(*keys, "score").agg(F.sum("_m").alias("_m"), F.count("*").alias("_holders"))
    curve = cut_lineage(running_totals(together, keys, score_bucket(F.col("score")), ["score"], ["_m"]).select(*keys, "score", "_holders", F.col("cum__m").alias("_c")))
    own = running_totals(mass, [*keys, building], score_bucket(F.col("score")), ["score"], ["_m"]).select(*keys, building, "score", F.col("cum__m").alias("_own"))
    total = per_building.groupBy(*keys).agg(F.count("*").alias("_buildings"))
    folds = per_building.select(*keys, building, F.lit(1).alias("_has"))
    if heldout is not None:
        folds = folds.unionByName(heldout.select(*keys, building).distinct().join(folds, [*keys, building], "left_anti").withColumn("_has", F.lit(0)))
    goals = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    folds = folds.join(total, keys).withColumn("_train", F.col("_buildings") - F.col("_has")).withColumn("goal", goals)
    folds = folds.withColumn("_need", (1 - F.col("goal") - TOLERANCE) * F.col("_train"))
    steps = own.join(curve, [*keys, "score"]).withColumn("_d", F.col("_c") - F.col("_own"))
    crossed = steps.join(folds.select(*keys, building, "goal", "_need"), [*keys, building]).groupBy(*keys, building, "goal").agg(
        F.max(F.when(F.col("_d") < F.col("_need"), F.col("_own"))).alias("_base"), F.min(F.when(F.col("_d") >= F.col("_need"), F.struct("score", "_d", "_holders"))).alias("_next")
    )
    queries = folds.join(crossed, [*keys, building, "goal"], "left").withColumn("_base", F.coalesce("_base", F.lit(0.0))).withColumn("_x", F.col("_need") + F.col("_base"))
    found = _first_reaching(queries, curve, keys, total)
    # The crossing lies at an own score only where another building has it too.
    shared = F.coalesce((F.col("_next.score") <= F.col("_at.score")) & (F.col("_next._holders") > 1), F.lit(False))
    score = F.when(shared, F.col("_next.score")).otherwise(F.col("_at.score"))
    rate = 1 - F.when(shared, F.col("_next._d")).otherwise(F.col("_at._c") - F.col("_base")) / F.col("_train")
    usable = (F.col("_train") > 0) & score.isNotNull()
    return found.select(
        *keys, building, "goal", F.col("_train").cast("long").alias("train_buildings"), F.when(usable, score).cast("double").alias("threshold"),
        F.when(usable, F.greatest(F.lit(0.0), rate)).alias("achieved_fpr"), F.when(usable, "calibrated").otherwise("unsupported").alias("status"),
    )


def threshold_lookup(wanted: DataFrame, thresholds: DataFrame, training: DataFrame, keys, building="building_id") -> DataFrame:
    """Exactly one frozen threshold per key; a held-out building must not have trained it."""
    keys = list(keys)
    frozen = thresholds.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("threshold").alias("threshold"))
    leaks = training.select(*keys, F.col("train_building").alias(building), F.lit(True).alias("_leak")).distinct()
    joined = wanted.join(frozen, keys, "left").join(leaks, [*keys, building], "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("_leak"), "trained_on_heldout").otherwise("ok")
    return joined.withColumn("status", status).withColumn("threshold", F.when(F.col("status") == "ok", F.col("threshold"))).drop("_n", "_leak")


def precision_recall(pixels: DataFrame, keys, score: Column) -> DataFrame:
    """Precision and recall at the end of every tie block, per unit with positives."""
    keys = list(keys)
    blocks = pixels.filter(F.col("label").isNotNull()).groupBy(*keys, score.cast("float").alias("score")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n"))
    ranked = running_totals(blocks, keys, score_bucket(F.col("score")), ["score"], ["p", "n"], descending=True)
    return ranked.filter("all_p > 0").select(
        *keys, "score", "p", F.col("all_p").alias("positives"), F.col("all_n").alias("valid"),
        (F.col("cum_p") / F.col("all_p")).alias("recall"), (F.col("cum_p") / F.col("cum_n")).alias("precision"),
    )


def average_precision(curve: DataFrame, keys) -> DataFrame:
    """Sum of recall steps times precision, next to the constant-score baseline."""
    return curve.groupBy(*keys).agg(
        F.sum(F.col("p") / F.col("positives") * F.col("precision")).alias("average_precision"), (F.max("positives") / F.max("valid")).alias("constant_score_ap")
    )


def pr_envelope(curve: DataFrame, keys, building="building_id", points=101) -> DataFrame:
    """Running-max precision at fixed recall points, averaged per building.

    A recall value below the next grid point can only serve earlier points, so
    each block covers the grid points up to its recall: the envelope at a point
    is the largest precision among blocks at or beyond it. Blocks are first
    reduced to the best precision per recall slot (at most ``points`` per unit).
    """
    keys = list(keys)
    guess = F.floor(F.col("recall") * (points - 1) + 1e-9).cast("int")
    slots = curve.groupBy(*keys, building, guess.alias("_slot")).agg(F.max("precision").alias("_p"))
    packed = slots.groupBy(*keys, building).agg(F.collect_list(F.struct("_slot", "_p")).alias("_s"))
    grid = packed.withColumn("recall_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    best = F.array_max(F.transform(F.filter("_s", lambda s: s["_slot"] >= F.col("recall_index")), lambda s: s["_p"]))
    return grid.withColumn("_e", best).groupBy(building, "recall_index").agg(F.avg("_e").alias("precision"), F.count("*").alias("units"))
