"""Registered queries: decisions, fusion, metric aggregation and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.functions import metrics as M
from driftlens.operators import aggregate as A
from driftlens.operators import decide as D
from driftlens.plans.fixtures import CELLS, PX, UNITS, cells, grid, GRID, rounded, scores, table, units, with_sql

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


METRICS = ("f1", "iou", "precision", "recall", "fpr")
DIMS = "sequence_id, building_id, split, state, nuisance, scenario"


def predictions():
    return {"a": D.above(F.col("score_a"), 0.5), "b": D.above(F.col("score_b"), 0.4)}


def case_rows(spark, folder, preds=None):
    """Pixels -> counts per (unit, method) -> unit attributes -> case metrics."""
    rows = D.unit_counts(scores(spark, folder), ["unit_id"], preds or predictions(), attributes=units(spark, folder))
    rows = rows.withColumn("hypothesis", F.when(F.col("tp") + F.col("fn") > 0, "H1").otherwise("H0"))
    return rows.select("*", *[c.alias(m) for m, c in M.visible_metrics(F.col("hypothesis")).items()])


def plain_rows(spark, folder):
    rows = case_rows(spark, folder).drop(*METRICS)
    return rows.select("*", *[c.alias(m) for m, c in M.plain_metrics().items()])


def tidy(frame, columns):
    """Round the computed means once, at the end."""
    return frame.select(*[rounded(c).alias(c) if c in columns else F.col(c) for c in frame.columns])


PREDS = """preds AS (SELECT px.*, m.method, CASE m.method WHEN 'a' THEN score_a > CAST(0.5 AS FLOAT)
    ELSE score_b > CAST(0.4 AS FLOAT) END AS pred FROM px, (VALUES ('a'), ('b')) m(method))"""
COUNTS = """counts AS (SELECT method, unit_id, sequence_id, building_id, split, state, nuisance, scenario,
    count(*) FILTER (WHERE label = 1 AND pred) AS tp, count(*) FILTER (WHERE label = 0 AND pred) AS fp,
    count(*) FILTER (WHERE label = 1 AND NOT pred) AS fn, count(*) FILTER (WHERE label = 0 AND NOT pred) AS tn,
    count(*) FILTER (WHERE label IS NULL) AS ignored FROM preds GROUP BY ALL)"""
CASES = """cases AS (SELECT *, CASE WHEN tp + fn > 0 THEN 'H1' ELSE 'H0' END AS hypothesis,
    CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fp + fn) END AS iou,
    CASE WHEN tp + fn > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
    CASE WHEN tp + fn = 0 AND fp + tn > 0 THEN fp / (fp + tn) END AS fpr FROM counts)"""
PLAIN = """plain AS (SELECT *, CASE WHEN tp + fn > 0 THEN 'H1' ELSE 'H0' END AS hypothesis,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn > 0 THEN 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
    CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr,
    CASE WHEN tp + fp + fn + tn > 0 THEN (tp + fp) / (tp + fp + fn + tn) END AS marked_fraction FROM counts)"""
BASE = (PX, PREDS, COUNTS)
AVGS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
ROUNDED = ", ".join(f"round(avg({m}), 9) AS {m}" for m in METRICS)
NUMBERS = ", ".join(f"count({m}) AS {m}_buildings" for m in METRICS)
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in M.COUNTS)


def macro_sql(source, by, extra=""):
    return f"""SELECT {by}, CAST(sum(cases) AS BIGINT) AS cases, count(*) AS buildings, {ROUNDED}, {NUMBERS}
      FROM (SELECT {by}, building_id, count(*) AS cases, {AVGS} FROM {source} {extra} GROUP BY {by}, building_id) GROUP BY {by}"""


@register("split_building_macro", with_sql(*BASE, CASES, body=macro_sql("cases", "method, split")))
def split_building_macro(spark, folder):
    return tidy(A.building_macro(case_rows(spark, folder), ["method", "split"], METRICS), METRICS)


@register("unit_confusion", with_sql(*BASE, body=f"SELECT unit_id, method, tp, fp, fn, tn, ignored FROM counts"))
def unit_confusion(spark, folder):
    return D.unit_counts(scores(spark, folder), ["unit_id"], predictions())


@register("visible_case_metrics", with_sql(*BASE, CASES, body="SELECT unit_id, method, hypothesis, " + ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + " FROM cases"))
def visible_case_metrics(spark, folder):
    return case_rows(spark, folder).select("unit_id", "method", "hypothesis", *[rounded(m).alias(m) for m in METRICS])


@register("plain_map_metrics", with_sql(*BASE, PLAIN, body="SELECT unit_id, method, " + ", ".join(f"round({m}, 9) AS {m}" for m in (*METRICS, "marked_fraction")) + " FROM plain"))
def plain_map_metrics(spark, folder):
    return plain_rows(spark, folder).select("unit_id", "method", *[rounded(m).alias(m) for m in (*METRICS, "marked_fraction")])


ZERO = """SELECT unit_id, method, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1,
  round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 9) AS iou FROM counts"""


@register("zero_filled_metrics", with_sql(*BASE, body=ZERO))
def zero_filled_metrics(spark, folder):
    counts = D.unit_counts(scores(spark, folder), ["unit_id"], predictions())
    return counts.select("unit_id", "method", *[rounded(c).alias(m) for m, c in M.zero_metrics().items()])


@register("threshold_decisions", with_sql(PX, body="""SELECT unit_id, count(*) AS pixels,
  count(*) FILTER (WHERE (CASE WHEN pos % 2 = 0 THEN score_b > CAST(0.3 AS FLOAT) ELSE score_a > CAST(0.6 AS FLOAT) END) AND support) AS marked
  FROM px GROUP BY unit_id"""))
def threshold_decisions(spark, folder):
    """Native masks win on methods that have one (even positions here)."""
    mask = D.decide(F.col("score_a"), 0.6, D.above(F.col("score_b"), 0.3), F.col("pos") % 2 == 0, F.col("support"))
    return scores(spark, folder).groupBy("unit_id").agg(F.count("*").alias("pixels"), F.count_if(mask).alias("marked"))


PAIRS = ("pairs AS (SELECT unit_id, building_id, split, state, nuisance, " + ", ".join(
    f"count(*) FILTER (WHERE label = {t} AND {x}a AND {y}b) AS {n}"
    for n, (t, x, y) in zip(M.PAIR_COUNTS, [(t, x, y) for t in (1, 0) for x, y in (("", ""), ("", "NOT "), ("NOT ", ""), ("NOT ", "NOT "))])
) + " FROM (SELECT *, score_a > CAST(0.5 AS FLOAT) AS a, score_b > CAST(0.4 AS FLOAT) AS b FROM px) GROUP BY ALL)")


def pair_rows(spark, folder):
    p = predictions()
    counts = scores(spark, folder).groupBy("unit_id").agg(*M.pair_counts(p["a"], p["b"], F.col("label")))
    return counts.join(units(spark, folder), "unit_id")


@register("pair_agreement_counts", with_sql(PX, PAIRS, body="SELECT split, " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in M.PAIR_COUNTS) + " FROM pairs GROUP BY split"))
def pair_agreement_counts(spark, folder):
    return pair_rows(spark, folder).groupBy("split").agg(*[F.sum(n).alias(n) for n in M.PAIR_COUNTS])


RATES = """rates AS (SELECT *, CASE WHEN p > 0 THEN 'H1' ELSE 'H0' END AS hypothesis,
  CASE WHEN p > 0 THEN (tp_both + tp_b_only) / p END AS baseline_recall, CASE WHEN p > 0 THEN tp_both / p END AS confirmed_recall,
  CASE WHEN p > 0 THEN tp_b_only / p END AS lost_recall,
  CASE WHEN p > 0 AND tp_both + tp_b_only > 0 THEN tp_b_only / (tp_both + tp_b_only) END AS rejected_tp_fraction,
  CASE WHEN p > 0 AND tp_both + tp_b_only > 0 THEN 1 - tp_b_only / (tp_both + tp_b_only) END AS retained_tp_fraction,
  CASE WHEN p > 0 THEN tp_a_only / p END AS added_recall,
  CASE WHEN p > 0 AND tp_a_only + fn_neither > 0 THEN tp_a_only / (tp_a_only + fn_neither) END AS rescued_misses,
  CASE WHEN p > 0 AND tp_a_only + fp_a_only > 0 THEN tp_a_only / (tp_a_only + fp_a_only) END AS added_precision_h1,
  CASE WHEN p > 0 AND n > 0 THEN fp_a_only / n END AS extra_h1_fpr, CASE WHEN p = 0 AND n > 0 THEN fp_a_only / n END AS extra_h0_fpr,
  CASE WHEN p > 0 AND n > 0 THEN fp_b_only / n END AS removed_h1_fpr, CASE WHEN p = 0 AND n > 0 THEN fp_b_only / n END AS removed_h0_fpr,
  CASE WHEN p > 0 THEN tp_b_only / p END AS and_lost_recall, CASE WHEN p = 0 AND n > 0 THEN fp_b_only / n END AS and_removed_h0_fpr
  FROM (SELECT *, tp_both + tp_a_only + tp_b_only + fn_neither AS p, fp_both + fp_a_only + fp_b_only + tn_neither AS n FROM pairs))"""
RATE_NAMES = ("baseline_recall", "confirmed_recall", "lost_recall", "rejected_tp_fraction", "retained_tp_fraction", "added_recall", "rescued_misses",
              "added_precision_h1", "extra_h1_fpr", "extra_h0_fpr", "removed_h1_fpr", "removed_h0_fpr", "and_lost_recall", "and_removed_h0_fpr")


def two_level_sql(source, by, names, extra_inner="", extra_outer=""):
    inner = ", ".join(f"avg({n}) AS {n}" for n in names)
    outer = ", ".join(f"round(avg({n}), 9) AS {n}" for n in names)
    return f"SELECT {by}, count(*) AS buildings{extra_outer}, {outer} FROM (SELECT {by}, building_id{extra_inner}, {inner} FROM {source} GROUP BY {by}, building_id) GROUP BY {by}"


@register("recall_diagnostics", with_sql(PX, PAIRS, RATES, body=two_level_sql("rates", "split", RATE_NAMES, ", count(*) AS cases", ", CAST(sum(cases) AS BIGINT) AS cases")))
def recall_diagnostics(spark, folder):
    rows = pair_rows(spark, folder)
    positives = sum((F.col(n) for n in M.PAIR_COUNTS[1:4]), F.col(M.PAIR_COUNTS[0]))
    rows = rows.withColumn("hypothesis", F.when(positives > 0, "H1").otherwise("H0"))
    rates = rows.select("*", *[c.alias(n) for n, c in M.recall_rates(F.col("hypothesis")).items()])
    macro = A.building_macro(rates, ["split"], RATE_NAMES)
    return tidy(macro.select("split", "buildings", "cases", *RATE_NAMES), RATE_NAMES)


def left_map(spark, folder):
    return cells(spark, folder).withColumn("mask", D.above(F.col("score_a"), 0.5))


def right_map(spark, folder):
    """A second detector whose support misses position 3."""
    return cells(spark, folder).filter("pos != 3").withColumn("mask", D.above(F.col("score_b"), 0.4))


def mask_counts(frame, keys, mask="mask"):
    return frame.groupBy(*keys).agg(*M.confusion(F.col(mask), F.col("label")))


def _mask_counts_sql(mask):
    return f"""count(*) FILTER (WHERE label = 1 AND {mask}) AS tp, count(*) FILTER (WHERE label = 0 AND {mask}) AS fp,
      count(*) FILTER (WHERE label = 1 AND NOT {mask}) AS fn, count(*) FILTER (WHERE label = 0 AND NOT {mask}) AS tn,
      count(*) FILTER (WHERE label IS NULL) AS ignored"""


FUSED = "fused AS (SELECT *, score_a > CAST(0.5 AS FLOAT) AS a, score_b > CAST(0.4 AS FLOAT) AS b FROM cells WHERE pos <> 3)"


@register("fused_and_counts", with_sql(PX, CELLS, FUSED, body=f"SELECT unit_id, {_mask_counts_sql('(a AND b)')} FROM fused GROUP BY unit_id"))
def fused_and_counts(spark, folder):
    return mask_counts(D.fuse(left_map(spark, folder), right_map(spark, folder), ["unit_id", "pos"], "AND"), ["unit_id"])


@register("fused_or_counts", with_sql(PX, CELLS, FUSED, body=f"SELECT unit_id, {_mask_counts_sql('(a OR b)')} FROM fused GROUP BY unit_id"))
def fused_or_counts(spark, folder):
    return mask_counts(D.fuse(left_map(spark, folder), right_map(spark, folder), ["unit_id", "pos"], "OR"), ["unit_id"])


@register("history_gate_roles", with_sql(PX, CELLS, FUSED, body=f"""SELECT role, {_mask_counts_sql('m')} FROM (
  SELECT 'baseline' AS role, label, a AS m FROM fused UNION ALL
  SELECT 'candidate', label, a AND score_c > CAST(0.35 AS FLOAT) FROM fused) GROUP BY role"""))
def history_gate_roles(spark, folder):
    history = right_map(spark, folder).select("unit_id", "pos", "label", F.col("score_c").alias("history_score"))
    return mask_counts(D.gated_roles(left_map(spark, folder), history, ["unit_id", "pos"], 0.35), ["role"], "role_mask")


@register("matched_support", with_sql(PX, CELLS, body="""SELECT l.unit_id, count(*) AS matched_pixels,
  count(*) FILTER (WHERE l.label IS DISTINCT FROM CASE WHEN r.pos = 7 THEN 0 ELSE r.label END) AS label_conflicts
  FROM cells l JOIN cells r ON l.unit_id = r.unit_id AND l.pos = r.pos WHERE r.pos <> 3 GROUP BY l.unit_id"""))
def matched_support(spark, folder):
    """The right side's label at position 7 is overwritten, so conflicts appear."""
    right = right_map(spark, folder).withColumn("label", F.when(F.col("pos") == 7, 0).otherwise(F.col("label")))
    matched = D.match_support(left_map(spark, folder), right.withColumnRenamed("mask", "right_mask"), ["unit_id", "pos"], ["right_mask"])
    return D.support_conflicts(matched, ["unit_id"])


@register("fixed_controls", with_sql(PX, body="""SELECT sham, control, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM (
  SELECT unit_id % 10 = 0 AS sham, c.control, CASE WHEN c.control = 'always_positive' THEN p ELSE 0 END AS tp,
    CASE WHEN c.control = 'always_positive' THEN n ELSE 0 END AS fp, CASE WHEN c.control = 'always_negative' THEN p ELSE 0 END AS fn,
    CASE WHEN c.control = 'always_negative' THEN n ELSE 0 END AS tn
  FROM (SELECT unit_id, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM px GROUP BY 1),
    (VALUES ('always_positive'), ('always_negative')) c(control)) GROUP BY 1, 2"""))
def fixed_controls(spark, folder):
    counted = scores(spark, folder).groupBy("unit_id").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )
    rows = D.control_counts(counted).withColumn("sham", F.col("unit_id") % 10 == 0)
    return rows.groupBy("sham", "control").agg(*[F.sum(c).alias(c) for c in M.COUNTS])


SLICE_DIMS = ("state", "nuisance", "scenario", "hypothesis")


def _slice_sql():
    parts = [("'all'", "'all'")] + [(f"'{d}'", d) for d in SLICE_DIMS]
    return " UNION ALL ".join(
        f"""SELECT method, split, {n} AS dimension, value, CAST(sum(cases) AS BIGINT) AS cases, count(*) AS buildings, {ROUNDED}
        FROM (SELECT method, split, building_id, {v} AS value, count(*) AS cases, {AVGS} FROM cases GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4"""
        for n, v in parts
    )


@register("dimension_slices", with_sql(*BASE, CASES, body=_slice_sql()))
def dimension_slices(spark, folder):
    return tidy(A.sliced_macro(case_rows(spark, folder), ["method", "split"], SLICE_DIMS, METRICS), METRICS)


SUBSETS = """subsets AS (SELECT p.*, s.subset FROM plain p, (VALUES ('all'), ('positive'), ('no_event')) s(subset)
  WHERE tp + fp + fn + tn > 0 AND (s.subset = 'all' OR (s.subset = 'positive') = (tp + fn > 0)))"""
PM = ("precision", "recall", "f1", "iou", "fpr")


def _pooled_sql(level):
    avgs = ", ".join(f"round(avg({m}), 9) AS {m}, count({m}) AS {m}_units" for m in PM)
    return f"""SELECT method, subset, count(*) AS units, CAST(sum(pairs) AS BIGINT) AS pairs, {avgs} FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn > 0 THEN 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr
      FROM (SELECT method, subset, {level}, count(*) AS pairs, {SUMS} FROM subsets GROUP BY 1, 2, 3)) GROUP BY 1, 2"""


@register("sequence_pooled_macro", with_sql(*BASE, PLAIN, SUBSETS, body=_pooled_sql("sequence_id")))
def sequence_pooled_macro(spark, folder):
    return tidy(A.pooled_macro(A.subset_rows(plain_rows(spark, folder)), ["method", "subset"], "sequence_id", PM), PM)


@register("building_pooled_macro", with_sql(*BASE, PLAIN, SUBSETS, body=_pooled_sql("building_id")))
def building_pooled_macro(spark, folder):
    return tidy(A.pooled_macro(A.subset_rows(plain_rows(spark, folder)), ["method", "subset"], "building_id", PM), PM)


@register("frame_then_building_macro", with_sql(*BASE, PLAIN, SUBSETS, body=f"""SELECT method, subset, count(*) AS units, CAST(sum(pairs) AS BIGINT) AS pairs,
  {", ".join(f"round(avg({m}), 9) AS {m}, count({m}) AS {m}_units" for m in PM)}
  FROM (SELECT method, subset, building_id, count(*) AS pairs, {", ".join(f"avg({m}) AS {m}" for m in PM)} FROM subsets GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def frame_then_building_macro(spark, folder):
    return tidy(A.frame_macro(A.subset_rows(plain_rows(spark, folder)), ["method", "subset"], PM), PM)


ROBUST = ("precision", "recall", "f1", "iou", "fpr", "marked_fraction")


@register("guarded_condition_macro", with_sql(*BASE, PLAIN, body=f"""SELECT s.method, s.state, coalesce(buildings, 0) AS buildings,
  coalesce(pairs, 0) AS pairs, coalesce(positive_pairs, 0) AS positive_pairs, {", ".join(f"coalesce({c}, 0) AS {c}" for c in M.COUNTS)},
  {", ".join(f"round({m}, 9) AS {m}, coalesce({m}_buildings, 0) AS {m}_buildings" for m in ROBUST)}
  FROM (SELECT method, state FROM (VALUES ('a'), ('b'), ('absent')) m(method), (SELECT DISTINCT o_orderpriority AS state FROM orders)) s LEFT JOIN (
  SELECT method, state, count(*) AS buildings, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(pp) AS BIGINT) AS positive_pairs, {SUMS},
    {", ".join(f"avg({m}) AS {m}, count({m}) AS {m}_buildings" for m in ROBUST)}
  FROM (SELECT method, state, building_id, count(*) AS pairs, count(*) FILTER (WHERE tp + fn > 0) AS pp, {SUMS},
    {", ".join(f"avg({m}) FILTER (WHERE tp + fn > 0) AS {m}" for m in ROBUST[:4])}, avg(fpr) AS fpr, avg(marked_fraction) AS marked_fraction
    FROM plain WHERE tp + fp + fn + tn > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) r ON s.method = r.method AND s.state = r.state"""))
def guarded_condition_macro(spark, folder):
    """Keys without evaluable rows stay in the report."""
    rows = plain_rows(spark, folder).filter("tp + fp + fn + tn > 0")
    states = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("state")).distinct()
    spine = states.withColumn("method", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("absent"))))
    return tidy(A.guarded_macro(rows, ["method", "state"], ROBUST, spine=spine), ROBUST)


def origins(spark, folder):
    """Which buildings each method's training has seen; b's list is not verified."""
    seen = table(spark, folder, "nation").filter("n_nationkey % 3 = 0")
    return seen.select(F.lit("a").alias("method"), F.col("n_nationkey").alias("building_id"))


def exposed_rows(spark, folder):
    from driftlens.operators.sequences import training_exposure

    status = {"a": "verified", "b": "unverified"}
    return training_exposure(plain_rows(spark, folder), origins(spark, folder), status)


EXPOSED = """exposed AS (SELECT *, CASE WHEN method = 'a' THEN CASE WHEN building_id % 3 = 0 THEN 'seen' ELSE 'verified_unseen' END ELSE 'unknown' END AS exposure FROM plain)"""


@register("exposure_scope_macro", with_sql(*BASE, PLAIN, EXPOSED, body=f"""SELECT method, split_scope, training_scope, count(*) AS buildings, CAST(sum(pairs) AS BIGINT) AS pairs,
  count(*) FILTER (WHERE exposure = 'seen') AS seen_buildings, count(*) FILTER (WHERE exposure = 'verified_unseen') AS verified_unseen_buildings,
  count(*) FILTER (WHERE exposure = 'unknown') AS unknown_buildings, {", ".join(f"round(avg({m}), 9) AS {m}" for m in ROBUST)}
  FROM (SELECT method, s.scope AS split_scope, t.scope AS training_scope, building_id, count(*) AS pairs, max(exposure) AS exposure,
    {", ".join(f"avg({m}) FILTER (WHERE tp + fn > 0) AS {m}" for m in ROBUST[:4])}, avg(fpr) AS fpr, avg(marked_fraction) AS marked_fraction
    FROM exposed e, LATERAL (SELECT unnest([e.split, 'all_selected']) AS scope) s, LATERAL (SELECT unnest(['all', e.exposure]) AS scope) t
    WHERE tp + fp + fn + tn > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""))
def exposure_scope_macro(spark, folder):
    rows = exposed_rows(spark, folder).filter("tp + fp + fn + tn > 0")
    return tidy(A.exposure_macro(rows, ["method"], ROBUST), ROBUST)


@register("training_exposure", with_sql(*BASE, PLAIN, EXPOSED, body="SELECT method, exposure, count(*) AS units, count(DISTINCT building_id) AS buildings FROM exposed GROUP BY 1, 2"))
def training_exposure_summary(spark, folder):
    return exposed_rows(spark, folder).groupBy("method", "exposure").agg(
        F.count("*").alias("units"), F.countDistinct("building_id").alias("buildings")
    )


@register("fusion_exposure", with_sql(*BASE, PLAIN, EXPOSED, body="""SELECT building_id, CASE WHEN bool_or(exposure = 'seen') THEN 'seen' WHEN bool_or(exposure = 'unknown') THEN 'unknown' ELSE 'verified_unseen' END AS exposure FROM exposed GROUP BY 1"""))
def fusion_exposure(spark, folder):
    """A fusion of all methods is exposed as its worst member."""
    from driftlens.operators.sequences import combined_exposure

    return exposed_rows(spark, folder).groupBy("building_id").agg(combined_exposure(F.collect_set("exposure")).alias("exposure"))


def fusion_units(spark, folder):
    rows = case_rows(spark, folder).drop(*METRICS)
    arm = F.when(F.col("nuisance") == "P", "clean").otherwise("event")
    return rows.select(
        "*", arm.alias("arm"), (F.col("unit_id") % 5).cast("int").alias("frame"),
        F.when(F.col("unit_id") % 2 == 0, "step_event").otherwise("earliest_state").alias("target"),
    )


def _fusion_sql():
    z = {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "iou": ("tp", "tp + fp + fn")}
    case = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END"
    fpr = "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END"
    inner = [f"avg({case(a, b)}) FILTER (WHERE hypothesis = 'H1' AND tp + fn > 0) AS {m}" for m, (a, b) in z.items()]
    inner += [f"avg({fpr}) FILTER (WHERE hypothesis = 'H0') AS h0_fpr", f"avg({fpr}) FILTER (WHERE stable) AS no_event_fpr",
              f"avg({fpr}) FILTER (WHERE persistent) AS persistent_fpr",
              "avg(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + fp) / (tp + fp + fn + tn) END) AS marked_fraction",
              "count(*) AS n_units", "count(*) FILTER (WHERE hypothesis = 'H1' AND tp + fn > 0) AS n_positive",
              "count(*) FILTER (WHERE hypothesis = 'H0') AS n_h0", "count(*) FILTER (WHERE stable) AS n_no_event",
              "count(*) FILTER (WHERE persistent) AS n_persistent", "count(*) FILTER (WHERE arm = 'event') AS events"]
    inner += [f"sum({c}) AS {c}, sum({c}) FILTER (WHERE arm = 'event') AS e_{c}" for c in M.COUNTS]
    e = lambda s: s.replace("tp", "e_tp").replace("fp", "e_fp").replace("fn", "e_fn")
    outer = [f"round(avg({m}), 9) AS {m}, round(avg({case(a, b)}), 9) AS all_{m}, round(avg(CASE WHEN events > 0 THEN {case(e(a), e(b))} END), 9) AS event_{m}"
             .replace("AS e_", "AS e_") for m, (a, b) in z.items()]
    outer += [f"round(avg({m}), 9) AS {m}" for m in ("h0_fpr", "no_event_fpr", "persistent_fpr", "marked_fraction")]
    outer += [f"CAST(sum({s}) AS BIGINT) AS {s}" for s in ("n_units", "n_positive", "n_h0", "n_no_event", "n_persistent", *M.COUNTS)]
    units_cte = """funits AS (SELECT *, arm = 'event' AND tp + fn = 0 AS stable, arm = 'event' AND tp + fn = 0 AND unit_id % 5 = 3 AND unit_id % 2 = 0 AS persistent
      FROM (SELECT *, CASE WHEN nuisance = 'P' THEN 'clean' ELSE 'event' END AS arm FROM cases))"""
    return with_sql(*BASE, CASES, units_cte, body=f"""SELECT method, split, count(*) AS n_buildings, {', '.join(outer)} FROM (
      SELECT method, split, building_id, {', '.join(inner)} FROM funits GROUP BY 1, 2, 3) GROUP BY 1, 2""")


@register("fusion_report", _fusion_sql())
def fusion_report(spark, folder):
    out = A.fusion_macro(fusion_units(spark, folder), ["method", "split"])
    zero = list(M.zero_metrics())
    means = [*zero, *[f"all_{m}" for m in zero], *[f"event_{m}" for m in zero], "h0_fpr", "no_event_fpr", "persistent_fpr", "marked_fraction"]
    return tidy(out, means)


@register("unit_table_checks", with_sql(*BASE, CASES, body="""SELECT problem, count(*) AS rows FROM (
  SELECT 'counts_do_not_add_up' AS problem FROM cases WHERE unit_id % 50 = 0 UNION ALL
  SELECT 'saved_metric_differs' FROM cases WHERE unit_id % 77 = 0 AND recall IS DISTINCT FROM 0.5 UNION ALL
  SELECT 'duplicate_unit' FROM cases WHERE method = 'a' AND state = '1-URGENT' AND nuisance = 'O' AND split = 'val') GROUP BY 1"""))
def unit_table_checks(spark, folder):
    """A saved table with broken totals, edited metrics and repeated VAL units."""
    rows = case_rows(spark, folder)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    saved = rows.select(
        F.concat_ws("/", "method", "unit_id").alias("key"), *M.COUNTS, "hypothesis", "method", "state", "nuisance", "split",
        F.when(F.col("unit_id") % 50 == 0, total + 1).otherwise(total).alias("evaluated"),
        F.when(F.col("unit_id") % 77 == 0, 0.5).otherwise(F.col("recall")).alias("saved_recall"),
    )
    repeated = saved.filter("method = 'a' AND state = '1-URGENT' AND nuisance = 'O' AND split = 'val'")
    repeated = repeated.withColumn("evaluated", total).withColumn("saved_recall", M.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return A.unit_table_problems(saved.unionByName(repeated), "key")


def _multi_sql():
    avgs = ", ".join(f"round(avg({m}), 9) AS {m}" for m in METRICS)
    return " UNION ALL ".join(
        f"SELECT method, split, '{n}' AS level, {v} AS value, count(*) AS units, {avgs}, {SUMS} FROM cases GROUP BY 1, 2, 3, 4"
        for n, v in (("all", "'all'"), ("building_id", "CAST(building_id AS VARCHAR)"), ("state", "state"), ("nuisance", "nuisance"))
    )


@register("unit_aggregates", with_sql(*BASE, CASES, body=_multi_sql()))
def unit_aggregates(spark, folder):
    out = A.multi_level(case_rows(spark, folder), ["method", "split"], ["building_id", "state", "nuisance"], METRICS)
    return tidy(out, METRICS)


@register("and_loss_summary", with_sql(PX, PAIRS, RATES, body="""SELECT split, dimension, value, count(*) AS buildings,
  round(avg(f - b), 9) AS delta_recall, round(avg(rej), 9) AS rejected_share, round(avg(100 * rem), 9) AS fpr_drop_points FROM (
  SELECT split, building_id, d.dimension, d.value, avg(baseline_recall) AS b, avg(confirmed_recall) AS f, avg(rejected_tp_fraction) AS rej,
    avg(and_removed_h0_fpr) AS rem FROM rates r, LATERAL (SELECT unnest(['all', 'state', 'nuisance']) AS dimension, unnest(['all', r.state, r.nuisance]) AS value) d
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""))
def and_loss_summary(spark, folder):
    """What an AND gate costs and saves against its baseline."""
    rows = pair_rows(spark, folder)
    positives = sum((F.col(n) for n in M.PAIR_COUNTS[1:4]), F.col(M.PAIR_COUNTS[0]))
    rows = rows.withColumn("hypothesis", F.when(positives > 0, "H1").otherwise("H0"))
    keep = ("baseline_recall", "confirmed_recall", "rejected_tp_fraction", "and_removed_h0_fpr")
    rates = M.recall_rates(F.col("hypothesis"))
    rows = rows.select("split", "building_id", "state", "nuisance", *[rates[k].alias(k) for k in keep])
    spread = rows.withColumn("d", F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in (("all", F.lit("all")), ("state", F.col("state")), ("nuisance", F.col("nuisance")))
    ]))).select("*", "d.*")
    level = A.means(spread, ["split", "dimension", "value", "building_id"], keep)
    return level.groupBy("split", "dimension", "value").agg(
        F.count("*").alias("buildings"),
        rounded(F.avg(F.col("confirmed_recall") - F.col("baseline_recall"))).alias("delta_recall"),
        rounded(F.avg("rejected_tp_fraction")).alias("rejected_share"),
        rounded(F.avg(100 * F.col("and_removed_h0_fpr"))).alias("fpr_drop_points"),
    )


def mode_rows(spark, folder):
    """Method a as mode ``previous`` and b as ``history`` on the same unit."""
    rows = case_rows(spark, folder)
    return rows.withColumn("mode", F.when(F.col("method") == "a", "previous").otherwise("history"))


@register("previous_vs_history", with_sql(*BASE, CASES, body="""SELECT split, count(*) AS buildings, CAST(sum(n) AS BIGINT) AS matched_units,
  round(avg(pr), 9) AS previous_recall, round(avg(hr), 9) AS history_recall, round(avg(dr), 9) AS delta_recall,
  round(avg(pf), 9) AS previous_fpr, round(avg(hf), 9) AS history_fpr, round(avg(df), 9) AS delta_fpr FROM (
  SELECT split, building_id, count(*) AS n, avg(p.recall) AS pr, avg(h.recall) AS hr, avg(h.recall - p.recall) AS dr,
    avg(p.fpr) AS pf, avg(h.fpr) AS hf, avg(h.fpr - p.fpr) AS df
  FROM (SELECT * FROM cases WHERE method = 'a') p JOIN (SELECT unit_id, recall, fpr FROM cases WHERE method = 'b') h USING (unit_id) GROUP BY 1, 2) GROUP BY 1"""))
def previous_vs_history(spark, folder):
    keys = ["unit_id", "split", "building_id"]
    paired = A.paired_deltas(mode_rows(spark, folder), keys, "mode", "previous", "history", ["recall", "fpr"])
    names = ["previous_recall", "history_recall", "delta_recall", "previous_fpr", "history_fpr", "delta_fpr"]
    macro = A.building_macro(paired, ["split"], names)
    return tidy(macro.select("split", "buildings", F.col("cases").alias("matched_units"), *names), names)


@register("matched_comparison", with_sql(*BASE, CASES, body="""SELECT p.split, p.state, p.n AS units, round(p.f1, 9) AS baseline_f1, round(h.f1, 9) AS candidate_f1,
  round(h.f1 - p.f1, 9) AS delta_f1, round(p.fpr, 9) AS baseline_fpr, round(h.fpr, 9) AS candidate_fpr, round(h.fpr - p.fpr, 9) AS delta_fpr, p.n = h.n AS same_cohort
  FROM (SELECT split, state, count(*) AS n, avg(f1) AS f1, avg(fpr) AS fpr FROM cases WHERE method = 'a' GROUP BY 1, 2) p
  JOIN (SELECT split, state, count(*) AS n, avg(f1) AS f1, avg(fpr) AS fpr FROM cases WHERE method = 'b' GROUP BY 1, 2) h ON p.split = h.split AND p.state = h.state"""))
def matched_comparison(spark, folder):
    rows = case_rows(spark, folder).withColumn("role", F.when(F.col("method") == "a", "baseline").otherwise("candidate"))
    level = rows.groupBy("split", "state", "role").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("fpr").alias("fpr"))
    paired = A.paired_deltas(level, ["split", "state"], "role", "baseline", "candidate", ["n", "f1", "fpr"])
    out = paired.withColumn("units", F.col("baseline_n")).withColumn("same_cohort", F.col("baseline_n") == F.col("candidate_n"))
    names = [c for c in out.columns if c.endswith(("f1", "fpr"))]
    return tidy(out.drop("baseline_n", "candidate_n", "delta_n"), names)


def run_records(spark, folder):
    """One run record per unit: a tenth failed, a tenth is pending."""
    key = F.col("unit_id")
    return units(spark, folder).select(
        "unit_id",
        F.when(key % 10 == 3, "failed").when(key % 10 == 4, "pending").otherwise("completed").alias("status"),
        F.when(key % 10 == 3, F.concat(F.lit("error_"), F.col("nuisance"))).alias("reason"),
        (key % 10 > 4).alias("evaluable"),
    )


RECORDS = """records AS (SELECT unit_id, CASE unit_id % 10 WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN unit_id % 10 = 3 THEN 'error_' || nuisance END AS reason, unit_id % 10 > 4 AS evaluable FROM units)"""


@register("unit_coverage", with_sql(UNITS, RECORDS, body="""SELECT *, CASE WHEN completed = expected THEN 'complete' WHEN completed > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM (
  SELECT split, state, count(*) AS expected, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status IS NULL) AS missing, count(*) FILTER (WHERE evaluable) AS evaluable,
  count(DISTINCT reason) AS reasons FROM units LEFT JOIN (SELECT * FROM records WHERE unit_id % 7 <> 0) USING (unit_id) GROUP BY 1, 2)"""))
def unit_coverage(spark, folder):
    """Every seventh unit of the audit has no record."""
    return A.coverage(units(spark, folder), run_records(spark, folder).filter("unit_id % 7 != 0"), "unit_id", ["split", "state"])


@register("coverage_reasons", with_sql(UNITS, RECORDS, body="SELECT split, state, reason, count(*) AS units FROM units JOIN records USING (unit_id) WHERE reason IS NOT NULL GROUP BY 1, 2, 3"))
def coverage_reasons(spark, folder):
    return A.coverage_reasons(units(spark, folder), run_records(spark, folder), "unit_id", ["split", "state"])


@register("method_status", with_sql(UNITS, RECORDS, body="""SELECT state AS method, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending,
  round(sum(seconds), 2) AS elapsed, count(*) FILTER (WHERE evaluable) AS initialised FROM units JOIN records USING (unit_id) GROUP BY 1"""))
def method_status(spark, folder):
    rows = units(spark, folder).join(run_records(spark, folder), "unit_id").select(
        F.col("state").alias("method"), "status", F.col("seconds").alias("elapsed"), F.col("evaluable").alias("initialised")
    )
    return A.method_status(rows, ["method"]).withColumn("elapsed", F.round("elapsed", 2))


@register("cost_totals", with_sql(UNITS, RECORDS, body="""SELECT state AS method, round(sum(seconds), 2) AS seconds, CAST(sum(3 * unit_id) AS BIGINT) AS supported_bytes,
  count(*) FILTER (WHERE evaluable) AS reused, count(*) FILTER (WHERE NOT evaluable) AS computed FROM units JOIN records USING (unit_id) GROUP BY 1"""))
def cost_totals(spark, folder):
    rows = units(spark, folder).join(run_records(spark, folder), "unit_id").select(
        F.col("state").alias("method"), F.col("seconds").alias("elapsed"), (3 * F.col("unit_id")).alias("supported_bytes"), F.col("evaluable").alias("reused")
    )
    return A.cost_totals(rows, ["method"]).withColumn("seconds", F.round("seconds", 2))


@register("runtime_projection", with_sql(UNITS, RECORDS, body="""SELECT j.method, jobs, round(jobs * lo / 3600, 9) AS low_hours, round(jobs * hi / 3600, 9) AS high_hours, lo IS NULL AS unmeasured
  FROM (SELECT state AS method, count(*) AS jobs FROM units GROUP BY 1) j LEFT JOIN (
  SELECT state AS method, min(seconds) AS lo, max(seconds) AS hi FROM units JOIN records USING (unit_id) WHERE status = 'completed' GROUP BY 1) m ON j.method = m.method"""))
def runtime_projection(spark, folder):
    every = units(spark, folder).withColumnRenamed("state", "method").withColumnRenamed("seconds", "elapsed")
    done = every.join(run_records(spark, folder).filter("status = 'completed'"), "unit_id", "left_semi")
    return tidy(A.runtime_projection(done, every), ("low_hours", "high_hours"))


@register("parity_violations", with_sql(*BASE, body="""SELECT method, unit_id, CASE WHEN unit_id % 101 = 0 THEN 'not_saved' ELSE 'value_differs' END AS problem
  FROM counts WHERE unit_id % 101 = 0 OR (unit_id % 53 = 0 AND tp > 0)
  UNION ALL SELECT 'ghost', unit_id, 'not_recomputed' FROM counts WHERE method = 'a' AND unit_id % 211 = 0"""))
def parity_violations(spark, folder):
    counts = D.unit_counts(scores(spark, folder), ["unit_id"], predictions())
    saved = counts.filter("unit_id % 101 != 0").withColumn("tp", F.when((F.col("unit_id") % 53 == 0) & (F.col("tp") > 0), 0).otherwise(F.col("tp")))
    ghosts = counts.filter("method = 'a' AND unit_id % 211 = 0").withColumn("method", F.lit("ghost"))
    return A.parity_violations(counts, saved.unionByName(ghosts), ["method", "unit_id"], M.COUNTS)


def labelled_grid(spark, folder):
    from driftlens.operators.labels import derived_label

    g = grid(spark, folder).withColumn("label", derived_label(F.col("old_bits"), F.col("new_bits"), F.col("support")))
    return g.withColumn("pred", D.above(F.col("score"), 0.6))


LGRID = """lgrid AS (SELECT *, CASE WHEN support AND old_bits <> 0 AND new_bits <> 0 THEN CASE WHEN old_bits <> new_bits THEN 1 ELSE 0 END END AS label,
  score > CAST(0.6 AS FLOAT) AS pred FROM grid)"""
SLICES = """slices AS (SELECT image_id, building_id, channel, direction,
  count(*) FILTER (WHERE label = 1 AND mv AND pred) AS tp, count(*) FILTER (WHERE label = 0 AND (o OR n) AND pred) AS fp,
  count(*) FILTER (WHERE label = 1 AND mv AND NOT pred) AS fn, count(*) FILTER (WHERE label = 0 AND (o OR n) AND NOT pred) AS tn
  FROM (SELECT *, CASE direction WHEN 'change' THEN o <> n WHEN 'gain' THEN NOT o AND n ELSE o AND NOT n END AS mv FROM (
    SELECT g.*, c.channel, d.direction, (old_bits >> c.channel) & 1 = 1 AS o, (new_bits >> c.channel) & 1 = 1 AS n
    FROM {source} g, (SELECT unnest(range(7))::INTEGER AS channel) c, (VALUES ('change'), ('gain'), ('loss')) d(direction))) GROUP BY 1, 2, 3, 4)"""


@register("class_slices", with_sql(GRID, LGRID, SLICES.format(source="lgrid"), body="SELECT channel, direction, image_id, tp, fp, fn, tn FROM slices"))
def class_slices(spark, folder):
    return A.class_slices(labelled_grid(spark, folder), ["image_id"], 7)


_PLAIN_EXPR = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn > 0 THEN 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr"""
SLICE_MACRO = """SELECT {by}channel, direction, count(*) AS buildings, {sums}, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
  round(avg(f1), 9) AS f1, round(avg(fpr), 9) AS fpr FROM (SELECT *, {plain} FROM (
  SELECT {by}channel, direction, building_id, {sums} FROM {source} GROUP BY ALL)) GROUP BY ALL"""


def slice_macro(slices, by):
    from driftlens.operators.segmentation import slice_macro as macro

    return tidy(macro(slices, by), ("precision", "recall", "f1", "fpr"))


@register("class_slice_macro", with_sql(GRID, LGRID, SLICES.format(source="lgrid"), body=SLICE_MACRO.format(by="", sums=SUMS, plain=_PLAIN_EXPR, source="slices")))
def class_slice_macro(spark, folder):
    """Classes absent from the truth stay in the table with NULL metrics."""
    return slice_macro(A.class_slices(labelled_grid(spark, folder), ["building_id"], 7), ["channel", "direction"])


REGIONS = """regions AS (SELECT g.*, r.region FROM lgrid g, (VALUES ('annotated_support'), ('with_sky'), ('without_sky'), ('sky_only')) r(region)
  WHERE r.region = 'annotated_support' OR (image_id % 4 <> 0 AND (x + y) % 7 <> 0 AND (r.region = 'with_sky' OR (r.region = 'sky_only') = (y < 4))))"""


@register("region_slices", with_sql(GRID, LGRID, REGIONS, SLICES.format(source="regions").replace("image_id, building_id, channel", "region, building_id, channel"),
          body=SLICE_MACRO.format(by="region, ", sums=SUMS, plain=_PLAIN_EXPR, source="slices")))
def region_slices(spark, folder):
    """Explicit sky regions for three images in four; the rest only have annotated support."""
    g = labelled_grid(spark, folder)
    regions = g.filter("image_id % 4 != 0").select(
        "image_id", "y", "x", (F.col("y") < 4).alias("sky"), ((F.col("x") + F.col("y")) % 7 != 0).alias("known_region")
    )
    slices = A.class_slices(A.region_pixels(g, regions, ["image_id", "y", "x"], "image_id"), ["region", "building_id"], 7)
    return slice_macro(slices, ["region", "channel", "direction"])
