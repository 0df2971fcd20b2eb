"""Registered queries: calibration, ranking curves, sampling and top-k picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.operators import calibrate as C
from driftlens.operators import decide as D
from driftlens.operators import select as S
from driftlens.plans.fixtures import CELLS, GRID, IMAGES, PX, UNITS, cells, grid, images, rounded, scores, table, units, with_sql
from driftlens.plans.maps import COMPONENT_MODE, FRAME_GRID4, RANKED, TRANS, ranked_tiles, transition_candidates
from driftlens.session import cut_lineage
from driftlens.plans.metrics import PAIRS, case_rows, pair_rows, tidy

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def long_scores(spark, folder):
    """Methods as rows; repeated map-side only, counts follow at once."""
    return long_rows(scores(spark, folder))


def long_rows(wide, *more):
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"score_{m}").alias("score")) for m in ("a", "c")])
    return wide.select("unit_id", "pos", "label", *more, F.inline(rows))


def val_units(spark, folder):
    """Calibration units: VAL without the shams (marked on every tenth unit)."""
    marked = units(spark, folder).withColumn("sham", F.col("unit_id") % 10 == 0)
    return marked.filter("split = 'val' AND NOT sham").select("unit_id", "building_id")


LONG = "long AS (SELECT px.*, m.method, CASE m.method WHEN 'a' THEN score_a ELSE score_c END AS score FROM px, (VALUES ('a'), ('c')) m(method))"
VAL = "val AS (SELECT * FROM long WHERE split = 'val' AND unit_id % 10 <> 0 AND label IS NOT NULL)"
GRID101 = "t AS (SELECT i::INTEGER AS i, CAST(i / 100.0::DOUBLE AS FLOAT) AS thr FROM range(101) r(i))"


@register("count_curves", with_sql(PX, GRID101, body="""SELECT building_id, i AS threshold_index, count(*) FILTER (WHERE label = 1 AND score_c > thr) AS tp, count(*) FILTER (WHERE label = 0 AND score_c > thr) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT score_c > thr) AS fn, count(*) FILTER (WHERE label = 0 AND NOT score_c > thr) AS tn FROM px, t WHERE label IS NOT NULL GROUP BY 1, 2"""))
def count_curves(spark, folder):
    pixels = scores(spark, folder).join(units(spark, folder).select("unit_id", "building_id"), "unit_id")
    return C.count_curves(pixels, ["building_id"], F.col("score_c"))


_EXT = "t AS (SELECT DISTINCT thr FROM (SELECT CAST(i / 100.0::DOUBLE AS FLOAT) AS thr FROM range(101) r(i) UNION ALL SELECT CAST(exp(ln(1.1754943508222875e-38::DOUBLE) + (ln(0.5::DOUBLE) - ln(1.1754943508222875e-38::DOUBLE)) * i / 768) AS FLOAT) FROM range(769) r(i)))"


@register("extended_grid_counts", with_sql(PX, _EXT, body="""SELECT round(thr::DOUBLE, 6) AS threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, count(*) AS grid_points FROM (SELECT thr,
  (SELECT count(*) FROM px WHERE label = 1 AND score_c > thr) AS tp, (SELECT count(*) FROM px WHERE label = 0 AND score_c > thr) AS fp FROM t) GROUP BY 1"""))
def extended_grid_counts(spark, folder):
    """Linear grid united with the geometric one; tiny thresholds are folded after rounding."""
    out = C.grid_counts(scores(spark, folder).withColumn("k", F.lit(1)), ["k"], F.col("score_c"), extended=True)
    return out.groupBy(rounded(F.col("threshold").cast("double"), 6).alias("threshold")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count("*").alias("grid_points"))


@register("best_f1_threshold", with_sql(PX, LONG, VAL, GRID101, """u AS (SELECT method, building_id, unit_id, i, count(*) FILTER (WHERE label = 1 AND score > thr) AS tp, count(*) FILTER (WHERE label = 0 AND score > thr) AS fp,
    count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM val, t GROUP BY ALL),
  b AS (SELECT method, i, building_id, avg(CASE WHEN p > 0 THEN 2 * tp / (tp + fp + p) END) AS f1, avg(CASE WHEN p = 0 AND n > 0 THEN fp / n END) AS fpr FROM u GROUP BY 1, 2, 3),
  c AS (SELECT method, i, avg(f1) AS f1, avg(fpr) AS fpr, count(f1) AS h1_buildings, count(fpr) AS h0_buildings FROM b GROUP BY 1, 2),
  d AS (SELECT * FROM c QUALIFY f1 >= max(f1) OVER (PARTITION BY method) - 1e-12), e AS (SELECT * FROM d QUALIFY fpr <= min(fpr) OVER (PARTITION BY method) + 1e-12)""",
  body="SELECT method, max(i) AS threshold_index, round(max_by(f1, i), 9) AS f1, round(max_by(fpr, i), 9) AS fpr, max_by(h1_buildings, i) AS h1_buildings, max_by(h0_buildings, i) AS h0_buildings, round(CAST(CAST(max(i) / 100.0::DOUBLE AS FLOAT) AS DOUBLE), 9) AS threshold FROM e GROUP BY 1"))
def best_f1_threshold(spark, folder):
    out = C.calibrate_f1(long_scores(spark, folder), val_units(spark, folder), ["method"], F.col("score"))
    return tidy(out, ("f1", "fpr", "threshold"))


def masses(spark, folder):
    return C.weighted_scores(long_scores(spark, folder), val_units(spark, folder), ["method"], F.col("score"))


MASS = """w AS (SELECT method, building_id, unit_id, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM val GROUP BY 1, 2, 3),
  curve AS (SELECT method, score, avg(rec) AS recall, avg(f) AS fpr, any_value(h0) AS h0 FROM (SELECT s.method, s.score, w.building_id, avg(CASE WHEN p > 0 THEN above_p / p END) AS rec, avg(CASE WHEN p = 0 AND n > 0 THEN above_n / n END) AS f, any_value(s.h0) AS h0 FROM (
    SELECT v.method, v.score, v.h0, x.unit_id, count(*) FILTER (WHERE x.label = 1 AND x.score > v.score) AS above_p, count(*) FILTER (WHERE x.label = 0 AND x.score > v.score) AS above_n
    FROM (SELECT val.method, score, bool_or(w.p = 0) AS h0 FROM val JOIN w ON w.method = val.method AND w.unit_id = val.unit_id GROUP BY 1, 2 UNION SELECT m.method, CAST(0 AS FLOAT), false FROM (VALUES ('a'), ('c')) m(method) WHERE NOT EXISTS (SELECT 1 FROM val WHERE val.method = m.method AND score = 0)) v
    JOIN val x ON x.method = v.method GROUP BY ALL) s JOIN w ON w.method = s.method AND w.unit_id = s.unit_id GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
BUDGETS = "(VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE)) g(fpr_target)"


@register("recall_under_budget", with_sql(PX, LONG, VAL, MASS,
  body=f"""SELECT method, fpr_target, round(CAST(score AS DOUBLE), 9) AS threshold, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM curve, {BUDGETS} WHERE fpr <= fpr_target + 1e-12
  QUALIFY row_number() OVER (PARTITION BY method, fpr_target ORDER BY round(recall, 12) DESC, round(fpr, 12), score DESC) = 1"""))
def recall_under_budget(spark, folder):
    out = C.calibrate_recall(masses(spark, folder), ["method"], (0.01, 0.05, 0.25))
    return tidy(out, ("threshold", "recall", "fpr"))


@register("lowest_threshold", with_sql(PX, LONG, VAL, MASS, body=f"""SELECT method, fpr_target, round(CAST(min(score) AS DOUBLE), 9) AS threshold, round(min_by(fpr, score), 9) AS fpr FROM curve, {BUDGETS} WHERE h0 AND fpr <= fpr_target + 1e-12 GROUP BY 1, 2"""))
def lowest_threshold(spark, folder):
    return tidy(C.calibrate_lowest(masses(spark, folder), ["method"], (0.01, 0.05, 0.25)), ("threshold", "fpr"))


@register("prediction_recipes", SQL["lowest_threshold"].replace("SELECT method, fpr_target, round(CAST(min(score)", "SELECT p.predictor, p.operation, fpr_target, string_agg(method, '+' ORDER BY part) AS components, string_agg(CAST(round(threshold, 6) AS VARCHAR), ';' ORDER BY part) AS thresholds FROM (SELECT method, fpr_target, round(CAST(min(score)")
          + ") JOIN (VALUES ('a', 'single', 0, 'a'), ('c', 'single', 0, 'c'), ('a_and_c', 'AND', 0, 'a'), ('a_and_c', 'AND', 1, 'c')) p(predictor, operation, part, m) ON p.m = method GROUP BY 1, 2, 3")
def prediction_recipes(spark, folder):
    frozen = C.calibrate_lowest(masses(spark, folder), ["method"], (0.01, 0.05, 0.25))
    return D.recipes(frozen, {"a": (("a",), "single"), "c": (("c",), "single"), "a_and_c": (("a", "c"), "AND")})


def negatives(spark, folder):
    """Methods become rows behind the join, which sorts each pixel once."""
    rows = scores(spark, folder).filter("label = 0").join(units(spark, folder).select("unit_id", "building_id"), "unit_id")
    return long_rows(rows, "building_id")


LOFO = """neg AS (SELECT method, building_id, unit_id, score FROM long WHERE label = 0),
  ub AS (SELECT *, count(*) OVER (PARTITION BY method, building_id) AS units FROM (SELECT method, building_id, unit_id, count(*) AS n FROM neg GROUP BY 1, 2, 3)),
  mass AS (SELECT neg.method, neg.building_id, score, sum(1.0::DOUBLE / n / units) AS m FROM neg JOIN ub ON ub.method = neg.method AND ub.unit_id = neg.unit_id GROUP BY 1, 2, 3),
  fold AS (SELECT h.method, h.building_id AS held, m.score, sum(m.m) AS m FROM (SELECT DISTINCT method, building_id FROM mass) h JOIN mass m ON m.method = h.method AND m.building_id <> h.building_id GROUP BY 1, 2, 3),
  curve AS (SELECT f.*, 1 - sum(m) OVER (PARTITION BY method, held ORDER BY score) / b AS fpr, b FROM fold f JOIN (SELECT method, count(DISTINCT building_id) - 1 AS b FROM mass GROUP BY 1) USING (method))"""


@register("held_out_thresholds", with_sql(PX, LONG, LOFO, body="""SELECT method, held AS building_id, goal, any_value(b) AS train_buildings, round(CAST(min(score) AS DOUBLE), 9) AS threshold, round(greatest(0, min_by(fpr, score)), 9) AS achieved_fpr, 'calibrated' AS status
  FROM curve, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE)) g(goal) WHERE fpr <= goal + 1e-12 GROUP BY 1, 2, 3"""))
def held_out_thresholds(spark, folder):
    out = C.lofo_thresholds(negatives(spark, folder), ["method"], (0.01, 0.05, 0.25))
    return tidy(out, ("threshold", "achieved_fpr"))


@register("threshold_lookup", """SELECT c_custkey, c_nationkey AS building_id, c_mktsegment AS method, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'missing' WHEN 'MACHINERY' THEN 'ambiguous' ELSE CASE WHEN c_nationkey % 6 = 0 THEN 'trained_on_heldout' ELSE 'ok' END END AS status,
  CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') AND c_nationkey % 6 <> 0 THEN round(m.v, 6) END AS threshold FROM customer JOIN (SELECT c_mktsegment AS seg, max(c_acctbal) AS v FROM customer GROUP BY 1) m ON seg = c_mktsegment""")
def threshold_lookup(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("building_id"), F.col("c_mktsegment").alias("method"), "c_acctbal")
    frozen = c.groupBy("method").agg(F.max("c_acctbal").alias("threshold")).filter("method != 'HOUSEHOLD'")
    frozen = frozen.unionByName(frozen.filter("method = 'MACHINERY'"))
    training = c.filter("building_id % 6 = 0").select("method", F.col("building_id").alias("train_building"))
    out = C.threshold_lookup(c.drop("c_acctbal"), frozen, training, ["method"])
    return tidy(out, ()).withColumn("threshold", F.round("threshold", 6))


PR = """blk AS (SELECT sequence_id, building_id, score_c AS score, count(*) FILTER (WHERE label = 1) AS p, count(*) AS n FROM px WHERE label IS NOT NULL GROUP BY 1, 2, 3),
  pr AS (SELECT *, cp / tp AS recall, cp / cn AS precision FROM (SELECT *, sum(p) OVER (PARTITION BY sequence_id ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY sequence_id ORDER BY score DESC) AS cn, sum(p) OVER (PARTITION BY sequence_id) AS tp, sum(n) OVER (PARTITION BY sequence_id) AS tn FROM blk) WHERE tp > 0)"""


def curve_rows(spark, folder):
    pixels = scores(spark, folder).join(units(spark, folder).select("unit_id", "sequence_id", "building_id"), "unit_id")
    return C.precision_recall(pixels, ["sequence_id", "building_id"], F.col("score_c"))


@register("average_precision", with_sql(PX, PR, body="SELECT sequence_id, building_id, round(sum(p / tp * precision), 9) AS average_precision, round(max(tp) / max(tn), 9) AS constant_score_ap FROM pr GROUP BY 1, 2"))
def average_precision(spark, folder):
    return tidy(C.average_precision(curve_rows(spark, folder), ["sequence_id", "building_id"]), ("average_precision", "constant_score_ap"))


@register("pr_envelope", with_sql(PX, PR, body="""SELECT building_id, i AS recall_index, round(avg(e), 9) AS precision, count(*) AS units FROM (SELECT building_id, sequence_id, i::INTEGER AS i, max(precision) AS e FROM pr, range(101) r(i) WHERE recall * 100 + 1e-9 >= i GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def pr_envelope(spark, folder):
    return tidy(C.pr_envelope(curve_rows(spark, folder), ["sequence_id"]), ("precision",))


@register("hash_top_units", with_sql(UNITS, body="SELECT split, building_id, unit_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY split, building_id ORDER BY sha256('42/' || unit_id)) AS INTEGER) AS rank FROM units) WHERE rank <= 5"))
def hash_top_units(spark, folder):
    return S.hash_top(units(spark, folder), ["split", "building_id"], ["unit_id"], 5).select("split", "building_id", "unit_id", "rank")


@register("complete_bases", """WITH c AS (SELECT DISTINCT o_custkey AS base, o_orderstatus AS state, o_orderpriority AS scenario FROM orders)
  SELECT base AS base_id FROM c GROUP BY 1 HAVING count(*) = 3 * count(DISTINCT scenario) AND count(DISTINCT state) = 3""")
def complete_bases(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("base_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("scenario")).distinct()
    return S.complete_bases(o, "base_id", {"state": 3, "scenario": None})


def crops(spark, folder):
    return images(spark, folder).select(
        F.col("image_id").alias("crop_id"), F.coalesce("building_id", F.lit("none")).alias("building_id"), F.coalesce("view_id", F.lit("none")).alias("view_id"),
        F.concat(F.lit("r"), (F.col("image_id") % 7).cast("string")).alias("reference_hash"), F.col("sha256").alias("crop_hash"), "split", (F.col("width") / 1700).alias("valid_fraction"),
    )


@register("selected_crops", with_sql(IMAGES, """crops AS (SELECT image_id AS crop_id, coalesce(building_id, 'none') AS building_id, coalesce(view_id, 'none') AS view_id, 'r' || (image_id % 7) AS reference_hash, sha256 AS crop_hash, split, width / 1700 AS vf FROM images),
  fit AS (SELECT *, min(crop_id) OVER (PARTITION BY building_id, crop_hash) AS f, sha256(building_id || '/' || view_id || '/' || reference_hash || '/' || crop_hash) AS h FROM crops WHERE split IN ('train', 'val') AND vf >= 0.3),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY building_id, view_id ORDER BY h) AS rv, row_number() OVER (PARTITION BY building_id, reference_hash ORDER BY h) AS rr FROM fit WHERE crop_id = f),
  r2 AS (SELECT crop_id, CAST(row_number() OVER (PARTITION BY building_id ORDER BY rv, rr, h) AS INTEGER) AS pick FROM r1 QUALIFY pick <= 4)""",
  body="""SELECT c.crop_id, c.building_id, c.split, r2.pick, CASE WHEN c.split NOT IN ('train', 'val') THEN 'outside_requested_split' WHEN c.vf < 0.3 THEN 'below_min_valid_fraction' WHEN fit.f <> c.crop_id THEN 'duplicate_reference_rgb' WHEN r2.pick IS NULL THEN 'crop_budget' END AS reason
  FROM crops c LEFT JOIN fit ON fit.crop_id = c.crop_id LEFT JOIN r2 ON r2.crop_id = c.crop_id"""))
def selected_crops(spark, folder):
    return S.select_crops(cut_lineage(crops(spark, folder)), ["train", "val"], 0.3, 4)


FAMILIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("quick_subset", with_sql(UNITS, f"""one AS (SELECT split, building_id, min_by(sequence_id, sha256('42/' || split || '/' || building_id || '/' || sequence_id)) AS base_id, sha256('42/' || split || '/' || building_id) AS h FROM units WHERE split IN ('val', 'test') GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h) AS r FROM one), q AS (SELECT least(2, nv) AS v0, nt, nv FROM (SELECT count(*) FILTER (WHERE split = 'val') AS nv, count(*) FILTER (WHERE split = 'test') AS nt FROM one)),
  pk AS (SELECT split, building_id, base_id, row_number() OVER (ORDER BY split DESC, r) - 1 AS position FROM rk, q WHERE r <= CASE WHEN split = 'val' THEN least(nv, v0 + 6 - v0 - least(6 - v0, nt)) ELSE least(6 - v0, nt) END),
  fam AS (SELECT DISTINCT sequence_id AS base_id, state AS family, nuisance AS scenario_id FROM units),
  sc AS (SELECT base_id, family, list(scenario_id ORDER BY scenario_id) AS s FROM fam SEMI JOIN pk USING (base_id) GROUP BY 1, 2),
  ch AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY (list_position({list(FAMILIES)!r}, family) - 1 - (2 * position) % 5 + 5) % 5) AS slot FROM pk JOIN sc USING (base_id) QUALIFY slot <= 2)""",
  body="SELECT split, building_id, base_id, CAST(position AS INTEGER) AS position, CAST(slot AS INTEGER) AS slot, family, s[(row_number() OVER (PARTITION BY family ORDER BY position) - 1) % len(s) + 1] AS scenario_id FROM ch"))
def quick_subset(spark, folder):
    u = units(spark, folder)
    bases = u.select(F.col("sequence_id").alias("base_id"), "building_id", "split").distinct()
    cases = u.select(F.col("sequence_id").alias("base_id"), F.col("state").alias("family"), F.col("nuisance").alias("scenario_id"))
    return S.quick_subset(bases, cases, FAMILIES, max_bases=6)


def capacities(spark, folder):
    u = units(spark, folder)
    return u.select(F.col("unit_id").alias("case_id"), "building_id", "scenario", (F.col("sequence_id") % 37).alias("capacity"))


_LEVEL = """SELECT {keys}, max(l) AS lv FROM (SELECT {keys}, l, sum(least(cap, l)) AS used, any_value(budget) AS budget FROM {src}, range(0, {top}) r(l) GROUP BY {keys}, l) WHERE used <= budget GROUP BY {keys}"""


@register("allocated_budget", with_sql(UNITS, "caps AS (SELECT unit_id AS case_id, building_id, scenario, sequence_id % 37 AS capacity FROM units)",
  "cel AS (SELECT building_id, scenario, sum(capacity) AS cap, 1 AS k, 60000 AS budget FROM caps GROUP BY 1, 2)", "lv AS (" + _LEVEL.format(keys="k", src="cel", top=40000).replace("any_value(budget)", "least(any_value(budget), sum(cap))") + ")",
  """sh AS (SELECT c.building_id, c.scenario, least(cap, lv) + CASE WHEN cap > lv AND row_number() OVER (PARTITION BY cap > lv ORDER BY sha256(c.building_id || '/' || c.scenario)) <= (SELECT least(60000, sum(cap)) - sum(least(cap, lv)) FROM cel, lv) THEN 1 ELSE 0 END AS share FROM cel c, lv)""",
  "ca AS (SELECT caps.*, capacity AS cap, share AS budget FROM caps JOIN sh USING (building_id, scenario))", "l2 AS (" + _LEVEL.format(keys="building_id, scenario", src="ca", top=38) + ")",
  "u2 AS (SELECT building_id, scenario, any_value(lv) AS lv, any_value(budget) - sum(least(cap, lv)) AS rest FROM ca JOIN l2 USING (building_id, scenario) GROUP BY 1, 2)",
  body="SELECT case_id, building_id, scenario, capacity, CAST(least(cap, lv) + CASE WHEN cap > lv AND row_number() OVER (PARTITION BY building_id, scenario, cap > lv ORDER BY sha256(CAST(case_id AS VARCHAR))) <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM ca JOIN u2 USING (building_id, scenario)"))
def allocated_budget(spark, folder):
    """The equal-share rule; leftovers go to cells and cases in hash order."""
    return S.allocate_cells(capacities(spark, folder), 60000)


@register("sampled_positions", with_sql(PX, CELLS, body="SELECT unit_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sha256('42/' || unit_id || '/' || pos)) AS r FROM cells) WHERE r <= unit_id % 4"))
def sampled_positions(spark, folder):
    rows = cells(spark, folder).withColumn("wanted", F.col("unit_id") % 4)
    return S.sample_positions(rows, "unit_id", "pos", "wanted").select("unit_id", "pos")


def tiles(spark, folder):
    """8x8 tiles of the grid images with their support, labels and best score."""
    g = grid(spark, folder).withColumn("ty", F.floor(F.col("y") / 8).cast("int")).withColumn("tx", F.floor(F.col("x") / 8).cast("int"))
    changed = F.col("support") & (F.col("old_bits") != 0) & (F.col("new_bits") != 0) & (F.col("old_bits") != F.col("new_bits"))
    return g.groupBy("image_id", "building_id", "split", "ty", "tx").agg(
        F.max(F.col("score").cast("double")).alias("score"), F.count_if(changed).alias("positives"), F.count_if("support").alias("pixels"), F.max("b").alias("peak")
    )


TILE8 = """tile8 AS (SELECT image_id, building_id, split, y // 8 AS ty, x // 8 AS tx, max(CAST(score AS DOUBLE)) AS score, count(*) FILTER (WHERE support AND old_bits <> 0 AND new_bits <> 0 AND old_bits <> new_bits) AS positives,
  count(*) FILTER (WHERE support) AS pixels, max(b) AS peak FROM grid GROUP BY 1, 2, 3, 4, 5)"""


@register("round_robin_tiles", with_sql(GRID, TILE8, body="""SELECT image_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, split, CAST(rnd AS INTEGER) AS round, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rnd, sha256('42/' || building_id || '/' || scenario)) AS pick FROM (
  SELECT *, peak % 3 AS scenario, row_number() OVER (PARTITION BY split, building_id, peak % 3 ORDER BY sha256('42/' || image_id || '/' || ty || '/' || tx)) AS rnd FROM tile8)) WHERE pick <= 40"""))
def round_robin_tiles(spark, folder):
    rows = tiles(spark, folder).withColumn("scenario", F.col("peak") % 3)
    out = S.round_robin_tiles(rows, ["building_id", "scenario"], ["image_id", "ty", "tx"], "split", 40)
    return out.select("image_id", "ty", "tx", "split", "round", "pick")


@register("inspection_coverage", with_sql(GRID, TILE8, body="""SELECT image_id, fraction, count(*) AS tiles, count(*) FILTER (WHERE r <= k) AS selected_tiles, round(sum(CASE WHEN r <= k THEN pixels ELSE 0 END) / sum(pixels), 9) AS pixel_share,
  round(CASE WHEN sum(positives) > 0 THEN sum(CASE WHEN r <= k THEN positives ELSE 0 END) / sum(positives) END, 9) AS recall FROM (SELECT *, greatest(1, ceil(n * fraction)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ty, tx) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM tile8),
  (VALUES (0.05::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) f(fraction)) GROUP BY 1, 2"""))
def inspection_coverage(spark, folder):
    out = S.inspection_coverage(tiles(spark, folder), "image_id", (0.05, 0.3, 0.5))
    return tidy(out, ("pixel_share", "recall"))


@register("gallery_pick", with_sql(PX, PAIRS, """e AS (SELECT unit_id AS case_id, split, building_id, CASE WHEN p > 0 THEN round(tp_a_only / p, 9) ELSE 0 END AS loss, p = 0 AS h0 FROM (SELECT *, tp_both + tp_a_only + tp_b_only + fn_neither AS p FROM pairs)),
  w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY split, building_id ORDER BY loss DESC, h0, case_id) = 1 ORDER BY split, building_id LIMIT 30)""",
  body="""SELECT case_id, building_id, split, loss, CAST(row_number() OVER (ORDER BY stage, CASE WHEN stage = 0 THEN split END, CASE WHEN stage = 0 THEN building_id END, loss DESC, h0, case_id) AS INTEGER) AS pick FROM (SELECT *, 0 AS stage FROM w UNION ALL SELECT *, 1 FROM e WHERE case_id NOT IN (SELECT case_id FROM w)) QUALIFY pick <= 30"""))
def gallery_pick(spark, folder):
    rows = pair_rows(spark, folder)
    p = F.col("tp_both") + F.col("tp_a_only") + F.col("tp_b_only") + F.col("fn_neither")
    entries = rows.select(F.col("unit_id").alias("case_id"), "split", "building_id", F.when(p > 0, F.round(F.col("tp_a_only") / p, 9)).otherwise(0.0).alias("loss"), (p == 0).alias("h0"))
    out = S.gallery_pick(entries, ["split", "building_id"], [F.col("loss").desc(), F.col("h0"), F.col("case_id")], 30)
    return out.select("case_id", "building_id", "split", "loss", "pick")


def building_changes(spark, folder):
    rows = case_rows(spark, folder).filter("method = 'a'")
    return rows.groupBy("sequence_id", "split").agg(F.sum(F.col("tp") + F.col("fn")).alias("changed"))


@register("building_round_robin", with_sql(PX, """s AS (SELECT sequence_id, split, count(*) FILTER (WHERE label = 1) AS changed FROM px GROUP BY 1, 2)""", body="""SELECT sequence_id, split, changed, CAST(row_number() OVER (ORDER BY r, list_position(['test', 'val', 'train'], split)) AS INTEGER) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY changed DESC, sequence_id) AS r FROM s) QUALIFY pick <= 25"""))
def building_round_robin(spark, folder):
    return S.facade_round_robin(building_changes(spark, folder), ("test", "val", "train"), [F.col("changed").desc(), F.col("sequence_id")], 25)


def _nonoverlap_sql():
    """Three greedy rounds spelled out."""
    iou = "CASE WHEN c.parent = p.parent THEN greatest(0, least(c.x, p.x) + 2 - greatest(c.x, p.x)) * greatest(0, least(c.y, p.y) + 2 - greatest(c.y, p.y)) ELSE 0 END"
    ctes = [FRAME_GRID4, RANKED, """rt AS (SELECT sequence_id, a.o AS ty, b.o AS tx, count(*) FILTER (WHERE common) AS cm, count(*) FILTER (WHERE known) AS known_pixels, count(*) FILTER (WHERE changes > 0) AS changed_pixels FROM ranked
      JOIN (VALUES (0), (1), (2)) a(o) ON y >= a.o AND y < a.o + 2 JOIN (VALUES (0), (1), (2)) b(o) ON x >= b.o AND x < b.o + 2 GROUP BY 1, 2, 3),
      r1 AS (SELECT sequence_id || '-' || tx || '-' || ty AS crop_id, sequence_id AS parent, sequence_id % 25 AS building_id, tx AS x, ty AS y, changed_pixels AS cp, known_pixels AS kp FROM rt WHERE cm / 4 >= 0.8 AND known_pixels >= 4 AND changed_pixels > 0)"""]
    for i in (1, 2, 3):
        ctes.append(f"p{i} AS (SELECT *, {i}::INTEGER AS pick FROM r{i} QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY cp DESC, kp DESC, parent, crop_id) = 1)")
        if i < 3:
            ctes.append(f"r{i + 1} AS (SELECT c.* FROM r{i} c JOIN p{i} p ON c.building_id = p.building_id WHERE c.crop_id <> p.crop_id AND ({iou}) / (8 - ({iou})) <= 0.25)")
    return with_sql(*ctes, body="SELECT crop_id, building_id, pick FROM p1 UNION ALL SELECT crop_id, building_id, pick FROM p2 UNION ALL SELECT crop_id, building_id, pick FROM p3")


@register("nonoverlap_pick", _nonoverlap_sql())
def nonoverlap_pick(spark, folder):
    """Up to three non-overlapping crops per building by change count."""
    t = ranked_tiles(spark, folder).filter("reason IS NULL")
    rows = t.select(
        F.concat_ws("-", F.col("sequence_id").cast("string"), "tx", "ty").alias("crop_id"), F.col("sequence_id").alias("parent"), (F.col("sequence_id") % 25).alias("building_id"),
        F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"), "changed_pixels", "known_pixels",
    )
    return S.nonoverlap_pick(rows, "building_id", "parent", F.struct((-F.col("changed_pixels")).alias("a"), (-F.col("known_pixels")).alias("b"), "parent", "crop_id"), 3)


@register("even_spaced_units", with_sql(UNITS, body="""SELECT unit_id, r AS position FROM (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS r, count(*) OVER () AS n FROM units) WHERE r IN (SELECT CAST(floor(j * ((SELECT count(*) FROM units) - 1) / 11) AS BIGINT) FROM range(12) t(j))"""))
def even_spaced_units(spark, folder):
    return S.even_spaced(units(spark, folder).select("unit_id"), "unit_id", F.floor(F.col("unit_id") / 5000), 12)


@register("round_robin_windows", with_sql("RECURSIVE " + GRID, *TRANS, COMPONENT_MODE, """gi AS (SELECT event, from_class, to_class, row_number() OVER (PARTITION BY event ORDER BY from_class, to_class) AS gx FROM (SELECT DISTINCT event, from_class, to_class FROM tc)),
  dp AS (SELECT *, CAST(row_number() OVER (PARTITION BY event, from_class, to_class ORDER BY transition_fraction DESC, image_id, component) AS INTEGER) AS depth FROM tc)""",
  body="SELECT image_id, event, from_class, to_class, component, depth, CAST(row_number() OVER (ORDER BY depth, gx, list_position(['replacement', 'appearance', 'disappearance'], event)) AS INTEGER) AS pick FROM dp JOIN gi USING (event, from_class, to_class) QUALIFY pick <= 60"))
def round_robin_windows(spark, folder):
    out = S.round_robin_windows(transition_candidates(spark, folder), [F.col("transition_fraction").desc(), F.col("image_id"), F.col("component")], 60)
    return out.select("image_id", "event", "from_class", "to_class", "component", "depth", "pick")
