"""Registered queries: grids, geometry, scores, labels and segmentation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftlens.functions import geometry as G
from driftlens.functions import scores as S
from driftlens.operators import decide as D
from driftlens.operators import grid as R
from driftlens.operators import labels as L
from driftlens.operators import registry as V
from driftlens.operators import scoring as C
from driftlens.operators import segmentation as M
from driftlens.operators import transitions as T
from driftlens.plans.fixtures import FRAME_GRID, GRID, IMAGES, PX, frame_grid, grid, images, rounded, scores, table, with_sql
from driftlens.plans.metrics import LGRID, labelled_grid, tidy

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


SIDE, SIZE, STRIDE = 16, 6, 4
ORIGINS = "list_distinct(list_append(range(0, greatest(0, {n} - {s}) + 1, {t}), greatest(0, {n} - {s})))"
TILES = """tiles AS (SELECT image_id, split, width, height, x, y, least({s}, width - x) AS tile_width, least({s}, height - y) AS tile_height FROM (
  SELECT image_id, split, width, height, unnest({ox})::INTEGER AS x, y FROM (
  SELECT image_id, split, width, height, unnest({oy})::INTEGER AS y FROM images)))"""


def tiles_sql(size, stride):
    return TILES.format(s=size, ox=ORIGINS.format(n="width", s=size, t=stride), oy=ORIGINS.format(n="height", s=size, t=stride))


@register("tile_grid", with_sql(IMAGES, tiles_sql(512, 448), body="SELECT image_id, x, y, tile_width, tile_height FROM tiles"))
def tile_grid(spark, folder):
    return R.tile_grid(images(spark, folder), 512, 448).select("image_id", "x", "y", "tile_width", "tile_height")


@register("tile_counts", with_sql(IMAGES, tiles_sql(512, 448), body="SELECT split, count(*) AS tiles FROM tiles GROUP BY split"))
def tile_counts(spark, folder):
    """Closed form; the SQL side counts the materialised grid."""
    counted = images(spark, folder).withColumn("n", G.tile_count(F.col("width"), F.col("height"), 512, 448))
    return counted.groupBy("split").agg(F.sum("n").alias("tiles"))


@register("crop_index", with_sql(IMAGES, tiles_sql(512, 448), body="""SELECT CAST(image_id AS VARCHAR) || '-x' || x || '-y' || y AS crop_id, image_id, split, x, y,
  tile_width AS width, tile_height AS height, 512 - tile_width AS pad_right, 512 - tile_height AS pad_bottom FROM tiles"""))
def crop_index(spark, folder):
    return R.crop_index(images(spark, folder), 512, 448)


@register("tile_ownership", with_sql(IMAGES, tiles_sql(512, 448), body="""SELECT image_id, x, y,
  coalesce(CAST(floor((px + x) / 2) AS INTEGER), x) AS x_from, coalesce(CAST(floor((x + tile_width + nx) / 2) AS INTEGER), x + tile_width) AS x_to,
  coalesce(CAST(floor((py + y) / 2) AS INTEGER), y) AS y_from, coalesce(CAST(floor((y + tile_height + ny) / 2) AS INTEGER), y + tile_height) AS y_to, false AS gap
  FROM (SELECT *, lag(x + tile_width) OVER a AS px, lead(x) OVER a AS nx, lag(y + tile_height) OVER b AS py, lead(y) OVER b AS ny FROM tiles
    WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y))"""))
def tile_ownership(spark, folder):
    owned = R.tile_ownership(R.tile_grid(images(spark, folder), 512, 448))
    return owned.select("image_id", "x", "y", "x_from", "x_to", "y_from", "y_to", "gap")


def sized_grid(spark, folder):
    return grid(spark, folder).withColumn("width", F.lit(SIDE)).withColumn("height", F.lit(SIDE))


COVER = """origins AS (SELECT unnest([0, 4, 8, 10]) AS o), cover AS (SELECT g.*, a.o AS ty, b.o AS tx FROM grid g JOIN origins a ON g.y >= a.o AND g.y < a.o + 6
  JOIN origins b ON g.x >= b.o AND g.x < b.o + 6)"""


@register("tile_valid_fraction", with_sql(GRID, COVER, body="""SELECT image_id, ty, tx, count(*) FILTER (WHERE support) AS supported,
  round(count(*) FILTER (WHERE support) / 36, 9) AS fraction, count(*) FILTER (WHERE support) / 36 >= 0.9 AS kept FROM cover GROUP BY 1, 2, 3"""))
def tile_valid_fraction(spark, folder):
    out = R.tile_support(sized_grid(spark, folder), "image_id", SIZE, STRIDE, 0.9)
    return tidy(out.drop("width", "height"), ("fraction",))


HOMOGRAPHY = (1.1, 0.02, -3.0, 0.01, 0.9, 2.0, 0.0001, 0.0002, 1.0)
_HX = "(1.1 * x + 0.02 * y - 3.0)"
_HY = "(0.01 * x + 0.9 * y + 2.0)"
_HW = "(0.0001 * x + 0.0002 * y + 1.0)"


@register("transformed_points", """SELECT p_partkey, round((1.1::DOUBLE * x + 0.02::DOUBLE * y - 3.0::DOUBLE) / w, 6) AS px, round((0.01::DOUBLE * x + 0.9::DOUBLE * y + 2.0::DOUBLE) / w, 6) AS py, abs(w) < 1e-10 AS horizon
  FROM (SELECT *, 0.0001::DOUBLE * x + 0.0002::DOUBLE * y + 1.0::DOUBLE AS w FROM (SELECT p_partkey, p_size * 10 AS x, p_partkey % 500 AS y FROM part))""")
def transformed_points(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 10).alias("x"), (F.col("p_partkey") % 500).alias("y"))
    x, y, ok = G.transform_point(F.col("x"), F.col("y"), G.homography(*HOMOGRAPHY))
    return part.select("p_partkey", rounded(x, 6).alias("px"), rounded(y, 6).alias("py"), (~ok).alias("horizon"))


_CANVAS = ("""pts AS (SELECT image_id, width, height, list_transform([[-0.5::DOUBLE, -0.5::DOUBLE], [width - 0.5::DOUBLE, -0.5::DOUBLE], [width - 0.5::DOUBLE, height - 0.5::DOUBLE], [-0.5::DOUBLE, height - 0.5::DOUBLE]],
  lambda p: [(1.1::DOUBLE * p[1] + 0.02::DOUBLE * p[2] - 3.0::DOUBLE) / (0.0001::DOUBLE * p[1] + 0.0002::DOUBLE * p[2] + 1.0::DOUBLE), (0.01::DOUBLE * p[1] + 0.9::DOUBLE * p[2] + 2.0::DOUBLE) / (0.0001::DOUBLE * p[1] + 0.0002::DOUBLE * p[2] + 1.0::DOUBLE)]) AS m FROM images)""",
  """box AS (SELECT image_id, CAST(floor(least(-0.5::DOUBLE, list_min(list_transform(m, lambda p: p[1]))) + 0.5 + 1e-9) AS BIGINT) AS "left",
  CAST(floor(least(-0.5::DOUBLE, list_min(list_transform(m, lambda p: p[2]))) + 0.5 + 1e-9) AS BIGINT) AS top,
  CAST(ceil(greatest(width - 0.5::DOUBLE, list_max(list_transform(m, lambda p: p[1]))) + 0.5 - 1e-9) AS BIGINT) AS rgt,
  CAST(ceil(greatest(height - 0.5::DOUBLE, list_max(list_transform(m, lambda p: p[2]))) + 0.5 - 1e-9) AS BIGINT) AS bottom FROM pts)""",
  """canvas AS (SELECT image_id, "left", top, rgt - "left" AS canvas_width, bottom - top AS canvas_height, CASE WHEN greatest(rgt - "left", bottom - top) > 1500 THEN 'unsafe_size' END AS problem FROM box)""")


@register("expanded_canvas", with_sql(IMAGES, *_CANVAS, body="SELECT * FROM canvas"))
def expanded_canvas(spark, folder):
    w, h = F.col("width"), F.col("height")
    canvas = G.expanded_canvas(w, h, w, h, G.homography(*HOMOGRAPHY), max_side=1500)
    return images(spark, folder).select("image_id", *[c.alias(n) for n, c in canvas.items()])


@register("canvas_problems", with_sql(IMAGES, *_CANVAS, """broken AS (SELECT *, CASE image_id % 6 WHEN 1 THEN 'singular' WHEN 2 THEN 'horizon' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'not_finite' END AS fault FROM canvas)""",
  body="""SELECT image_id, CASE WHEN fault IS NULL THEN "left" END AS "left", CASE WHEN fault IS NULL THEN top END AS top, CASE WHEN fault IS NULL THEN canvas_width END AS canvas_width, CASE WHEN fault IS NULL THEN canvas_height END AS canvas_height, coalesce(fault, problem) AS problem FROM broken"""))
def canvas_problems(spark, folder):
    """The same matrix scaled down by 1e12, and singular, horizon, NaN and zero ones."""
    w, h, kind = F.col("width"), F.col("height"), F.col("image_id") % 6
    good = G.homography(*HOMOGRAPHY)
    cell = lambda i, j: (
        F.when(kind == 0, good[i][j] * 1e-12).when(kind == 1, good[0][j] * (i + 1)).when(kind == 2, good[i][j] - F.when(F.lit((i, j) == (2, 2)), 1.01).otherwise(0.0))
        .when(kind == 3, F.when(F.lit((i, j) == (1, 2)), float("nan")).otherwise(good[i][j])).when(kind == 4, F.lit(0.0)).otherwise(good[i][j])
    )
    canvas = G.expanded_canvas(w, h, w, h, [[cell(i, j) for j in range(3)] for i in range(3)], max_side=1500)
    return images(spark, folder).select("image_id", *[c.alias(n) for n, c in canvas.items()])


INVERSE = (1.0, 0.25, -1.5, -0.25, 1.0, 2.25, 0.0, 0.0, 1.0)
_PLACED = """placed AS (SELECT image_id, y, x, x + 0.25::DOUBLE * y - 1.5::DOUBLE AS sx, -0.25::DOUBLE * x + y + 2.25::DOUBLE AS sy FROM grid)"""


@register("nearest_resampling", with_sql(GRID, _PLACED, body="""SELECT p.image_id, p.y, p.x, coalesce(g.old_bits, 0) AS old_bits FROM placed p
  LEFT JOIN grid g ON g.image_id = p.image_id AND g.y = floor(sy + 0.5) AND g.x = floor(sx + 0.5)"""))
def nearest_resampling(spark, folder):
    g = grid(spark, folder)
    return R.resample_nearest(g, g, "image_id", G.homography(*INVERSE), ["old_bits"])


@register("bilinear_resampling", with_sql(GRID, _PLACED, """taps AS (SELECT image_id, y, x, floor(sy) + dy AS ky, floor(sx) + dx AS kx,
  (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
  FROM placed, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))""", body="""SELECT t.image_id, t.y, t.x, round(sum(w * g.r), 9) AS r, round(sum(w * g.g), 9) AS g,
  round(sum(w), 9) AS coverage, sum(w) >= 1 - 1e-6 AS support FROM taps t JOIN grid g ON g.image_id = t.image_id AND g.y = ky AND g.x = kx WHERE w > 0 GROUP BY 1, 2, 3"""))
def bilinear_resampling(spark, folder):
    g = grid(spark, folder)
    return tidy(R.resample_bilinear(g, g, "image_id", G.homography(*INVERSE), ["r", "g"]), ("r", "g", "coverage"))


@register("gathered_masks", with_sql(GRID, body="""SELECT a.image_id, a.y, a.x, a.score > CAST(0.7 AS FLOAT) OR coalesce(b.score > CAST(0.4 AS FLOAT), false) AS mask
  FROM grid a LEFT JOIN grid b ON b.image_id = a.image_id AND a.y - 1.5 >= 0 AND b.y = floor(a.y - 1.5) AND b.x = floor(a.x + 0.75)"""))
def gathered_masks(spark, folder):
    g = grid(spark, folder)
    ref = g.select("image_id", "y", "x", D.above(F.col("score"), 0.7).alias("mask"), (F.col("y") - 1.5).alias("cy"), (F.col("x") + 0.75).alias("cx"))
    return R.gather_or(ref, g.select("image_id", "y", "x", D.above(F.col("score"), 0.4).alias("mask")), "image_id")


@register("shifted_maps", with_sql(GRID, body="SELECT image_id, y - 2 AS y, x + 3 AS x, old_bits FROM grid WHERE y - 2 >= 0 AND x + 3 < 16"))
def shifted_maps(spark, folder):
    return R.shift(grid(spark, folder), 3, -2, SIDE, SIDE).select("image_id", "y", "x", "old_bits")


@register("dilated_mask", with_sql(GRID, body="""SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM grid, (SELECT unnest(range(-2, 3))::INTEGER AS dy) a,
  (SELECT unnest(range(-2, 3))::INTEGER AS dx) b WHERE score > CAST(0.9 AS FLOAT) AND y + dy BETWEEN 0 AND 15 AND x + dx BETWEEN 0 AND 15"""))
def dilated_mask(spark, folder):
    return R.shift(R.dilate(grid(spark, folder).filter(D.above(F.col("score"), 0.9)), "image_id", 2), 0, 0, SIDE, SIDE)


@register("positive_boundary", with_sql(GRID, LGRID, body="""SELECT image_id, y, x FROM lgrid a WHERE label = 1 AND EXISTS (SELECT 1 FROM lgrid b
  WHERE b.image_id = a.image_id AND b.label = 0 AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1)"""))
def positive_boundary(spark, folder):
    return R.boundary(labelled_grid(spark, folder), "image_id").select("image_id", "y", "x")


@register("crop_overlap", """SELECT l_orderkey, l_linenumber, l_partkey, round(max(shared / (a + b - shared)), 9) AS iou, round(max(shared / greatest(1, least(a, b))), 9) AS containment FROM (
  SELECT *, 60 * 40 AS a, (20 + l_linenumber * 5) * 50 AS b, greatest(0, least(60, x + 20 + l_linenumber * 5) - greatest(0, x)) * greatest(0, least(40, y + 50) - greatest(0, y)) AS shared
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS x, CAST(l_partkey % 40 AS INTEGER) AS y FROM lineitem)) GROUP BY 1, 2, 3""")
def crop_overlap(spark, folder):
    """Overlap of every crop with its parent's anchor crop; one row per stored pair."""
    line = table(spark, folder, "lineitem")
    a = [F.lit(v) for v in (0, 0, 60, 40)]
    b = [F.col("l_quantity").cast("int"), (F.col("l_partkey") % 40).cast("int"), 20 + F.col("l_linenumber") * 5, F.lit(50)]
    return line.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        rounded(F.max(G.box_iou(a, b))).alias("iou"), rounded(F.max(G.box_containment(a, b))).alias("containment")
    )


def component_mask(spark, folder):
    return grid(spark, folder).filter(D.above(F.col("score"), 0.65)).select("image_id", "y", "x")


@register("connected_components", with_sql("RECURSIVE " + GRID, "m AS MATERIALIZED (SELECT image_id, y, x, y * 2147483648 + x AS id FROM grid WHERE score > CAST(0.65 AS FLOAT))",
  "edges AS MATERIALIZED (SELECT a.image_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)",
  "reach AS (SELECT image_id, id AS a, id AS b FROM m UNION SELECT r.image_id, r.a, e.b FROM reach r JOIN edges e ON e.image_id = r.image_id AND e.a = r.b)",
  body="""SELECT image_id, component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy
  FROM (SELECT image_id, a AS id, min(b) AS component FROM reach GROUP BY 1, 2) JOIN m USING (image_id, id) GROUP BY 1, 2"""))
def connected_components(spark, folder):
    stats = R.component_stats(R.connected_components(component_mask(spark, folder), ["image_id"], block=8), ["image_id"])
    return tidy(stats, ("cx", "cy"))


def run_annotations(spark, folder):
    """Column-major runs on a 12-row canvas; class = line number, crowd = ship status F with large quantity."""
    line = table(spark, folder, "lineitem")
    return line.select(
        F.xxhash64(*line.columns).alias("annotation_id"), F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("channel"),
        F.when((F.col("l_quantity") > 48) & (F.col("l_linestatus") == "F"), 1).otherwise(0).alias("iscrowd"), F.lit(12).alias("height"),
        F.array((F.col("l_partkey") % 90).cast("int"), F.col("l_quantity").cast("int") % 9, (F.col("l_partkey") % 11).cast("int"), F.lit(4)).alias("counts"),
    )


@register("rasterized_runs", """WITH a AS (SELECT l_suppkey AS image_id, l_linenumber - 1 AS channel, l_quantity > 48 AND l_linestatus = 'F' AS crowd,
    CAST(l_partkey % 90 AS INTEGER) AS s, CAST(l_quantity AS INTEGER) % 9 AS n, CAST(l_partkey % 11 AS INTEGER) AS g FROM lineitem),
  p AS (SELECT image_id, channel, crowd, unnest(range(s, s + n)) AS p FROM a UNION ALL SELECT image_id, channel, crowd, unnest(range(s + n + g, s + n + g + 4)) FROM a)
  SELECT image_id, CAST(p % 12 AS INTEGER) AS y, CAST(p // 12 AS INTEGER) AS x,
    CASE WHEN bool_or(crowd) THEN 0 ELSE bit_or(CASE WHEN crowd THEN 0 ELSE CAST(1 << channel AS INTEGER) END) END AS bits FROM p GROUP BY 1, 2, 3""")
def rasterized_runs(spark, folder):
    return R.rasterize_runs(run_annotations(spark, folder))


def owned_tiles(spark, folder):
    ids = grid(spark, folder).select("image_id").distinct().withColumn("width", F.lit(SIDE)).withColumn("height", F.lit(SIDE))
    return R.tile_ownership(R.tile_grid(ids, SIZE, STRIDE))


@register("stitched_tiles", with_sql(GRID, COVER, """spans AS (SELECT * FROM (VALUES (0, 0, 5), (4, 5, 9), (8, 9, 12), (10, 12, 16)) s(o, a, b))""",
  body="""SELECT image_id, y, x, bit_or(CAST(1 << ((x + y + ty) % 5) AS INTEGER)) AS bits FROM cover JOIN spans sy ON sy.o = ty JOIN spans sx ON sx.o = tx
  WHERE y >= sy.a AND y < sy.b AND x >= sx.a AND x < sx.b GROUP BY 1, 2, 3"""))
def stitched_tiles(spark, folder):
    predicted = R.cover(sized_grid(spark, folder), SIZE, STRIDE).withColumn("channel", ((F.col("x") + F.col("y") + F.col("ty")) % 5).cast("int"))
    return R.stitch(predicted, owned_tiles(spark, folder))


@register("uncovered_pixels", with_sql(GRID, body="SELECT image_id, y, x FROM grid WHERE image_id % 7 = 0 AND y >= 9"))
def uncovered_pixels(spark, folder):
    """Every seventh image lacks its lower tiles; their pixels are reported."""
    owned = owned_tiles(spark, folder).filter("image_id % 7 != 0 OR y < 8")
    predicted = R.cover(sized_grid(spark, folder), SIZE, STRIDE).withColumn("channel", F.lit(0))
    return R.uncovered(grid(spark, folder), R.stitch(predicted, owned)).select("image_id", "y", "x")


RGB = (("r", "g", "b"), ("s_r", "s_g", "s_b"))


@register("rgb_difference", with_sql(GRID, body="SELECT image_id, y, x, round((abs(s_r - r) + abs(s_g - g) + abs(s_b - b)) / 765.0::DOUBLE, 9) AS score FROM grid"))
def rgb_difference(spark, folder):
    return grid(spark, folder).select("image_id", "y", "x", rounded(S.rgb_difference([F.col(c) for c in RGB[0]], [F.col(c) for c in RGB[1]])).alias("score"))


@register("residuals", with_sql(GRID, body="SELECT image_id, y, x, abs(s_b - b) AS absolute, ((s_b - b) % 256 + 256) % 256 AS modular FROM grid"))
def residuals(spark, folder):
    return grid(spark, folder).select("image_id", "y", "x", S.residual(F.col("b"), F.col("s_b"), "abs").alias("absolute"), S.residual(F.col("b"), F.col("s_b"), "mod256").alias("modular"))


def _ssim_sql():
    kernel = [float(k) for k in C.gaussian_kernel()]
    values = ", ".join(f"({i - 5}, {k!r}::DOUBLE)" for i, k in enumerate(kernel))
    moments, terms = [], []
    for i, (r, s) in enumerate(zip(*RGB)):
        x, y = f"({r} / 255.0::DOUBLE)", f"({s} / 255.0::DOUBLE)"
        moments += [f"{x} AS x{i}", f"{y} AS y{i}", f"{x} * {x} AS xx{i}", f"{y} * {y} AS yy{i}", f"{x} * {y} AS xy{i}"]
    names = ["m", "d"] + [f"{t}{i}" for i in range(3) for t in ("x", "y", "xx", "yy", "xy")]
    sums = ", ".join(f"sum({n} * k) AS {n}" for n in names)
    stats = ", ".join(
        f"x{i} / m AS mx{i}, y{i} / m AS my{i}, greatest(0, xx{i} / m - (x{i} / m) * (x{i} / m)) AS vx{i}, greatest(0, yy{i} / m - (y{i} / m) * (y{i} / m)) AS vy{i}, xy{i} / m - (x{i} / m) * (y{i} / m) AS c{i}"
        for i in range(3)
    )
    for i in range(3):
        cov = f"greatest(-sqrt(vx{i} * vy{i}), least(sqrt(vx{i} * vy{i}), c{i}))"
        terms.append(f"(2 * mx{i} * my{i} + 0.0001::DOUBLE) * (2 * {cov} + 0.0009::DOUBLE) / ((mx{i} * mx{i} + my{i} * my{i} + 0.0001::DOUBLE) * (vx{i} + vy{i} + 0.0009::DOUBLE))")
    return with_sql(GRID, f"k(d0, k) AS (VALUES {values})",
        f"base AS (SELECT image_id, y, x, 1.0::DOUBLE AS m, CASE WHEN r <> s_r OR g <> s_g OR b <> s_b THEN 1.0::DOUBLE ELSE 0 END AS d, {', '.join(moments)} FROM grid WHERE support)",
        f"ax AS (SELECT image_id, y, x + d0 AS x, {sums} FROM base, k GROUP BY 1, 2, 3)", f"ay AS (SELECT image_id, y + d0 AS y, x, {sums} FROM ax, k GROUP BY 1, 2, 3)",
        f"st AS (SELECT image_id, y, x, d, {stats} FROM ay SEMI JOIN base USING (image_id, y, x))",
        body=f"SELECT image_id, y, x, round(CASE WHEN d = 0 THEN 0 ELSE greatest(0, least(1, (1 - ({' + '.join(terms)}) / 3) / 2)) END, 6) AS score FROM st")


@register("ssim_change", _ssim_sql())
def ssim_change(spark, folder):
    out = C.ssim_change(grid(spark, folder), "image_id", *RGB)
    return out.select("image_id", "y", "x", rounded("score", 6).alias("score"))


def residual_pixels(spark, folder):
    cols = [S.residual(F.col(r), F.col(s), "mod256").alias(f"d_{r}") for r, s in zip(*RGB)]
    return grid(spark, folder).select("image_id", "y", "x", "support", *cols)


def _local_range(planes, support):
    """Largest neighbour difference in a 3x3 window, as a user-defined tile scorer."""
    import numpy as np

    value = np.where(support, planes["r"], np.nan)
    padded = np.pad(value, 1, constant_values=np.nan)
    h, w = value.shape
    shifts = np.stack([padded[dy:dy + h, dx:dx + w] for dy in range(3) for dx in range(3)])
    return np.nanmax(np.abs(np.where(np.isnan(shifts), value, shifts) - value), axis=0, initial=0.0)


@register("registered_scorers", with_sql(GRID, body="""SELECT 'rgb_difference' AS scorer, count(*) AS pixels, round(sum((abs(s_r - r) + abs(s_g - g) + abs(s_b - b)) / 765.0::DOUBLE), 6) AS total FROM grid WHERE support
  UNION ALL SELECT 'local_range', count(*), round(sum(d), 6) FROM (SELECT a.image_id, a.y, a.x, max(abs(a.r - b.r))::DOUBLE AS d FROM grid a JOIN grid b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.support AND b.support GROUP BY 1, 2, 3)"""))
def registered_scorers(spark, folder):
    """A built-in scorer by name and a user's tile function with a one-cell halo."""
    g = grid(spark, folder)
    named = V.score_pixels("rgb_difference", g, "image_id", *RGB).select("score", F.lit("rgb_difference").alias("scorer"))
    custom = V.tile_scores(g, "image_id", ["r"], _local_range, size=8, halo=1).select("score", F.lit("local_range").alias("scorer"))
    return named.unionByName(custom).groupBy("scorer").agg(F.count("*").alias("pixels"), rounded(F.sum("score"), 6).alias("total"))


@register("score_scales", "SELECT p_partkey, round(1 - exp(-p_size / 8.0::DOUBLE), 9) AS compressed, round(p_size / (1.0::DOUBLE + p_size), 9) AS distance FROM part")
def score_scales(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", rounded(S.compressed_scale(F.col("p_size"))).alias("compressed"), rounded(S.distance_scale(F.col("p_size"))).alias("distance")
    )


def feature_pairs(spark, folder):
    """Each vector against its successor id, an equi-join."""
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id")


@register("cosine_change", """SELECT a.vec_id, round((1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) / 2, 9) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_change(spark, folder):
    return feature_pairs(spark, folder).select("vec_id", rounded(S.cosine_change(F.col("embedding"), F.col("other"))).alias("score"))


@register("probability_change", """SELECT a.vec_id, round(list_max(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(abs(z[1]) - abs(z[2])))), 9) AS change,
  round(list_avg(list_transform(a.embedding::DOUBLE[], lambda p: CASE WHEN p = 0 OR abs(p) >= 1 THEN 0 ELSE -(abs(p) * log2(abs(p)) + (1 - abs(p)) * log2(1 - abs(p))) END)), 9) AS entropy
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def probability_change(spark, folder):
    """Absolute vector entries stand in for class probabilities."""
    p, q = (F.transform(c, lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")))) for c in ("embedding", "other"))
    return feature_pairs(spark, folder).select("vec_id", rounded(S.probability_change(p, q)).alias("change"), rounded(S.bernoulli_entropy(p)).alias("entropy"))


@register("context_windows", with_sql(GRID, body="""SELECT image_id, y, x, coalesce(array_to_string(list_transform(list_filter(ctx, lambda c: c.x > coalesce(list_max(list_transform(list_filter(ctx, lambda q: NOT q.s), lambda q: q.x)), -1)), lambda c: c.v), ','), '') AS context FROM (
  SELECT *, list({'x': x, 's': support, 'v': b}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ctx FROM grid) WHERE support"""))
def context_windows(spark, folder):
    out = C.context_windows(grid(spark, folder), ["image_id", "y"], ["x"], "b", "support", 4)
    return out.select("image_id", "y", "x", F.array_join(F.transform("context", lambda v: v.cast("string")), ",").alias("context"))


def _affine_sql():
    """Three unrolled trimming rounds."""
    ctes = [GRID, "p AS (SELECT building_id, CAST(g AS DOUBLE) AS x, CAST(s_g AS DOUBLE) AS y FROM grid)",
            "f0 AS (SELECT building_id, 1.0::DOUBLE AS gain, quantile_cont(y - x, 0.5) AS off FROM p GROUP BY 1)"]
    for i in range(3):
        ctes.append(f"e{i} AS (SELECT p.*, gain, round(abs(y - (gain * x + off)), 9) AS e FROM p JOIN f{i} USING (building_id))")
        ctes.append(f"q{i} AS (SELECT building_id, quantile_cont(e, 0.75) AS lim FROM e{i} GROUP BY 1)")
        ctes.append(f"s{i} AS (SELECT building_id, any_value(gain) AS g0, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c FROM e{i} JOIN q{i} USING (building_id) WHERE e <= lim + 1e-9 GROUP BY 1)")
        ctes.append(f"f{i + 1} AS (SELECT building_id, gain, greatest(-255, least(255, my - gain * mx)) AS off FROM (SELECT *, CASE WHEN v > 1e-12 THEN greatest(0, least(4, c / v)) ELSE g0 END AS gain FROM s{i}))")
    return with_sql(*ctes, body="SELECT building_id, round(gain, 6) AS gain, round(off, 6) AS \"offset\" FROM f3")


@register("robust_affine", _affine_sql())
def robust_affine(spark, folder):
    fit = C.robust_affine(grid(spark, folder), ["building_id"], "g", "s_g")
    return fit.select("building_id", rounded("gain", 6).alias("gain"), rounded("offset", 6).alias("offset"))


@register("score_diagnostics", with_sql(PX, body="""SELECT unit_group, min(score_c) AS low, max(score_c) AS high, count(DISTINCT score_c) AS distinct_values, round(avg(CASE WHEN score_c > 0 THEN 1.0 ELSE 0.0 END), 9) AS positive_share,
  round(quantile_cont(score_c::DOUBLE, 0.01), 9) AS p1, round(quantile_cont(score_c::DOUBLE, 0.5), 9) AS median, round(quantile_cont(score_c::DOUBLE, 0.99), 9) AS p99 FROM (SELECT unit_id % 5 AS unit_group, score_c FROM px) GROUP BY 1"""))
def score_diagnostics(spark, folder):
    rows = scores(spark, folder).withColumn("unit_group", F.col("unit_id") % 5)
    return tidy(C.score_diagnostics(rows, ["unit_group"], "score_c"), ("p1", "median", "p99", "positive_share"))


@register("score_contract", with_sql(PX, body="""SELECT unit_id % 20 AS unit_group, count(*) FILTER (WHERE support AND s IS NOT NULL AND (s < 0 OR s > 1)) AS out_of_range,
  count(*) FILTER (WHERE support AND s IS NULL) AS missing_in_support, count(*) FILTER (WHERE NOT support AND s IS NOT NULL) AS defined_off_support
  FROM (SELECT *, CASE WHEN pos <> 2 THEN score_a * 1.05::FLOAT END AS s FROM px) GROUP BY 1"""))
def score_contract(spark, folder):
    rows = scores(spark, folder).withColumn("unit_group", F.col("unit_id") % 20).withColumn("s", F.when(F.col("pos") != 2, F.col("score_a") * F.lit(1.05).cast("float")))
    return C.contract_violations(rows, ["unit_group"], F.col("s"), F.col("support"))


@register("derived_labels", with_sql(GRID, LGRID, body="SELECT image_id, y, x, label FROM lgrid"))
def derived_labels(spark, folder):
    return labelled_grid(spark, folder).select("image_id", "y", "x", "label")


@register("tolerant_labels", with_sql(GRID, """near AS (SELECT image_id, y + dy AS y, x + dx AS x, bit_or(old_bits) AS o, bit_or(new_bits) AS n FROM grid,
  (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) GROUP BY 1, 2, 3)""", body="""SELECT image_id, y, x,
  CASE WHEN support AND old_bits <> 0 AND new_bits <> 0 THEN CASE WHEN old_bits = new_bits THEN 0 WHEN (new_bits & ~o) <> 0 OR (old_bits & ~n) <> 0 THEN 1 END END AS label
  FROM grid JOIN near USING (image_id, y, x)"""))
def tolerant_labels(spark, folder):
    return L.tolerant_labels(grid(spark, folder), "image_id", 1).select("image_id", "y", "x", "label")


def _mode_sql(mode):
    before = "first_value(bits)" if mode == "earliest" else "lag(bits)"
    target = "earliest_state" if mode == "earliest" else "step_event"
    return f"""SELECT '{mode}' AS mode, '{target}' AS target, frame, count(*) FILTER (WHERE before <> bits) AS positives, count(*) FILTER (WHERE before = bits) AS negatives
      FROM (SELECT *, {before} OVER w AS before, row_number() OVER w AS n FROM fgrid WINDOW w AS (PARTITION BY sequence_id, y, x ORDER BY frame)) WHERE n > 1 GROUP BY ALL"""


@register("mode_labels", with_sql(FRAME_GRID, body=" UNION ALL ".join(_mode_sql(m) for m in ("previous", "earliest", "history"))))
def mode_labels(spark, folder):
    f = frame_grid(spark, folder)
    rows = D.union_all([L.mode_labels(f, "sequence_id", m) for m in ("previous", "earliest", "history")])
    return rows.groupBy("mode", "target", "frame").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def pair_stats(spark, folder):
    return L.pair_statistics(labelled_grid(spark, folder), ["image_id", "building_id"], 7, F.lit(SIDE * SIDE).cast("bigint"))


PSTATS = """pstats AS (SELECT image_id, building_id, -1 AS channel, count(*) FILTER (WHERE support) AS support_pixels, count(*) FILTER (WHERE label IS NOT NULL) AS roi,
  count(*) FILTER (WHERE label = 1) AS changed, CAST(0 AS BIGINT) AS gain, CAST(0 AS BIGINT) AS loss FROM lgrid GROUP BY 1, 2
  UNION ALL SELECT image_id, building_id, c, count(*) FILTER (WHERE support), count(*) FILTER (WHERE label IS NOT NULL AND (o OR n)), count(*) FILTER (WHERE label IS NOT NULL AND o <> n),
    count(*) FILTER (WHERE label IS NOT NULL AND n AND NOT o), count(*) FILTER (WHERE label IS NOT NULL AND o AND NOT n)
  FROM (SELECT *, (old_bits >> c) & 1 = 1 AS o, (new_bits >> c) & 1 = 1 AS n FROM lgrid, (SELECT unnest(range(7))::INTEGER AS c)) GROUP BY 1, 2, 3)"""


@register("pair_statistics", with_sql(GRID, LGRID, PSTATS, body="""SELECT image_id, building_id, channel, support_pixels, CAST(256 AS BIGINT) AS total_pixels, roi, changed, gain, loss, roi - changed AS stable,
  round(CASE WHEN roi > 0 THEN 100 * changed / roi END, 9) AS changed_known_percent, round(100 * changed / 256, 9) AS changed_crop_percent, round(100 * roi / 256, 9) AS coverage_percent FROM pstats"""))
def pair_statistics(spark, folder):
    return tidy(pair_stats(spark, folder), ("changed_known_percent", "changed_crop_percent", "coverage_percent"))


@register("cutoff_sweep", with_sql(GRID, LGRID, PSTATS, body="""SELECT channel, denominator, cutoff, count(*) FILTER (WHERE ok) AS pairs, count(DISTINCT building_id) FILTER (WHERE ok) AS buildings FROM (
  SELECT *, roi > 0 AND 100 * changed >= cutoff * CASE WHEN denominator = 'known' THEN roi ELSE 256 END AS ok
  FROM pstats, (VALUES ('known'), ('crop')) d(denominator), (VALUES (0), (1), (5), (10), (15), (20), (30), (50)) t(cutoff)) GROUP BY 1, 2, 3"""))
def cutoff_sweep(spark, folder):
    return L.cutoff_sweep(pair_stats(spark, folder))


@register("change_summary", with_sql(GRID, LGRID, body="""SELECT image_id, count(*) FILTER (WHERE label = 1) AS positive_pixels, count(*) FILTER (WHERE label = 0) AS negative_pixels,
  count(*) FILTER (WHERE label IS NULL) AS ignored_pixels, count(*) FILTER (WHERE support) AS geometric_pixels,
  array_to_string(list_filter(range(7), lambda c: (bit_or(CASE WHEN label = 1 THEN xor(old_bits, new_bits) ELSE 0 END) >> c::INTEGER) & 1 = 1), ',') AS changed_channels,
  CASE WHEN count(*) FILTER (WHERE support) = 0 THEN 'no_common_support' WHEN least(max(y) - min(y), max(x) - min(x)) + 1 < 8 THEN 'side_below_8' END AS exclusion FROM lgrid GROUP BY 1"""))
def change_summary(spark, folder):
    return L.change_summary(labelled_grid(spark, folder), ["image_id"], 7)


@register("task_labels", with_sql(GRID, LGRID, body="""SELECT hypothesis, condition, count(*) FILTER (WHERE t = 1) AS positives, count(*) FILTER (WHERE t = 0) AS negatives, count(*) FILTER (WHERE t IS NULL) AS ignored FROM (
  SELECT k.*, CASE WHEN k.hypothesis = 'H1' THEN label WHEN support THEN 0 END AS t FROM lgrid, (VALUES ('H1', 'original'), ('H1', 'exposure'), ('H1', 'shadow'), ('H0', 'exposure'), ('H0', 'shadow')) k(hypothesis, condition)) GROUP BY 1, 2"""))
def task_labels(spark, folder):
    t = F.col("task_label")
    return L.task_labels(labelled_grid(spark, folder)).groupBy("hypothesis", "condition").agg(
        F.count_if(t == 1).alias("positives"), F.count_if(t == 0).alias("negatives"), F.count_if(t.isNull()).alias("ignored")
    )


def ranked_pixels(spark, folder):
    f = frame_grid(spark, folder, side=4)
    counts = f.groupBy("sequence_id").agg(F.countDistinct("frame").alias("frame_count"))
    return L.rank_views(f, "sequence_id", counts)


RANKED = """ranked AS (SELECT sequence_id, y, x, n = fc AS common, CASE WHEN n = fc THEN ch ELSE 0 END AS changes, n = fc AND kn AS known FROM (
  SELECT sequence_id, y, x, count(*) AS n, count(*) FILTER (WHERE p <> bits) AS ch, count(p) > 0 AS kn FROM (
    SELECT *, lag(bits) OVER (PARTITION BY sequence_id, y, x ORDER BY frame) AS p FROM fgrid) GROUP BY 1, 2, 3)
  JOIN (SELECT sequence_id, count(DISTINCT frame) AS fc FROM fgrid GROUP BY 1) USING (sequence_id))"""
FRAME_GRID4 = FRAME_GRID.replace("// 8) % 8", "// 4) % 4").replace("l_partkey % 8", "l_partkey % 4")


@register("ranked_views", with_sql(FRAME_GRID4, RANKED, body="""SELECT sequence_id, count(*) FILTER (WHERE common) AS common_pixels, count(*) FILTER (WHERE known) AS known_pixels,
  count(*) FILTER (WHERE changes > 0) AS changed_pixels, CAST(sum(changes) AS BIGINT) AS change_observations FROM ranked GROUP BY 1"""))
def ranked_views(spark, folder):
    return ranked_pixels(spark, folder).groupBy("sequence_id").agg(
        F.count_if("common").alias("common_pixels"), F.count_if("known").alias("known_pixels"),
        F.count_if(F.col("changes") > 0).alias("changed_pixels"), F.sum("changes").alias("change_observations"),
    )


@register("ranked_tiles", with_sql(FRAME_GRID4, RANKED, body="""SELECT *, CASE WHEN common_pixels / 4 < 0.8 THEN 'low_common_support' WHEN known_pixels < 4 THEN 'too_few_known_pixels' WHEN changed_pixels = 0 THEN 'no_annotated_change' END AS reason FROM (
  SELECT sequence_id, a.o AS ty, b.o AS tx, count(*) FILTER (WHERE common) AS common_pixels, count(*) FILTER (WHERE known) AS known_pixels, count(*) FILTER (WHERE changes > 0) AS changed_pixels,
  CAST(sum(changes) AS BIGINT) AS change_observations FROM ranked JOIN (VALUES (0), (1), (2)) a(o) ON y >= a.o AND y < a.o + 2 JOIN (VALUES (0), (1), (2)) b(o) ON x >= b.o AND x < b.o + 2 GROUP BY 1, 2, 3)"""))
def ranked_tiles(spark, folder):
    return L.rank_tiles(ranked_pixels(spark, folder), "sequence_id", 2, 1, 4, 0.8, 4)


def reach_sql(name, members):
    """Components of ``members`` (image, layer, position) as rows with the least position of each."""
    layer = "image_id, event, from_class, to_class"
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in layer.split(", "))
    return (
        f"{name}_edges AS MATERIALIZED (SELECT {', '.join('a.' + c for c in layer.split(', '))}, a.id AS a, b.id AS b FROM {members} a JOIN {members} b ON {same('a', 'b')} AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)",
        f"{name}_reach AS (SELECT {layer}, id AS a, id AS b FROM {members} UNION SELECT {', '.join('r.' + c for c in layer.split(', '))}, r.a, e.b FROM {name}_reach r JOIN {name}_edges e ON {same('e', 'r')} AND e.a = r.b)",
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT {layer}, a AS id, min(b) AS component FROM {name}_reach GROUP BY 1, 2, 3, 4, 5) JOIN {members} USING ({layer}, id))",
    )


_LAYER = "image_id, event, from_class, to_class"
TRANS = ("near AS (SELECT image_id, y + dy AS y, x + dx AS x, bit_or(old_bits) AS o, bit_or(new_bits) AS n FROM grid, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) GROUP BY 1, 2, 3)",
  "known AS MATERIALIZED (SELECT g.*, new_bits & ~old_bits AS gain, old_bits & ~new_bits AS loss, new_bits & ~o AS sure_gain, old_bits & ~n AS sure_loss FROM grid g JOIN near USING (image_id, y, x) WHERE support AND old_bits <> 0 AND new_bits <> 0)",
  "cl AS (SELECT unnest(range(7))::INTEGER AS c)",
  """raw AS MATERIALIZED (SELECT image_id, y, x, y * 2147483648 + x AS id, 'appearance' AS event, -1 AS from_class, c AS to_class, (sure_gain >> c) & 1 = 1 AS robust FROM known, cl WHERE (gain >> c) & 1 = 1
    UNION ALL SELECT image_id, y, x, y * 2147483648 + x, 'disappearance', c, -1, (sure_loss >> c) & 1 = 1 FROM known, cl WHERE (loss >> c) & 1 = 1
    UNION ALL SELECT image_id, y, x, y * 2147483648 + x, 'replacement', a.c, b.c, (sure_loss >> a.c) & 1 = 1 AND (sure_gain >> b.c) & 1 = 1 FROM known, cl a, cl b WHERE (loss >> a.c) & 1 = 1 AND (gain >> b.c) & 1 = 1)""",
  "m AS MATERIALIZED (SELECT * FROM raw WHERE robust)", *reach_sql("rc", "m"), *reach_sql("pc", "raw"),
  f"st AS (SELECT {_LAYER}, component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(x) AS cx, avg(y) AS cy FROM rc GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2)")


def inside(rows, box, where):
    """Pixels of ``rows`` in a box of the outer row."""
    y0, x0, y1, x1 = (f"{box}{c}" for c in ("y0", "x0", "y1", "x1"))
    return f"(SELECT count(*) FROM {rows} k WHERE {where} AND k.y >= {y0} AND k.y < {y1} AND k.x >= {x0} AND k.x < {x1})"


_SAME = " AND ".join(f"k.{c} = t.{c}" for c in _LAYER.split(", "))
_PARENT = f"(SELECT p.component FROM pc p WHERE {_SAME.replace('k.', 'p.')} AND p.id = t.component)"
_CROPS = f"""crops AS (SELECT t.*, {inside('known', 't.crop_', 'k.image_id = t.image_id')} AS common_pixels, {inside('rc', 't.crop_', _SAME + ' AND k.component = t.component')} AS candidate_pixels,
    {inside('pc', 't.crop_', _SAME + f' AND k.component = {_PARENT}')} AS raw_pixels, {inside('pc', 't.crop_', _SAME + f' AND k.component = {_PARENT} AND NOT k.robust')} AS ignored_boundary_pixels FROM tc t)"""
_CROP_BODY = "SELECT *, raw_pixels - ignored_boundary_pixels - candidate_pixels AS other_robust_pixels FROM crops"
COMPONENT_MODE = f"""cand AS (SELECT *, {inside('known', 't.', 'k.image_id = t.image_id')} / ((x1 - x0) * (y1 - y0)) AS sf, area / ((x1 - x0) * (y1 - y0)) AS tf FROM st t),
  tc AS (SELECT {_LAYER}, component, area, x0, y0, x1, y1, round(sf, 9) AS support_fraction, round(tf, 9) AS transition_fraction, greatest(0, x0 - 3) AS crop_x0, greatest(0, y0 - 3) AS crop_y0, least(16, x1 + 3) AS crop_x1, least(16, y1 + 3) AS crop_y1 FROM cand WHERE sf >= 0.5 AND tf >= 0.5)"""
WINDOW_MODE = f"""wide AS (SELECT {_LAYER}, component, area, size AS window_size, least(greatest(0, CAST(round_even(cx - (size - 1) / 2, 0) AS INTEGER)), 16 - size) AS x0, least(greatest(0, CAST(round_even(cy - (size - 1) / 2, 0) AS INTEGER)), 16 - size) AS y0 FROM st, (VALUES (3), (5)) s(size)),
  boxed AS (SELECT *, x0 + window_size AS x1, y0 + window_size AS y1 FROM wide),
  cand AS (SELECT *, {inside('known', 't.', 'k.image_id = t.image_id')} / (window_size * window_size) AS sf, {inside('rc', 't.', _SAME + ' AND k.component = t.component')} AS n FROM boxed t),
  tc AS (SELECT {_LAYER}, component, area, window_size, x0, y0, x1, y1, round(sf, 9) AS support_fraction, round(n / (window_size * window_size), 9) AS transition_fraction, x0 AS crop_x0, y0 AS crop_y0, x1 AS crop_x1, y1 AS crop_y1
    FROM cand WHERE n >= 2 AND sf >= 0.4 AND n / (window_size * window_size) >= 0.1 QUALIFY row_number() OVER (PARTITION BY {_LAYER}, x0, y0, x1, y1 ORDER BY component) = 1)"""


@register("transition_candidates", with_sql("RECURSIVE " + GRID, *TRANS, COMPONENT_MODE, _CROPS, body=_CROP_BODY))
def transition_candidates(spark, folder):
    """Component crops: the component's box is gated, the crop has a margin of three."""
    out = T.transition_candidates(grid(spark, folder), "image_id", 7, 1, 2, 0.5, 0.5, SIDE, 3)
    return tidy(out, ("support_fraction", "transition_fraction"))


@register("transition_windows", with_sql("RECURSIVE " + GRID, *TRANS, WINDOW_MODE, _CROPS, body=_CROP_BODY))
def transition_windows(spark, folder):
    """Window crops: squares of two sizes round each component's centroid."""
    out = T.transition_candidates(grid(spark, folder), "image_id", 7, 1, 2, 0.4, 0.1, SIDE, sizes=(3, 5))
    return tidy(out, ("support_fraction", "transition_fraction"))


STATES = ("unchanged", "crack", "paint", "self_paste")
SCENARIOS = (("none", "none"), ("shadow_a", "shadow"), ("exposure_a", "exposure"))


def bases(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("base_id"), (F.col("o_custkey") % 25).alias("building_id"), F.lit("val").alias("split"),
        (F.col("o_custkey") % 40).alias("edit_pixels"), (F.col("o_custkey") % 5 * (F.col("o_custkey") % 40 / 8).cast("int")).alias("visible_edit_pixels"),
        F.round(F.col("o_custkey") % 100 / 100, 2).alias("comparable_fraction"),
    )


def repeats(rows):
    """Bases marked where another row has the same id: only their cases can have equal ids, and need to be told apart."""
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy("base_id")) > 1)


def catalog_counts(cases, by):
    """Cases, different ids and means; ids of bases that are not repeated are counted without sending them."""
    twice = F.col("repeated")
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"), (F.count_if(~twice) + F.countDistinct(F.when(twice, F.col("case_id")))).alias("ids"),
        rounded(F.avg("retained_fraction")).alias("retained_fraction"), rounded(F.avg("comparable_fraction")).alias("comparable_fraction"),
    )


@register("case_catalog", """SELECT state, scenario_id, nuisance_kind, hypothesis, sham, hidden_edit, count(*) AS cases, count(DISTINCT case_id) AS ids, round(avg(retained), 9) AS retained_fraction, round(avg(comparable_fraction), 9) AS comparable_fraction FROM (
  SELECT *, b.o_orderkey || '/' || state || '/' || scenario_id AS case_id, CASE WHEN full_px > 0 THEN 'H1' ELSE 'H0' END AS hypothesis, state = 'self_paste' AS sham, full_px > 0 AND seen = 0 AS hidden_edit, CASE WHEN full_px > 0 THEN seen / full_px END AS retained,
    round(o_custkey % 100 / 100, 2) AS comparable_fraction FROM (SELECT *, CASE WHEN state IN ('crack', 'paint') THEN o_custkey % 40 ELSE 0 END AS full_px,
    CASE WHEN state IN ('crack', 'paint') THEN (o_custkey % 5) * ((o_custkey % 40) // 8) ELSE 0 END AS seen
    FROM orders, (VALUES ('unchanged'), ('crack'), ('paint'), ('self_paste')) s(state), (VALUES ('none', 'none'), ('shadow_a', 'shadow'), ('exposure_a', 'exposure')) c(scenario_id, nuisance_kind)) b) GROUP BY ALL""")
def case_catalog(spark, folder):
    cases = L.case_catalog(repeats(bases(spark, folder)), STATES, SCENARIOS)
    return catalog_counts(cases, ["state", "scenario_id", "nuisance_kind", "hypothesis", "sham", "hidden_edit"])


@register("case_contract", """SELECT problem, count(*) AS pixels, count(DISTINCT case_id) AS cases FROM (SELECT case_id, unnest([
  CASE WHEN edit AND NOT support THEN 'edit_outside_support' END, CASE WHEN comparable <> (support AND source_support AND visible) THEN 'comparable_mismatch' END,
  CASE WHEN (label IS NOT NULL) <> comparable THEN 'label_support_mismatch' END, CASE WHEN visible_edit <> (edit AND comparable) THEN 'visible_edit_mismatch' END,
  CASE WHEN comparable AND label <> CAST(edit AS INTEGER) THEN 'label_edit_mismatch' END]) AS problem FROM (
  SELECT l_orderkey AS case_id, l_linestatus = 'O' AS support, l_quantity > 5 AS source_support, l_tax > 0.01 AS visible, l_linestatus = 'O' AND l_quantity > 5 AND l_tax > 0.015 AS comparable,
    l_returnflag = 'R' AS edit, l_returnflag = 'R' AND l_linestatus = 'O' AS visible_edit, CASE WHEN l_linestatus = 'O' AND l_quantity > 5 AND l_tax > 0.015 AND l_linenumber < 7 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END AS label FROM lineitem)) WHERE problem IS NOT NULL GROUP BY 1""")
def case_contract(spark, folder):
    line = table(spark, folder, "lineitem")
    support, source = F.col("l_linestatus") == "O", F.col("l_quantity") > 5
    comparable, edit = support & source & (F.col("l_tax") > 0.015), F.col("l_returnflag") == "R"
    rows = line.select(
        F.col("l_orderkey").alias("case_id"), support.alias("support"), source.alias("source_support"), (F.col("l_tax") > 0.01).alias("visible"),
        comparable.alias("comparable"), edit.alias("edit"), (edit & support).alias("visible_edit"),
        F.when(comparable & (F.col("l_linenumber") < 7), edit.cast("int")).alias("label"),
    )
    return L.case_problems(rows, "case_id")


def segmentation_pixels(spark, folder):
    g = grid(spark, folder)
    return g.select("image_id", F.when(F.col("building_id") % 9 != 0, F.col("building_id")).alias("building_id"),
                    F.col("new_bits").alias("pred_bits"), F.col("old_bits").alias("target_bits"), (F.col("old_bits") != 0).alias("valid"), "y", "x", "score", "support")


SEG = """seg AS (SELECT image_id, CASE WHEN building_id % 9 <> 0 THEN building_id END AS building_id, c AS channel,
  count(*) FILTER (WHERE old_bits <> 0 AND p AND t) AS tp, count(*) FILTER (WHERE old_bits <> 0 AND p AND NOT t) AS fp, count(*) FILTER (WHERE old_bits <> 0 AND NOT p AND t) AS fn
  FROM (SELECT *, (new_bits >> c) & 1 = 1 AS p, (old_bits >> c) & 1 = 1 AS t FROM grid, (SELECT unnest(range(7))::INTEGER AS c)) GROUP BY 1, 2, 3)"""


@register("multilabel_confusion", with_sql(GRID, SEG, body="SELECT image_id, channel, tp, fp, fn FROM seg"))
def multilabel_confusion(spark, folder):
    return M.multilabel_counts(segmentation_pixels(spark, folder), ["image_id"], 7)


GROUPS = {"openings": 0b11, "surface": 0b1011100, "all": 0b1111111}


@register("group_confusion", with_sql(GRID, body="""SELECT image_id, class_group, count(*) FILTER (WHERE old_bits <> 0 AND p AND t) AS tp, count(*) FILTER (WHERE old_bits <> 0 AND p AND NOT t) AS fp,
  count(*) FILTER (WHERE old_bits <> 0 AND NOT p AND t) AS fn FROM (SELECT *, new_bits & m <> 0 AS p, old_bits & m <> 0 AS t FROM grid, (VALUES ('openings', 3), ('surface', 92), ('all', 127)) v(class_group, m)) GROUP BY 1, 2"""))
def group_confusion(spark, folder):
    return M.group_counts(segmentation_pixels(spark, folder), ["image_id"], GROUPS)


def logits(spark, folder):
    """One logit per pixel of the fact table; class = line number."""
    line = table(spark, folder, "lineitem")
    z = (F.col("l_discount") - 0.05) * 80
    return line.select(
        (F.col("l_suppkey") % 25).alias("building_id"), F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("channel"),
        z.alias("logit"), (1 / (1 + F.exp(-z))).alias("probability"), (F.col("l_returnflag") == "R").alias("target"),
    )


LOSS = """loss AS (SELECT building_id, channel, sum(greatest(z, 0) + ln(1 + exp(-abs(z))) - z * t) AS bce_sum, sum(p) AS probability_sum, sum(t) AS target_sum, sum(p * t) AS intersection, count(*) AS valid_pixels
  FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM (SELECT l_suppkey % 25 AS building_id, l_linenumber - 1 AS channel, (l_discount - 0.05::DOUBLE) * 80 AS z, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS t FROM lineitem)) GROUP BY 1, 2)"""


@register("loss_statistics", with_sql(LOSS, body="SELECT building_id, channel, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("bce_sum", "probability_sum", "target_sum", "intersection")) + ", valid_pixels FROM loss"))
def loss_statistics(spark, folder):
    out = M.loss_sums(logits(spark, folder), ["building_id", "channel"])
    return out.select("building_id", "channel", *[rounded(c, 6).alias(c) for c in ("bce_sum", "probability_sum", "target_sum", "intersection")], "valid_pixels")


@register("loss_report", with_sql(LOSS, body="""SELECT building_id, round(bce, 9) AS bce, round(dice, 9) AS dice, round(0.5::DOUBLE * bce + 0.5::DOUBLE * dice, 9) AS loss FROM (
  SELECT building_id, avg(bce_sum / valid_pixels) AS bce, coalesce(avg(1 - (2 * intersection + 1e-6) / (probability_sum + target_sum + 1e-6)) FILTER (WHERE target_sum > 0), 0) AS dice FROM loss GROUP BY 1)"""))
def loss_report(spark, folder):
    """Image sums merged into building sums before Dice is taken."""
    sums = M.loss_sums(logits(spark, folder), ["building_id", "image_id", "channel"])
    return tidy(M.loss_metrics(sums, ["building_id"]), ("bce", "dice", "loss"))


def _report_sql():
    ratios = "CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision"
    pool = lambda keys, where: f"(SELECT {keys}, {ratios} FROM (SELECT {keys}, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM seg {where} GROUP BY {keys}))"
    avg = ", ".join(f"avg({m}) AS {m}" for m in M.CLASS_METRICS)
    out = ", ".join(f"round(avg({m}), 9) AS {m}" for m in M.CLASS_METRICS) + ", " + ", ".join(f"count({m}) AS eligible_{m}" for m in M.CLASS_METRICS)
    return with_sql(GRID, SEG, f"cls AS {pool('building_id, channel', 'WHERE building_id IS NOT NULL')}", f"bld AS (SELECT building_id, {avg} FROM cls GROUP BY 1)",
        f"aux AS (SELECT image_id, {avg} FROM {pool('image_id, channel', 'WHERE building_id IS NULL')} GROUP BY 1)",
        body=f"""SELECT 'primary' AS scope, 'all' AS key, {out} FROM bld UNION ALL SELECT 'per_class', CAST(channel AS VARCHAR), {out} FROM cls GROUP BY channel
        UNION ALL SELECT 'per_building', CAST(building_id AS VARCHAR), {out} FROM cls GROUP BY building_id
        UNION ALL SELECT 'pooled_secondary', 'all', {out} FROM {pool('channel', '')} UNION ALL SELECT 'auxiliary_images', 'all', {out} FROM aux""")


@register("segmentation_report", _report_sql())
def segmentation_report(spark, folder):
    counts = M.multilabel_counts(segmentation_pixels(spark, folder), ["image_id", "building_id"], 7)
    return tidy(M.segmentation_report(counts), M.CLASS_METRICS)


@register("condition_deltas", with_sql(GRID, """cond AS (SELECT condition, channel, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM (
  SELECT condition, c AS channel, ((CASE condition WHEN 'original' THEN new_bits WHEN 'shadow' THEN new_bits & 85 ELSE new_bits | 1 END) >> c) & 1 = 1 AS p, (old_bits >> c) & 1 = 1 AS t
  FROM grid, (SELECT unnest(range(7))::INTEGER AS c), (VALUES ('original'), ('shadow'), ('exposure')) k(condition) WHERE old_bits <> 0) GROUP BY 1, 2)""",
  body="""SELECT a.condition, a.channel, round(CASE WHEN a.tp + a.fp + a.fn > 0 THEN a.tp / (a.tp + a.fp + a.fn) END - CASE WHEN b.tp + b.fp + b.fn > 0 THEN b.tp / (b.tp + b.fp + b.fn) END, 9) AS delta_iou,
  round(CASE WHEN a.tp + a.fn > 0 THEN a.tp / (a.tp + a.fn) END - CASE WHEN b.tp + b.fn > 0 THEN b.tp / (b.tp + b.fn) END, 9) AS delta_recall
  FROM cond a JOIN cond b ON a.channel = b.channel AND b.condition = 'original' WHERE a.condition <> 'original'"""))
def condition_deltas(spark, folder):
    p = F.col("pred_bits")
    rows = F.array(
        F.struct(F.lit("original").alias("condition"), p.alias("bits")), F.struct(F.lit("shadow").alias("condition"), p.bitwiseAND(F.lit(85)).alias("bits")),
        F.struct(F.lit("exposure").alias("condition"), p.bitwiseOR(F.lit(1)).alias("bits")),
    )
    pixels = segmentation_pixels(spark, folder).select("target_bits", "valid", F.inline(rows)).withColumnRenamed("bits", "pred_bits")
    report = M.pooled_classes(M.multilabel_counts(pixels, ["condition"], 7), ["condition", "channel"])
    return tidy(M.condition_delta(report, ["shadow", "exposure"], "original", ["channel"], ["iou", "recall"]), ("delta_iou", "delta_recall"))


def _profile_sql():
    cond = {
        "kept_tp": "label = 1 AND a AND b", "rejected_tp": "label = 1 AND a AND NOT b", "removed_fp": "label = 0 AND a AND NOT b", "retained_fp": "label = 0 AND a AND b",
        "gate_only_tp": "label = 1 AND NOT a AND b", "missed_by_both": "label = 1 AND NOT a AND NOT b",
        "rejected_tp_boundary": "label = 1 AND a AND NOT b AND edge", "rejected_tp_other": "label = 1 AND a AND NOT b AND NOT edge",
        "kept_tp_boundary": "label = 1 AND a AND b AND edge", "kept_tp_other": "label = 1 AND a AND b AND NOT edge",
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS pixel_group, * FROM marked WHERE {c}" for n, c in cond.items())
    stats = " UNION ALL ".join(
        f"SELECT pixel_group, '{f}' AS feature, count({f}) AS pixels, round(avg({f}), 9) AS mean, round(min({f}), 9) AS low, round(max({f}), 9) AS high, round(quantile_cont({f}, 0.1), 9) AS p10, round(quantile_cont({f}, 0.5), 9) AS p50, round(quantile_cont({f}, 0.9), 9) AS p90 FROM g GROUP BY 1"
        for f in ("change_score", "raw_cost", "colour_difference", "threshold_gap"))
    return with_sql(GRID, LGRID, """marked AS (SELECT image_id, y, x, label, r > 150 AS a, score > CAST(0.6 AS FLOAT) AS b, CAST(score AS DOUBLE) AS change_score, CAST(g AS DOUBLE) AS raw_cost,
      (abs(s_r - r) + abs(s_g - g) + abs(s_b - b)) / 3.0::DOUBLE AS colour_difference, 0.6::DOUBLE - CAST(score AS DOUBLE) AS threshold_gap,
      EXISTS (SELECT 1 FROM lgrid n WHERE n.image_id = l.image_id AND n.label = 0 AND abs(n.y - l.y) <= 1 AND abs(n.x - l.x) <= 1) AS edge FROM lgrid l)""", f"g AS ({rows})", body=stats)


@register("feature_profile", _profile_sql())
def feature_profile(spark, folder):
    g = labelled_grid(spark, folder)
    change = [F.abs(F.col(s) - F.col(r)) for r, s in zip(*RGB)]
    pixels = g.select(
        "image_id", "y", "x", "label", (F.col("r") > 150).alias("a"), F.col("pred").alias("b"), F.col("score").cast("double").alias("change_score"), F.col("g").cast("double").alias("raw_cost"),
        ((change[0] + change[1] + change[2]) / 3.0).alias("colour_difference"), (F.lit(0.6) - F.col("score").cast("double")).alias("threshold_gap"),
    )
    unit, byte = (lambda c: F.floor((c + 1) * 512)), (lambda c: F.floor(c * 4))
    out = M.feature_profile(pixels, "image_id", {"change_score": unit, "raw_cost": byte, "colour_difference": byte, "threshold_gap": unit})
    return tidy(out, ("mean", "low", "high", "p10", "p50", "p90"))
