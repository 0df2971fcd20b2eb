"""Grid operators on long pixel tables keyed by (image, y, x).

Neighbourhoods are exploded by fixed offsets and recombined by mergeable
aggregates; pixel-to-tile joins use arithmetic on the stride, never a range
scan. Every group is one pixel or one bounded tile, so image size is no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import geometry as G
from driftlens.session import cut_lineage


def offsets(radius: int, centre=True):
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if centre or (dy, dx) != (0, 0)]


def spread(pixels: DataFrame, steps) -> DataFrame:
    """Copy every pixel to fixed (dy, dx) offsets."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    moved = pixels.withColumn("_m", F.explode(moves))
    return moved.withColumn("y", F.col("y") + F.col("_m.dy")).withColumn("x", F.col("x") + F.col("_m.dx")).drop("_m")


def dilated_bits(pixels: DataFrame, image, columns, radius: int) -> DataFrame:
    """OR of class bits over a Chebyshev square, all classes at once.

    Two axis passes copy each pixel 2(2r+1) times instead of (2r+1)^2.
    """
    keys = [image, "y", "x"]
    out = pixels.select(*keys, *columns)
    for steps in ([(0, d) for d in range(-radius, radius + 1)], [(d, 0) for d in range(-radius, radius + 1)]):
        out = spread(out, steps).groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in columns])
    return out


def dilate(mask: DataFrame, image, radius: int) -> DataFrame:
    """Positions within a Chebyshev radius of a set pixel; the caller clips to the image."""
    keys = [image, "y", "x"]
    out = mask.select(*keys)
    for steps in ([(0, d) for d in range(-radius, radius + 1)], [(d, 0) for d in range(-radius, radius + 1)]):
        out = spread(out, steps).dropDuplicates(keys)
    return out


def boundary(pixels: DataFrame, image) -> DataFrame:
    """Positive pixels that touch a known negative in eight neighbours."""
    keys = [image, "y", "x"]
    near = spread(pixels.filter("label = 0").select(*keys), offsets(1, centre=False)).dropDuplicates(keys)
    return pixels.filter("label = 1").join(near, keys, "left_semi")


def shift(pixels: DataFrame, dx: int, dy: int, width, height) -> DataFrame:
    """Exact integer shift; pixels leaving the frame are dropped (zero fill)."""
    moved = pixels.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)
    return moved.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def tile_grid(images: DataFrame, size: int, stride: int) -> DataFrame:
    """All tiles of every image: origin and clipped extent."""
    tiles = images.withColumn("y", F.explode(G.tile_origins(F.col("height"), size, stride))).withColumn(
        "x", F.explode(G.tile_origins(F.col("width"), size, stride))
    )
    return tiles.withColumn("tile_width", F.least(F.lit(size), F.col("width") - F.col("x"))).withColumn(
        "tile_height", F.least(F.lit(size), F.col("height") - F.col("y"))
    )


def crop_index(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiles with an id and the padding that fills small images."""
    return tile_grid(images, size, stride).select(
        F.concat_ws("-", F.col("image_id").cast("string"), F.concat(F.lit("x"), F.col("x").cast("string")), F.concat(F.lit("y"), F.col("y").cast("string"))).alias("crop_id"),
        "image_id", "split", "x", "y", F.col("tile_width").alias("width"), F.col("tile_height").alias("height"),
        (size - F.col("tile_width")).alias("pad_right"), (size - F.col("tile_height")).alias("pad_bottom"),
    )


def ownership_spans(tiles: DataFrame, image, axis, extent) -> DataFrame:
    """Half-open spans per origin: overlaps are cut at their midpoint.

    The window runs over distinct origins of one axis of one image, a few
    hundred at most.
    """
    lines = tiles.groupBy(image, axis).agg(F.max(extent).alias("_extent"))
    w = Window.partitionBy(image).orderBy(axis)
    before = F.lag(F.col(axis) + F.col("_extent")).over(w)
    after = F.lead(axis).over(w)
    end = F.col(axis) + F.col("_extent")
    return lines.select(
        image, axis,
        F.when(before.isNull(), F.col(axis)).otherwise(F.floor((before + F.col(axis)) / 2)).cast("int").alias(f"{axis}_from"),
        F.when(after.isNull(), end).otherwise(F.floor((end + after) / 2)).cast("int").alias(f"{axis}_to"),
        (before < F.col(axis)).alias(f"{axis}_gap"),
    )


def tile_ownership(tiles: DataFrame, image="image_id") -> DataFrame:
    """Tiles with the rectangle whose pixels they alone own; gaps are flagged."""
    ys = ownership_spans(tiles, image, "y", "tile_height")
    xs = ownership_spans(tiles, image, "x", "tile_width")
    out = tiles.join(ys, [image, "y"]).join(xs, [image, "x"])
    return out.withColumn("gap", F.coalesce(F.col("x_gap"), F.lit(False)) | F.coalesce(F.col("y_gap"), F.lit(False))).drop("x_gap", "y_gap")


def cover(pixels: DataFrame, size: int, stride: int, width="width", height="height") -> DataFrame:
    """One row per (pixel, covering tile), from arithmetic on the stride."""
    out = pixels.withColumn("ty", F.explode(G.covering_origins(F.col("y"), F.col(height), size, stride)))
    return out.withColumn("tx", F.explode(G.covering_origins(F.col("x"), F.col(width), size, stride)))


def tile_support(pixels: DataFrame, image, size: int, stride: int, minimum: float) -> DataFrame:
    """Supported share of every tile against its full clipped area."""
    area = F.least(F.lit(size), F.col("width") - F.col("tx")) * F.least(F.lit(size), F.col("height") - F.col("ty"))
    covered = cover(pixels, size, stride).groupBy(image, "width", "height", "ty", "tx").agg(F.count_if("support").alias("supported"))
    fraction = F.col("supported") / area
    return covered.withColumn("fraction", fraction).withColumn("kept", F.col("fraction") >= minimum)


def stitch(tile_predictions: DataFrame, owned: DataFrame, image="image_id") -> DataFrame:
    """Whole-image class bits, each pixel from the tile that owns it.

    ``tile_predictions`` carries (image, ty, tx, y, x, channel).
    """
    spans = owned.select(image, F.col("y").alias("ty"), F.col("x").alias("tx"), "y_from", "y_to", "x_from", "x_to")
    inside = (F.col("y") >= F.col("y_from")) & (F.col("y") < F.col("y_to")) & (F.col("x") >= F.col("x_from")) & (F.col("x") < F.col("x_to"))
    mine = tile_predictions.join(spans, [image, "ty", "tx"]).filter(inside)
    return mine.groupBy(image, "y", "x").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("channel"))).alias("bits"))


def uncovered(pixels: DataFrame, stitched: DataFrame, image="image_id") -> DataFrame:
    return pixels.join(stitched, [image, "y", "x"], "left_anti")


def _rounded_source(target: DataFrame, inverse):
    sx, sy, ok = G.transform_point(F.col("x"), F.col("y"), inverse)
    return target.withColumn("_sx", sx).withColumn("_sy", sy).filter(ok)


def resample_nearest(source: DataFrame, target: DataFrame, image, inverse, values) -> DataFrame:
    """Labels or bits at the nearest source pixel of every target pixel; 0 outside."""
    placed = _rounded_source(target.select(image, "y", "x"), inverse)
    placed = placed.withColumn("_ky", F.floor(F.col("_sy") + 0.5)).withColumn("_kx", F.floor(F.col("_sx") + 0.5))
    src = source.select(image, F.col("y").cast("bigint").alias("_ky"), F.col("x").cast("bigint").alias("_kx"), *values)
    joined = placed.join(src, [image, "_ky", "_kx"], "left")
    return joined.select(image, "y", "x", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def resample_bilinear(source: DataFrame, target: DataFrame, image, inverse, values) -> DataFrame:
    """Four-neighbour weights with zero border; support needs full weight."""
    placed = _rounded_source(target.select(image, "y", "x"), inverse)
    fy, fx = F.floor("_sy"), F.floor("_sx")
    wy, wx = F.col("_sy") - fy, F.col("_sx") - fx
    taps = F.array(*[
        F.struct((fy + dy).alias("ky"), (fx + dx).alias("kx"), ((wy if dy else 1 - wy) * (wx if dx else 1 - wx)).alias("w"))
        for dy in (0, 1) for dx in (0, 1)
    ])
    taps = placed.select(image, "y", "x", F.explode(taps).alias("_t")).select(
        image, "y", "x", F.col("_t.ky").alias("_ky"), F.col("_t.kx").alias("_kx"), F.col("_t.w").alias("_w")
    ).filter("_w > 0")
    src = source.select(image, F.col("y").cast("bigint").alias("_ky"), F.col("x").cast("bigint").alias("_kx"), *values)
    return (
        taps.join(src, [image, "_ky", "_kx"])
        .groupBy(image, "y", "x")
        .agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values], F.sum("_w").alias("coverage"))
        .withColumn("support", F.col("coverage") >= 1 - 1e-6)
    )


def gather_or(reference: DataFrame, source: DataFrame, image) -> DataFrame:
    """Reference mask OR the source mask at truncated correspondence (cx, cy)."""
    ref = reference.withColumn("_ky", F.when(F.col("cy") >= 0, F.floor("cy"))).withColumn("_kx", F.when(F.col("cx") >= 0, F.floor("cx")))
    src = source.select(image, F.col("y").cast("bigint").alias("_ky"), F.col("x").cast("bigint").alias("_kx"), F.col("mask").alias("_sampled"))
    joined = ref.join(src, [image, "_ky", "_kx"], "left")
    return joined.select(image, "y", "x", (F.col("mask") | F.coalesce("_sampled", F.lit(False))).alias("mask"))


def _run_spans(batches):
    """Rows (kept columns, start, end) of the set runs, a batch of annotations at once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        counts = batch["counts"]
        sizes = pc.fill_null(pc.list_value_length(counts), 0).to_numpy().astype(np.int64)
        n = pc.fill_null(counts.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        total = np.append(0, np.cumsum(n))
        start = total[:-1] - total[first[row]]
        kept = np.flatnonzero(((np.arange(len(n)) - first[row]) % 2 == 1) & (n > 0))
        rest = [name for name in batch.schema.names if name != "counts"]
        yield pa.RecordBatch.from_arrays([*batch.select(rest).take(pa.array(row[kept])).columns, pa.array(start[kept]), pa.array((start + n)[kept])], names=[*rest, "_start", "_end"])


def rasterize_runs(annotations: DataFrame) -> DataFrame:
    """Column-major run lengths to per-pixel class bits; crowd pixels become 0.

    Needs image_id, channel, iscrowd, height and counts (zeros first). Runs are
    summed inside their row, so nothing is sorted or sent before pixels are merged.
    """
    keep, kinds = ["image_id", "channel", "iscrowd", "height"], dict(annotations.dtypes)
    spans = annotations.select(*keep, "counts").mapInArrow(_run_spans, ", ".join([*[f"{k} {kinds[k]}" for k in keep], "_start long", "_end long"]))
    cells = spans.select(*keep, F.explode(F.sequence(F.col("_start"), F.col("_end") - 1)).alias("_p"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("channel"))
    return cells.groupBy("image_id", (F.col("_p") % F.col("height")).cast("int").alias("y"), F.floor(F.col("_p") / F.col("height")).cast("int").alias("x")).agg(
        F.when(F.bool_or(F.col("iscrowd") == 1), 0).otherwise(F.bit_or(F.when(F.col("iscrowd") == 1, 0).otherwise(bit))).alias("bits")
    )


def sorted_blocks(rows: DataFrame, keys, function, schema: str) -> DataFrame:
    """``function`` gives Arrow tables for a table of whole groups, many groups per call; rows come sorted by ``keys``, which are never null."""
    keys = list(keys)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, final = ([batch[k][i].as_py() for k in keys] for i in (0, batch.num_rows - 1))
            if held and first != last:
                yield from function(pa.Table.from_batches(held))
                held = []
            if first != final:
                # The last group may go on in the next batch.
                open_rows = pa.array([True] * batch.num_rows)
                for k, value in zip(keys, final):
                    open_rows = pc.and_(open_rows, pc.equal(batch[k], pa.scalar(value, batch[k].type)))
                cut = batch.num_rows - pc.sum(open_rows).as_py()
                yield from function(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = final
        if held:
            yield from function(pa.Table.from_batches(held))

    def out(batches):
        for table in run(batches):
            yield from table.combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(out, schema)


def _block_labels(keys, layers, kinds):
    """Label one bounded block: least position id spreads to eight neighbours."""
    import numpy as np

    import pyarrow as pa

    columns = [*keys, *layers, "y", "x"]

    def label(rows):
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        z = np.zeros(len(y), int)
        for name in layers:
            codes = rows[name].combine_chunks().dictionary_encode().indices.to_numpy()
            z = z * (codes.max() + 1) + codes
        plane = np.full((z.max() + 1, y.max() - y.min() + 3, x.max() - x.min() + 3), np.iinfo(np.int64).max)
        ids = (y.astype(np.int64) << 31) + x
        r, c = y - y.min() + 1, x - x.min() + 1
        plane[z, r, c] = ids
        while True:
            least = np.min([plane[z, r + dy, c + dx] for dy, dx in offsets(1)], axis=0)
            if (least == plane[z, r, c]).all():
                break
            plane[z, r, c] = least
        return rows.select(columns).append_column("local", pa.array(plane[z, r, c]))

    return label, ", ".join([*(f"{k} {kinds[k]}" for k in columns), "local long"])


def _last_parents(parent: DataFrame, keys) -> DataFrame:
    """Follow parent links (keys, a, b) to their ends; chains shrink fourfold per round."""
    while True:
        ends = parent.select(*keys, F.col("a").alias("b"))
        if parent.join(ends, [*keys, "b"], "left_semi").isEmpty():
            return parent
        for _ in range(2):
            onward = parent.select(*keys, F.col("a").alias("b"), F.col("b").alias("_next"))
            parent = parent.join(onward, [*keys, "b"], "left").select(*keys, "a", F.coalesce("_next", "b").alias("b"))
        parent = cut_lineage(parent)


def contact_roots(contacts: DataFrame, keys) -> DataFrame:
    """Rows (keys, a, b): every label in contact with others, with the least label it is joined to.

    Each round hooks every label to its least smaller neighbour, follows the
    links to their roots and keeps only contacts between different roots. Every
    contact has a larger end that hooks, so the rounds are logarithmic in the
    number of labels whatever the shape of a component.
    """
    keys = list(keys)
    turned = lambda e: e.filter("a != b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left, found = cut_lineage(turned(contacts)), None
    while not left.isEmpty():
        parent = _last_parents(cut_lineage(left.groupBy(*keys, "a").agg(F.min("b").alias("b"))), keys)
        found = parent if found is None else found.unionByName(parent)
        for end in ("a", "b"):
            root = parent.select(*keys, F.col("a").alias(end), F.col("b").alias("_root"))
            left = left.join(root, [*keys, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        left = cut_lineage(turned(left))
    return left if found is None else _last_parents(found, keys)


def connected_components(mask: DataFrame, keys, layers=(), block=64) -> DataFrame:
    """8-connected components: ``component`` is the smallest position id inside.

    Components never cross ``keys`` or ``layers``; layers (say, event kinds) of
    one block are labelled in the same task. Blocks of bounded size are
    labelled in one grouped pass; only the contacts across block borders enter
    the iterative part.
    """
    images, keys, layers = list(keys), [*keys, *layers], list(layers)
    label, schema = _block_labels(images, layers, dict(mask.dtypes))
    blocks = mask.select(*keys, "y", "x").groupBy(*images, F.floor(F.col("y") / block).alias("_by"), F.floor(F.col("x") / block).alias("_bx"))
    pixels = cut_lineage(blocks.applyInArrow(label, schema))
    edge = (F.col("y") % block).isin(0, block - 1) | (F.col("x") % block).isin(0, block - 1)
    rim = pixels.filter(edge)
    contacts = spread(rim, offsets(1, centre=False)).withColumnRenamed("local", "a").join(rim.withColumnRenamed("local", "b"), [*keys, "y", "x"])
    roots = contact_roots(contacts.filter("a != b").select(*keys, "a", "b"), keys).withColumnRenamed("a", "local")
    return pixels.join(roots, [*keys, "local"], "left").select(*keys, "y", "x", F.coalesce("b", "local").alias("component"))


def component_stats(components: DataFrame, keys) -> DataFrame:
    return components.groupBy(*keys, "component").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )


def summed_area(points: DataFrame, keys, frames: DataFrame, measures) -> DataFrame:
    """Rows (keys, y, x, measures): sums over the frame's points up to and including each cell.

    ``frames`` has one box (keys, fy0, fx0, fy1, fx1) per key. Running sums go
    along the rows and then along the columns, so a window holds one line.
    """
    keys = list(keys)
    cells = frames.select(*keys, F.explode(F.sequence("fy0", F.col("fy1") - 1)).alias("y"), "fx0", "fx1").select(*keys, "y", F.explode(F.sequence("fx0", F.col("fx1") - 1)).alias("x"))
    out = cells.join(points.select(*keys, "y", "x", *measures), [*keys, "y", "x"], "left").fillna(0, list(measures))
    for line, along in (("y", "x"), ("x", "y")):
        run = Window.partitionBy(*keys, line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        out = out.select(*keys, "y", "x", *[F.sum(m).over(run).alias(m) for m in measures])
    return out


def box_counts(points: DataFrame, keys, frames: DataFrame, measures, boxes: DataFrame, names) -> DataFrame:
    """Rows (keys, names, measures): sums inside boxes (keys, names, y0, x0, y1, x1) by four look-ups each."""
    keys, names = list(keys), list(names)
    area = summed_area(points, keys, frames.join(boxes.select(*keys).distinct(), keys, "left_semi"), measures)
    edge = lambda low, high, value: F.greatest(low, F.least(high, value))
    inside = boxes.join(frames, keys).select(*keys, *names, *[
        edge(F.col(f"f{axis}0"), F.col(f"f{axis}1"), F.col(f"{axis}{end}")).alias(f"{axis}{end}") for axis in "yx" for end in "01"
    ])
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("_sign"))
    corners = F.array(corner("y1", "x1", 1), corner("y0", "x1", -1), corner("y1", "x0", -1), corner("y0", "x0", 1))
    asked = inside.select(*keys, *names, F.inline(corners))
    # Corners before the frame find no cell and count 0.
    return asked.join(area, [*keys, "y", "x"], "left").groupBy(*keys, *names).agg(*[F.coalesce(F.sum(F.col("_sign") * F.col(m)), F.lit(0)).alias(m) for m in measures])
