"""Candidates of class transitions between two dates: robust components, gates and crops.

A change is robust where it lies outside the same-class dilation of the other
date. Robust components are selected; the raw component each lies in tells how
much of it the tolerance ignored and how much belongs to other robust ones.
Blocks of pixels are labelled in sorted partitions, many per call into Python;
components that touch other blocks are joined by their border pixels, and boxes
are counted per block they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators import grid as G
from driftlens.session import stored

#: Side of the blocks that are labelled and counted at once, pixels and blocks a numpy call takes, and box cells counted in one step.
BLOCK, CHUNK, CHUNK_BLOCKS, CELLS = 64, 1 << 14, 64, 1 << 21


def layer_columns(channels: int) -> list:
    """event, from_class and to_class of a layer number: gains, then losses, then (lost, gained) pairs; an absent class is -1."""
    n, pair = F.col("layer"), F.col("layer") - 2 * channels
    kind = F.when(n < channels, "appearance").when(n < 2 * channels, "disappearance").otherwise("replacement")
    old = F.when(n < channels, -1).when(n < 2 * channels, n - channels).otherwise(F.floor(pair / channels))
    new = F.when(n < channels, n).when(n < 2 * channels, -1).otherwise(pair % channels)
    return [kind.alias("event"), old.cast("int").alias("from_class"), new.cast("int").alias("to_class")]


def _chunks(table, image):
    """Parts of whole blocks, about ``CHUNK`` rows or ``CHUNK_BLOCKS`` blocks each, with the number of each row's block; rows are sorted by (image, _by, _bx)."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(table.num_rows, bool)
    for name in (image, "_by", "_bx"):
        column = table[name].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    ends, at = np.append(np.flatnonzero(new), table.num_rows), 0
    while at < table.num_rows:
        one = np.searchsorted(ends, at, side="right")
        end = ends[max(one, min(np.searchsorted(ends, at + CHUNK, side="right"), one + CHUNK_BLOCKS) - 1)]
        part = table.slice(at, end - at)
        yield part, np.cumsum(new[at:end]) - new[at]
        at = end


def _members(near):
    """Least index of every 8-connected component; ``near`` holds nine neighbours each, len(near) where there is none."""
    import numpy as np

    n = len(near)
    labels = np.arange(n + 1)
    while True:
        least = labels[near].min(axis=1) if n else labels[:0]
        least = least[least]
        if (least == labels[:n]).all():
            return least
        labels[:n] = least


def _block_changes(part, z, radius, channels):
    """Changes of the own pixels of a chunk's blocks, in order of (block, layer, y, x), with their local raw and robust components.

    ``z`` numbers the blocks of the rows. Rows of neighbouring blocks serve the
    dilation and tell which pixels lie beside another block.
    """
    import numpy as np

    column = lambda name: part[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    y, x, old, new = (column(c).astype(np.int64) for c in ("y", "x", "old_bits", "new_bits"))
    support = part["support"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    own = (y // BLOCK == column("_by")) & (x // BLOCK == column("_bx"))
    blocks, margin = int(z.max()) + 1, max(radius, 1)
    low_y, low_x = np.full(blocks, np.iinfo(np.int64).max), np.full(blocks, np.iinfo(np.int64).max)
    np.minimum.at(low_y, z, y)
    np.minimum.at(low_x, z, x)
    r, c = y - low_y[z] + margin, x - low_x[z] + margin
    wide = int(max(r.max(), c.max())) + margin + 1
    spot = (z * wide + r) * wide + c
    place = np.full(blocks * wide * wide, len(y))
    place[spot] = np.arange(len(y))
    steps = lambda d: [dy * wide + dx for dy in range(-d, d + 1) for dx in range(-d, d + 1)]
    known = own & support & (old != 0) & (new != 0)
    seen = np.flatnonzero(known & (old != new))
    more = lambda v: np.append(v, 0)
    old_near, new_near = (np.bitwise_or.reduce([more(v)[place[spot[seen] + s]] for s in steps(radius)], axis=0) if len(seen) else v[seen] for v in (old, new))
    beside = np.append(~own, False)
    rim = np.logical_or.reduce([beside[place[spot[seen] + s]] for s in steps(1)], axis=0)
    bits = lambda v: (v[:, None] >> np.arange(channels)) & 1 == 1
    gain, loss = bits(new[seen] & ~old[seen]), bits(old[seen] & ~new[seen])
    sure_gain, sure_loss = gain & ~bits(old_near), loss & ~bits(new_near)
    at_g, g = np.nonzero(gain)
    at_l, lost = np.nonzero(loss)
    at_p, a, b = np.nonzero(loss[:, :, None] & gain[:, None, :])
    pixel = np.concatenate([at_g, at_l, at_p])
    layer = np.concatenate([g, channels + lost, 2 * channels + a * channels + b])
    robust = np.concatenate([sure_gain[at_g, g], sure_loss[at_l, lost], sure_loss[at_p, a] & sure_gain[at_p, b]])
    rim, pixel = rim[pixel], seen[pixel]
    layers, slot = np.unique(z[pixel] * (2 * channels + channels * channels) + layer, return_inverse=True)
    key = (slot * wide + r[pixel]) * wide + c[pixel]
    order = np.argsort(key, kind="stable")
    pixel, layer, robust, rim, key = (v[order] for v in (pixel, layer, robust, rim, key))
    ids = (y[pixel] << 31) + x[pixel]
    nine = np.array(steps(1))

    def local(chosen):
        plane = np.full(len(layers) * wide * wide + 1, len(chosen), np.int32)
        plane[key[chosen]] = np.arange(len(chosen))
        found = np.full(len(key), -1)
        found[chosen] = chosen[_members(plane[key[chosen][:, None] + nine])]
        return found

    raw, sure = local(np.arange(len(key))), local(np.flatnonzero(robust))
    return {"y": y, "x": x, "known": known, "place": place, "wide": wide, "low": (low_y - margin, low_x - margin), "pixel": pixel, "layer": layer, "robust": robust, "rim": rim, "ids": ids, "raw": raw, "sure": sure, "key": key, "layers": layers}


def block_parts(staged: DataFrame, image, radius, channels) -> DataFrame:
    """Robust components of each block with their sums, and all components' pixels beside other blocks.

    ``up`` is the local raw component a robust one lies in. Raw components that
    touch no other block need no row.
    """
    def run(table):
        import numpy as np
        import pyarrow as pa

        for part, z in _chunks(table, image):
            got = _block_changes(part, z, radius, channels)
            for sure, label in ((True, got["sure"]), (False, got["raw"])):
                rows = np.flatnonzero(label >= 0) if sure else np.flatnonzero(np.isin(label, label[got["rim"]]))
                if not len(rows):
                    continue
                rows = rows[np.argsort(label[rows], kind="stable")]
                first = np.flatnonzero(np.diff(label[rows], prepend=-1))
                head, pixel = label[rows[first]], got["pixel"][rows]
                y, x = got["y"][pixel], got["x"][pixel]
                edge = got["rim"][rows]
                cuts = np.append(0, np.add.reduceat(edge, first, dtype=np.int64).cumsum()).astype(np.int32)
                least, most, total = (lambda v, f=f: f.reduceat(v, first) for f in (np.minimum, np.maximum, np.add))
                columns = [
                    got["layer"][head].astype(np.int32), np.full(len(head), sure), got["ids"][head], got["ids"][got["raw"][head]], np.diff(np.append(first, len(rows))),
                    total(y), total(x), least(y), least(x), most(y) + 1, most(x) + 1,
                ]
                block = part.select([image, "_by", "_bx"]).take(pa.array(got["pixel"][head]))
                rims = pa.ListArray.from_arrays(pa.array(cuts), pa.array(got["ids"][rows][edge]))
                yield pa.table([*block.columns, *[pa.array(v) for v in columns], rims], names=[image, "_by", "_bx", *PART, "rim"])

    kinds = dict(staged.dtypes)
    schema = ", ".join([f"{image} {kinds[image]}, _by int, _bx int, layer int, robust boolean", *[f"{c} long" for c in PART[2:]], "rim array<long>"])
    return G.sorted_blocks(staged, [image, "_by", "_bx"], run, schema)


PART = ["layer", "robust", "local", "up", "area", "sy", "sx", "y0", "x0", "y1", "x1"]
BOX = ["layer", "component", "_box", "raw", "y0", "x0", "y1", "x1", "crop_y0", "crop_x0", "crop_y1", "crop_x1"]
COUNTS = ["n_known", "common_pixels", "candidate_pixels", "raw_pixels", "_robust"]


def block_counts(staged: DataFrame, aliases: DataFrame, boxes: DataFrame, image, radius, channels) -> DataFrame:
    """Pixels of each box inside each block it meets: known ones (box and crop), and those of its component, of its raw component, and robust of the latter (crop).

    ``aliases`` name the final component of local ones that touch other blocks.
    """
    keys = [image, "_by", "_bx"]
    pixel = ["y", "x", "old_bits", "new_bits", "support"]
    reach = lambda axis: F.explode(F.sequence(F.floor(F.col(f"crop_{axis}0") / BLOCK).cast("int"), F.floor((F.col(f"crop_{axis}1") - 1) / BLOCK).cast("int")))
    asked = boxes.filter("crop_y1 > crop_y0 AND crop_x1 > crop_x0").withColumn("_by", reach("y")).withColumn("_bx", reach("x"))
    asked = asked.select(*keys, F.struct(*[F.col(c).cast("long").alias(c) for c in BOX]).alias("box"))
    named = aliases.select(*keys, F.struct(F.col("layer").cast("long").alias("layer"), F.col("robust").cast("long").alias("robust"), "local", "component").alias("alias"))
    rows = staged.select(*keys, *pixel).unionByName(named, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for part, z in _chunks(table, image):
            struct = {name: part[name].combine_chunks() for name in ("box", "alias")}
            at = {name: np.flatnonzero(pc.is_valid(v).to_numpy(zero_copy_only=False)) for name, v in struct.items()}
            if not len(at["box"]):
                continue
            field = lambda name, c: struct[name].take(pa.array(at[name])).field(c).to_numpy(zero_copy_only=False)
            box, bz = {c: field("box", c) for c in BOX}, z[at["box"]]
            wanted = np.isin(z, bz) & pc.is_valid(part["y"]).to_numpy()
            if not wanted.any():
                continue
            blocks, numbers = np.unique(z[wanted], return_inverse=True)
            got = _block_changes(part.filter(pa.array(wanted)), numbers, radius, channels)
            name = {kind: got["ids"][np.maximum(label, 0)] if len(label) else label for kind, label in (("sure", got["sure"]), ("raw", got["raw"]))}
            name["sure"] = np.where(got["robust"], name["sure"], -1)
            span = 2 * channels + channels * channels
            layer_of = got["layers"][got["key"] // got["wide"] ** 2] if len(got["key"]) else got["key"]
            if len(at["alias"]):
                az, sure, layer, local, root = z[at["alias"]], *(field("alias", c) for c in ("robust", "layer", "local", "component"))
                az, kept = np.searchsorted(blocks, az), np.isin(az, blocks)
                for kind, flag in (("sure", 1), ("raw", 0)):
                    known = {(s, i): t for s, i, t in zip((az * span + layer)[kept & (sure == flag)].tolist(), local[kept & (sure == flag)].tolist(), root[kept & (sure == flag)].tolist())}
                    if known:
                        pairs, back = np.unique(np.stack([layer_of, name[kind]]), axis=1, return_inverse=True)
                        name[kind] = np.array([known.get((s, i), i) for s, i in pairs.T.tolist()])[back.ravel()]
            use = np.flatnonzero(np.isin(bz, blocks))
            b = np.searchsorted(blocks, bz[use])
            box = {c: v[use] for c, v in box.items()}
            wide, (low_y, low_x) = got["wide"], got["low"]
            top, left = np.maximum(box["crop_y0"], low_y[b]), np.maximum(box["crop_x0"], low_x[b])
            height = np.maximum(np.minimum(box["crop_y1"], low_y[b] + wide) - top, 0)
            width = np.maximum(np.minimum(box["crop_x1"], low_x[b] + wide) - left, 0)
            area = height * width
            slot = np.searchsorted(got["layers"], b * span + box["layer"]) if len(got["layers"]) else np.zeros(len(b), int)
            there = (got["layers"][np.minimum(slot, len(got["layers"]) - 1)] == b * span + box["layer"]) if len(got["layers"]) else np.zeros(len(b), bool)
            slot = np.where(there, slot, len(got["layers"]))
            entry = np.full((len(got["layers"]) + 1) * wide * wide, len(got["key"]), np.int32)
            entry[got["key"]] = np.arange(len(got["key"]))
            known = np.append(got["known"], False)
            sure, raw, robust = np.append(name["sure"], -1), np.append(name["raw"], -1), np.append(got["robust"], False)
            sums = np.zeros((len(COUNTS), len(b)), np.int64)
            ends, first = area.cumsum(), 0
            while first < len(b):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - area[first] + CELLS, side="right")))
                one = np.repeat(np.arange(first, last), area[first:last])
                step = np.arange(len(one)) - np.repeat(ends[first:last] - area[first:last] - (ends[first] - area[first]), area[first:last])
                y, x = top[one] + step // np.maximum(width[one], 1), left[one] + step % np.maximum(width[one], 1)
                cell = (y - low_y[b[one]]) * wide + x - low_x[b[one]]
                sees = known[got["place"][b[one] * wide * wide + cell]]
                hit = entry[slot[one] * wide * wide + cell]
                gate = (y >= box["y0"][one]) & (y < box["y1"][one]) & (x >= box["x0"][one]) & (x < box["x1"][one])
                inside = raw[hit] == box["raw"][one]
                for k, flags in enumerate((sees & gate, sees, sure[hit] == box["component"][one], inside, inside & robust[hit])):
                    sums[k, first:last] = np.bincount(one[flags] - first, minlength=last - first)
                first = last
            image_of = part.select([image]).take(pa.array(at["box"][use]))
            yield pa.table([*image_of.columns, *[pa.array(box[c]) for c in BOX[:3]], *[pa.array(v) for v in sums]], names=[image, *BOX[:3], *COUNTS])

    schema = ", ".join([f"{image} {dict(staged.dtypes)[image]}", *[f"{c} long" for c in [*BOX[:3], *COUNTS]]])
    counted = G.sorted_blocks(rows, keys, run, schema)
    return counted.groupBy(image, *BOX[:3]).agg(*[F.sum(c).alias(c) for c in COUNTS])


def transition_candidates(pixels: DataFrame, image, channels, radius, min_pixels, min_support, min_fraction, side, context=0, sizes=None) -> DataFrame:
    """Components of robust class appearances, disappearances and replacements with their crops.

    Without ``sizes`` a component's box is gated and grown by ``context`` to the
    crop. With ``sizes``, square windows of those sizes round the centroid,
    pushed inside the image, are gated and are the crops; of components that
    share a window the first one keeps it. Gates are on the ungrown box: least
    component pixels, least share of known pixels, least share of the component.

    Layers exist inside a block's task only. Between tasks go pixels, one row per
    component and block, the pixels on borders of blocks, and boxes.
    """
    kind, box, keys = pixels.schema["y"].dataType, ["y0", "x0", "y1", "x1"], [image, "layer"]
    margin = max(radius, 1)
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - margin) / BLOCK)).cast("int"), F.floor((F.col(c) + margin) / BLOCK).cast("int")))
    dealt = pixels.filter(F.col(image).isNotNull() & (F.col("y") >= 0) & (F.col("x") >= 0)).select(image, "y", "x", "old_bits", "new_bits", "support").withColumn("_by", near("y")).withColumn("_bx", near("x"))
    staged = stored(dealt, "transition-pixels")
    parts = stored(block_parts(staged, image, radius, channels), "transition-parts")
    rim = parts.filter("size(rim) > 0").select(*keys, "robust", F.col("local").alias("a"), F.explode("rim").alias("_at"))
    rim = rim.select(*keys, "robust", "a", F.shiftright("_at", 31).alias("y"), F.col("_at").bitwiseAND((1 << 31) - 1).alias("x"))
    contacts = G.spread(rim, G.offsets(1, centre=False)).join(rim.withColumnRenamed("a", "b"), [*keys, "robust", "y", "x"])
    roots = G.contact_roots(contacts.filter("a != b").select(*keys, "robust", "a", "b"), [*keys, "robust"])
    aliases = stored(parts.join(roots.withColumnsRenamed({"a": "local", "b": "component"}), [*keys, "robust", "local"]).select(image, "_by", "_bx", "layer", "robust", "local", "component"), "transition-aliases")
    named = lambda sure, old, new: aliases.filter(F.col("robust") == sure).select(*keys, F.col("local").alias(old), F.col("component").alias(new)).distinct()
    pieces = parts.filter("robust").drop("rim").join(named(True, "local", "_c"), [*keys, "local"], "left").join(named(False, "up", "_r"), [*keys, "up"], "left")
    stats = pieces.withColumn("component", F.coalesce("_c", "local")).groupBy(*keys, "component").agg(
        F.sum("area").alias("area"), *[F.min(c).cast(kind).alias(c) for c in ("x0", "y0")], *[F.max(c).cast(kind).alias(c) for c in ("x1", "y1")],
        (F.sum("sx") / F.sum("area")).alias("cx"), (F.sum("sy") / F.sum("area")).alias("cy"), F.min(F.coalesce("_r", "up")).alias("raw"),
    ).filter(F.col("area") >= min_pixels)
    if sizes is None:
        boxes = stats.withColumn("window_size", F.lit(None).cast("int"))
    else:
        low = lambda c: F.least(F.greatest(F.lit(0), F.bround(F.col(c) - (F.col("window_size") - 1) / 2).cast("int")), F.lit(side) - F.col("window_size"))
        fitting = F.explode(F.array(*[F.lit(s) for s in sizes if s <= side]).cast("array<int>"))
        boxes = stats.withColumn("window_size", fitting).withColumn("y0", low("cy")).withColumn("x0", low("cx"))
        boxes = boxes.withColumn("y1", F.col("y0") + F.col("window_size")).withColumn("x1", F.col("x0") + F.col("window_size"))
    core = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    if sizes is None:
        boxes = boxes.filter(F.col("area") / core >= min_fraction)
    grow = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(side), F.col(c) + d))
    pad = context if sizes is None else 0
    boxes = boxes.withColumn("_box", F.coalesce("window_size", F.lit(0)).cast("long")).drop("cx", "cy")
    boxes = stored(boxes.select("*", *[grow(c, -pad if c.endswith("0") else pad).alias(f"crop_{c}") for c in box]), "transition-boxes")
    counts = block_counts(staged, aliases, boxes, image, radius, channels)
    found = boxes.join(counts.withColumn("layer", F.col("layer").cast("int")), [*keys, "component", "_box"]).filter("candidate_pixels > 0")
    within = F.col("area") if sizes is None else F.col("candidate_pixels")
    found = found.withColumn("transition_fraction", within / core).withColumn("support_fraction", F.col("n_known") / core)
    gated = found.filter((within >= min_pixels) & (F.col("transition_fraction") >= min_fraction) & (F.col("support_fraction") >= min_support))
    if sizes is not None:
        first = F.row_number().over(Window.partitionBy(*keys, *box).orderBy("component"))
        gated = gated.withColumn("_first", first).filter("_first = 1").drop("_first")
    return gated.select(
        image, *layer_columns(channels), "component", "area", "x0", "y0", "x1", "y1", *(["window_size"] if sizes is not None else []), "transition_fraction", "support_fraction",
        *[f"crop_{c}" for c in box], "common_pixels", "candidate_pixels", "raw_pixels", (F.col("raw_pixels") - F.col("_robust")).alias("ignored_boundary_pixels"),
        (F.col("_robust") - F.col("candidate_pixels")).alias("other_robust_pixels"),
    )
