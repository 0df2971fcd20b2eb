"""Leakage-free splits: ownership, audits, balance and transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.geometry import tile_count
from driftlens.functions.names import normalized_name
from driftlens.operators.ranks import bucketed_rank, hex_bucket, running_totals
from driftlens.session import stored

IDENTITY_KEYS = ("building_id", "view_id", "sha256")
SPLITS = ("train", "val", "test")


def folded(value: Column) -> Column:
    """Trimmed, case-folded identity; blank becomes NULL."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text != "", text)


def identities(rows: DataFrame, keep, keys=IDENTITY_KEYS) -> DataFrame:
    """Unpivot identity keys to (kind, value) rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), folded(F.col(k)).alias("value")) for k in keys])
    return rows.select(*keep, F.inline(pairs)).filter("value IS NOT NULL")


def series_class(images: DataFrame) -> DataFrame:
    """Longest view of each building in distinct years; incomplete rows make it unknown."""
    complete = F.col("view_id").isNotNull() & F.coalesce(F.col("year").between(1800, 2100), F.lit(False))
    views = images.groupBy("building_id", "view_id").agg(
        F.countDistinct(F.when(complete, F.col("year"))).alias("_years"), F.count_if(~complete).alias("_bad"), F.count("*").alias("_n")
    )
    out = views.groupBy("building_id").agg(F.max("_years").alias("longest"), F.sum("_bad").alias("incomplete"), F.sum("_n").alias("images"))
    kind = F.when(F.col("incomplete") > 0, "unknown").when(F.col("longest") <= 2, "short").when(F.col("longest") <= 7, "medium").otherwise("long")
    return out.withColumn("series", kind)


def seeded_hash(seed, *columns) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]), 256)


def assign_split(buildings: DataFrame, fixed: DataFrame, fractions: dict[str, float], seed=42) -> DataFrame:
    """Whole buildings to splits by hash order against cumulative weight quotas.

    Fixed owners never move and use up their split's quota. The order of
    buildings is a seeded hash rather than a local search, so results differ
    from a search by design but need one bounded pass.
    """
    owned = buildings.join(fixed, "building_id", "left")
    held = lambda s: F.sum(F.when(F.col("split") == s, F.col("weight")).otherwise(0))
    room = lambda s: F.greatest(F.lit(0.0), F.sum("weight") * fractions[s] - held(s)).alias(s)
    quota = owned.agg(F.struct(room("test"), room("val"))).scalar()
    free = owned.filter("split IS NULL").drop("split").withColumn("_hash", seeded_hash(seed, "building_id"))
    ranked = running_totals(free, [], hex_bucket(F.col("_hash")), ["_hash"], ["weight"]).withColumn("_q", quota)
    before = F.col("cum_weight") - F.col("weight")
    pick = F.when(before < F.col("_q.test"), "test").when(before < F.col("_q.test") + F.col("_q.val"), "val").otherwise("train")
    chosen = ranked.select("building_id", "weight", pick.alias("split"))
    return chosen.unionByName(owned.filter("split IS NOT NULL").select("building_id", "weight", "split"))


def _deviations(assigned: DataFrame, fractions: dict[str, float]) -> tuple[dict[str, float], dict[str, int]]:
    """Weight above target and number of buildings per split; three sums reach the driver."""
    rows = {r["split"]: r for r in assigned.groupBy("split").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    total = sum(float(r["w"]) for r in rows.values())
    return {s: (float(rows[s]["w"]) if s in rows else 0.0) - f * total for s, f in fractions.items()}, {s: rows[s]["n"] if s in rows else 0 for s in fractions}


def squared_deviation(assigned: DataFrame, fractions: dict[str, float]) -> float:
    """Sum over splits of the squared weight off the target."""
    return sum(d * d for d in _deviations(assigned, fractions)[0].values())


def balanced_split(buildings: DataFrame, fixed: DataFrame, fractions: dict[str, float], seed=42, rounds=200) -> DataFrame:
    """Whole buildings to splits by a search for the least squared deviation from the target weights.

    Starts from the hash order of ``assign_split``. Each round makes the best
    single move or swap of free buildings: what it gains depends on the moved
    weight alone and is best at half the difference of two deviations, so the
    nearest weights to that on both sides are enough. The search ends where
    none gains anything; it never ends above its start. A split keeps its last
    building. Of equal weights the building with the least id goes.
    """
    start = stored(assign_split(buildings, fixed, fractions, seed).join(fixed.select("building_id", F.lit(True).alias("_held")), "building_id", "left"), "split-start")
    moved: dict = {}
    kind = start.schema["building_id"].dataType
    assigned = start
    for _ in range(rounds):
        off, count = _deviations(assigned, fractions)
        free = assigned.filter("_held IS NULL").groupBy("split", "weight").agg(F.min("building_id").alias("id"))
        best = _best_exchange(stored(free, "split-weights"), off, count)
        if best is None:
            break
        for building, split in best:
            moved[building] = split
        changes = assigned.sparkSession.createDataFrame(list(moved.items()), f"building_id {kind.simpleString()}, _to string")
        # At most two buildings a round: bounded by ``rounds``.
        assigned = start.join(F.broadcast(changes), "building_id", "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")
    return assigned.select("building_id", "weight", "split")


def _best_exchange(free: DataFrame, off: dict[str, float], count: dict[str, int]):
    """[(building, new split), ...] of the move or swap that lowers the squared deviation most, or None."""
    splits = [s for s in off]
    gain = lambda d, want: 2 * d * (d - 2 * want)
    wants = {(s, t): (off[s] - off[t]) / 2 for s in splits for t in splits if s != t}
    weight, options = F.col("weight"), []
    asks = []
    for (s, t), want in wants.items():
        if count[s] > 1:
            here = F.col("split") == s
            asks += [F.max_by(F.struct("weight", "id"), F.when(here & (weight <= want), weight)).alias(f"{s}>{t}<"), F.min_by(F.struct("weight", "id"), F.when(here & (weight >= want), weight)).alias(f"{s}>{t}>")]
    if asks:
        row = free.agg(*asks).first()
        for (s, t), want in wants.items():
            for found in (row[f"{s}>{t}{end}"] for end in "<>" if f"{s}>{t}{end}" in row.asDict()):
                if found is not None and found["weight"] is not None:
                    options.append((gain(float(found["weight"]), want), [(found["id"], t)]))
    pairs = [(k, s, t) for k, (s, t) in enumerate((s, t) for i, s in enumerate(splits) for t in splits[i + 1:])]
    for r in _nearest_differences(free, [(k, s, t, wants[s, t]) for k, s, t in pairs]).collect():
        _, s, t = pairs[r["pair"]]
        options.append((gain(float(r["wa"]) - float(r["wb"]), wants[s, t]), [(r["ida"], t), (r["idb"], s)]))
    options = [o for o in options if o[0] < -1e-9]
    return min(options, key=lambda o: (o[0], len(o[1]), [str(b) for b, _ in o[1]]))[1] if options else None


def _nearest_differences(free: DataFrame, pairs, buckets=1024) -> DataFrame:
    """Per pair (number, s, t, want) the weights of s and t whose difference is nearest to ``want`` from below and from above.

    Both weight lists are merged in order, t's weights shifted by ``want``. Only
    one bucket of weights is ordered together; what stands before and after it
    is one value per bucket.
    """
    line = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(float(w)).alias("want")) for k, s, t, w in pairs]))
    weight = F.col("weight").cast("double")
    rows = free.select("split", "weight", "id", line.alias("_p")).select("split", "weight", "id", "_p.*").filter("split = s OR split = t")
    rows = rows.withColumn("place", F.when(F.col("split") == F.col("s"), weight).otherwise(weight + F.col("want")))
    span = rows.agg(F.struct(F.min("place").alias("low"), F.max("place").alias("high"))).scalar()
    part = F.floor((F.col("place") - F.col("_span.low")) / F.greatest(F.col("_span.high") - F.col("_span.low"), F.lit(1e-9)) * (buckets - 1)).cast("int")
    rows = rows.withColumn("_span", span).withColumn("_b", part).withColumn("_t", F.when(F.col("split") == F.col("t"), F.struct("place", "weight", "id")))
    ends = rows.groupBy("pair", "_b").agg(F.max("_t").alias("_last"), F.min("_t").alias("_first"))
    order = Window.partitionBy("pair").orderBy("_b")
    ends = ends.select("pair", "_b", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_under"), F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_over"))
    inner = Window.partitionBy("pair", "_b").orderBy("place")
    near = rows.withColumn("_low", F.max("_t").over(inner)).withColumn("_high", F.min("_t").over(inner.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    near = near.filter("split = s").join(ends, ["pair", "_b"])
    both = F.explode(F.array(F.coalesce("_low", "_under"), F.coalesce("_high", "_over"))).alias("_n")
    found = near.select("pair", "want", F.col("weight").alias("wa"), F.col("id").alias("ida"), "place", both).filter("_n IS NOT NULL")
    gap = F.col("wa") - F.col("_n.weight")
    # The exchange gains by how near the difference comes to the wanted one.
    best = F.struct(F.abs(gap - F.col("want")).alias("miss"), F.col("ida").cast("string").alias("tie"))
    return found.filter(gap != 0).groupBy("pair").agg(F.min_by(F.struct("wa", "ida", F.col("_n.weight").alias("wb"), F.col("_n.id").alias("idb")), best).alias("_f")).select("pair", "_f.*")


def assign_split_constrained(series: DataFrame, fixed: DataFrame, fractions: dict[str, float], seed=42) -> DataFrame:
    """Only medium series enter fresh holdouts, up to rounded building counts.

    One free medium building always stays in train; the rest keep their owner
    or go to train.
    """
    owned = series.join(fixed, "building_id", "left")
    want = lambda s: F.greatest(F.lit(0), F.round(F.count("*") * fractions[s]).cast("bigint") - F.count_if(F.col("split") == s))
    usable = F.greatest(F.lit(0), F.count_if(F.col("split").isNull() & (F.col("series") == "medium")) - 1)
    goals = owned.agg(F.struct(F.least(want("test"), usable).alias("test"), F.least(want("test") + want("val"), usable).alias("both"))).scalar()
    movable = owned.filter(F.col("split").isNull() & (F.col("series") == "medium")).withColumn("_hash", seeded_hash(seed, "building_id"))
    ranked = bucketed_rank(movable, [], hex_bucket(F.col("_hash")), ["_hash"], "_r").withColumn("_g", goals)
    picked = ranked.select("building_id", "series", F.when(F.col("_r") <= F.col("_g.test"), "test").when(F.col("_r") <= F.col("_g.both"), "val").otherwise("train").alias("split"))
    rest = owned.filter(F.col("split").isNotNull() | (F.col("series") != "medium")).select("building_id", "series", F.coalesce("split", F.lit("train")).alias("split"))
    return picked.unionByName(rest)


def split_deficits(assigned: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Wanted against actual building counts per holdout."""
    counts = assigned.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ("val", "test")],
        *[F.count_if((F.col("split") == s) & (F.col("series") == "medium")).alias(f"_{s}_medium") for s in ("val", "test")],
    )
    rows = F.array(*[
        F.struct(F.lit(s).alias("split"), F.round(F.col("_n") * fractions[s]).cast("bigint").alias("wanted"), F.col(f"_{s}").alias("actual"), F.col(f"_{s}_medium").alias("medium"))
        for s in ("val", "test")
    ])
    return counts.select(F.inline(rows)).withColumn("deficit", F.greatest(F.lit(0), F.col("wanted") - F.col("actual")))


def split_balance(images: DataFrame, fractions: dict[str, float], size=512, stride=448) -> DataFrame:
    """Images, crops and buildings per split with deviations from the target share."""
    per = images.groupBy("split").agg(
        F.count("*").alias("images"), F.sum(tile_count(F.col("width"), F.col("height"), size, stride)).alias("crops"), F.countDistinct("building_id").alias("buildings")
    )
    total = per.agg(F.struct(F.sum("images").alias("i"), F.sum("crops").alias("c"))).scalar()
    target = reduce(lambda acc, s: acc.when(F.col("split") == s, fractions[s]), SPLITS[1:], F.when(F.col("split") == SPLITS[0], fractions[SPLITS[0]]))
    return per.withColumn("_t", total).select(
        "split", "images", "crops", "buildings", (F.col("images") / F.col("_t.i")).alias("image_fraction"), (F.col("crops") / F.col("_t.c")).alias("crop_fraction"),
        (F.col("crops") / F.col("_t.c") - target).alias("crop_deviation"),
    )


def _owner_bits(split: Column) -> Column:
    return F.when(split == "train", 1).when(split == "val", 2).when(split == "test", 4).otherwise(0)


def _owner_name(bits: Column) -> Column:
    return F.when(bits == 1, "train").when(bits == 2, "val").when(bits == 4, "test")


def inherit_owner(images: DataFrame, history: DataFrame) -> DataFrame:
    """Owner of each reviewed building through any shared byte, view or building identity.

    Owners are kept as a 3-bit set, which merges map-side; two bits are a conflict.
    """
    owners = identities(history.filter(F.col("split").isin(*SPLITS)), [_owner_bits(F.col("split")).alias("_o")]).groupBy("kind", "value").agg(F.bit_or("_o").alias("_o"))
    usable = images.filter((F.col("image_status") == "ready") & (F.col("metadata_status") == "reviewed") & F.col("building_id").isNotNull())
    claims = identities(usable, [F.col("building_id").alias("building")]).distinct().join(owners, ["kind", "value"], "left")
    merged = claims.groupBy("building").agg(F.bit_or(F.coalesce("_o", F.lit(0))).alias("_o"))
    return merged.select(F.col("building").alias("building_id"), _owner_name(F.col("_o")).alias("inherited_split"), (F.bit_count("_o") > 1).alias("conflict"))


def history_union(*snapshots: DataFrame) -> DataFrame:
    fields = ["sha256", "split", "building_id", "view_id", "year"]
    rows = reduce(DataFrame.unionByName, [s.select(*fields) for s in snapshots])
    return rows.filter(F.col("split").isin(*SPLITS) & F.col("sha256").isNotNull()).distinct()


def merge_history(history: DataFrame) -> DataFrame:
    """One row per hash: null year/view may be filled; other differences conflict."""
    conflict = reduce(lambda a, b: a | b, [F.countDistinct(c) > 1 for c in ("building_id", "split", "view_id", "year")])
    mixed = F.countDistinct(F.coalesce("building_id", F.lit(""))) > 1
    return history.groupBy("sha256").agg(
        F.max("building_id").alias("building_id"), F.max("split").alias("split"), F.max("view_id").alias("view_id"), F.max("year").alias("year"), (conflict | mixed).alias("conflict")
    )


def frozen_problems(current: DataFrame, history: DataFrame) -> DataFrame:
    """Ownership changed by hash, bytes changed under a known name, ambiguous names."""
    old = history.groupBy("sha256").agg(F.max("building_id").alias("_b"), F.max("view_id").alias("_v"), F.max("year").alias("_y"), F.max("split").alias("_s"))
    joined = current.join(old, "sha256")
    filled = lambda a, b: F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    changed = joined.filter(
        ~F.col("_b").eqNullSafe(F.col("building_id")) | ~F.col("_s").eqNullSafe(F.col("split")) | filled("_v", "view_id") | filled("_y", "year")
    ).select(F.lit("ownership_changed").alias("problem"), F.col("image_id").cast("string").alias("item"))
    named = lambda df: df.withColumn("_name", normalized_name(F.col("file_name")))
    past = named(history).select("_name", "sha256").distinct()
    replaced = named(current).join(past.select("_name").distinct(), "_name", "left_semi").join(past, ["_name", "sha256"], "left_anti")
    replaced = replaced.select(F.lit("bytes_changed").alias("problem"), F.col("image_id").cast("string").alias("item"))
    everything = named(current.select("file_name", "sha256")).unionByName(named(history.select("file_name", "sha256")))
    ambiguous = everything.groupBy("_name").agg(F.countDistinct("file_name").alias("_f"), F.countDistinct("sha256").alias("_h")).filter("_f > 1 AND _h > 1")
    return changed.unionByName(replaced).unionByName(ambiguous.select(F.lit("ambiguous_name").alias("problem"), F.col("_name").alias("item")))


def auxiliary_train(images: DataFrame, holdout_history: DataFrame) -> DataFrame:
    """Unreviewed but usable rows for training: no holdout identity, each byte string once."""
    allowed = F.array(F.lit("metadata_not_reviewed"), F.lit("unknown_building"))
    candidate = images.filter(
        (F.col("image_status") == "ready") & F.col("sha256").isNotNull() & (F.size("reasons") > 0) & (F.size(F.array_except("reasons", allowed)) == 0)
    )
    kept = images.filter(F.size("reasons") == 0)
    hold = kept.filter(F.col("split").isin("val", "test")).select(*IDENTITY_KEYS).unionByName(holdout_history.filter(F.col("split").isin("val", "test")).select(*IDENTITY_KEYS))
    marks = identities(hold, []).distinct()
    bits = F.when(F.col("kind") == "sha256", 1).when(F.col("kind") == "view_id", 2).otherwise(4)
    hits = identities(candidate, ["image_id"]).join(marks, ["kind", "value"]).groupBy("image_id").agg(F.bit_or(bits).alias("_hit"))
    train = kept.filter("split = 'train'").select("sha256", F.lit(True).alias("_train")).distinct()
    joined = candidate.join(hits, "image_id", "left").join(train, "sha256", "left")
    open_rows = joined.filter("_hit IS NULL AND _train IS NULL")
    first = open_rows.groupBy("sha256").agg(F.min("image_id").alias("_first"))
    out = joined.join(first, "sha256", "left")
    names = F.concat_ws(",", F.when(F.col("_hit").bitwiseAND(F.lit(1)) != 0, "sha256"), F.when(F.col("_hit").bitwiseAND(F.lit(2)) != 0, "view_id"), F.when(F.col("_hit").bitwiseAND(F.lit(4)) != 0, "building_id"))
    outcome = (
        F.when(F.col("_hit").isNotNull(), F.concat(F.lit("known_holdout_overlap:"), names))
        .when(F.col("_train").isNotNull() | (F.col("_first") != F.col("image_id")), "duplicate_train_sha256").otherwise("included")
    )
    return out.select("image_id", outcome.alias("outcome"))


def cross_split(rows: DataFrame) -> DataFrame:
    """Identities owned by more than one split, as a mergeable bit-set."""
    owned = identities(rows.filter(F.col("split").isin(*SPLITS)), [_owner_bits(F.col("split")).alias("_o")])
    merged = owned.groupBy("kind", "value").agg(F.bit_or("_o").alias("_o"), F.count("*").alias("rows")).filter(F.bit_count("_o") > 1)
    names = F.concat_ws(",", *[F.when(F.col("_o").bitwiseAND(F.lit(b)) != 0, s) for b, s in ((4, "test"), (1, "train"), (2, "val"))])
    return merged.select("kind", "value", names.alias("splits"), "rows")


def views_with_many_buildings(rows: DataFrame) -> DataFrame:
    pairs = rows.select(folded(F.col("view_id")).alias("view_id"), folded(F.col("building_id")).alias("_b")).filter("view_id IS NOT NULL AND _b IS NOT NULL")
    return pairs.groupBy("view_id").agg(F.countDistinct("_b").alias("buildings")).filter("buildings > 1")


def partition_problems(images: DataFrame) -> DataFrame:
    """Every reason a set of reviewed partitions must be refused."""
    inside = images.filter(F.col("split").isin(*SPLITS))
    unreviewed = inside.filter(~F.col("metadata_status").eqNullSafe("reviewed") | F.col("building_id").isNull())
    parts = [
        unreviewed.select(F.lit("unreviewed").alias("problem"), F.col("image_id").cast("string").alias("item")),
        inside.filter("sha256 IS NULL").select(F.lit("missing_sha256").alias("problem"), F.col("image_id").cast("string").alias("item")),
        cross_split(inside).select(F.concat(F.lit("leak_"), "kind").alias("problem"), F.col("value").alias("item")),
        views_with_many_buildings(inside).select(F.lit("view_in_many_buildings").alias("problem"), F.col("view_id").alias("item")),
    ]
    return reduce(DataFrame.unionByName, parts)


def leakage_audit(images: DataFrame, assignments: DataFrame, history: DataFrame) -> DataFrame:
    """Violation rows by type; an empty result means the audit passed."""
    inside = images.filter(F.col("split").isin(*SPLITS))
    reviewed = folded(F.col("building_id")).isNotNull() & (F.col("metadata_status") == "reviewed")
    owners = [images.select("split", *IDENTITY_KEYS), history.select("split", *IDENTITY_KEYS)]
    assigned = assignments.select("split", "building_id", F.lit(None).cast("string").alias("view_id"), F.lit(None).cast("string").alias("sha256"))
    everything = reduce(DataFrame.unionByName, [*owners, assigned])
    row = lambda df, kind, item: df.select(F.lit(kind).alias("violation"), item.cast("string").alias("item"))
    parts = [
        row(images.groupBy("image_id").count().filter("count > 1"), "duplicate_image_id", F.col("image_id")),
        row(inside.filter(folded(F.col("sha256")).isNull()), "missing_sha256", F.col("image_id")),
        row(inside.filter((F.col("split") != "train") & ~reviewed), "unreviewed_holdout_image", F.col("image_id")),
        row(assignments.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)) | folded(F.col("building_id")).isNull()), "invalid_building_assignment", F.col("building_id")),
        row(cross_split(everything), "cross_split_identity", F.concat_ws("=", "kind", "value")),
        row(views_with_many_buildings(reduce(DataFrame.unionByName, owners)), "view_has_multiple_buildings", F.col("view_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def pair_audit(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Endpoint, split, identity, eligibility and duplicate-byte violations of pairs."""
    fields = ["split", "building_id", "view_id", "sha256", "metadata_status", "temporal_eligible"]
    ends = lambda p: images.select(F.col("image_id").alias(f"{p}_id"), F.struct(*fields).alias(f"_{p}"))
    joined = pairs.join(ends("reference"), "reference_id", "left").join(ends("source"), "source_id", "left")
    r, s = (lambda f: F.col(f"_reference.{f}")), (lambda f: F.col(f"_source.{f}"))
    missing = F.col("_reference").isNull() | F.col("_source").isNull()
    same = lambda f: F.coalesce((folded(F.col(f)) == folded(r(f))) & (folded(r(f)) == folded(s(f))), F.lit(False))
    bad = lambda e: (e("metadata_status") != "reviewed") | (e("temporal_eligible") == F.lit(False))
    checks = F.when(missing, F.array(F.lit("pair_missing_endpoint"))).otherwise(F.array_compact(F.array(
        F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)) | ~F.col("split").eqNullSafe(r("split")) | ~F.col("split").eqNullSafe(s("split")), "pair_split_mismatch"),
        F.when(~same("building_id"), "pair_identity_mismatch:building_id"), F.when(~same("view_id"), "pair_identity_mismatch:view_id"),
        F.when(bad(r) | bad(s), "pair_ineligible_endpoint"),
        F.when((F.col("reference_id") == F.col("source_id")) | (folded(r("sha256")) == folded(s("sha256"))), "pair_identical_observations"),
    )))
    return joined.select("pair_id", F.explode(checks).alias("violation"))


def same_split_duplicates(images: DataFrame) -> DataFrame:
    """Byte duplicates inside one split, with their size and first image."""
    inside = images.filter(F.col("split").isin(*SPLITS) & F.col("sha256").isNotNull())
    return inside.groupBy("split", "sha256").agg(F.count("*").alias("images"), F.min("image_id").alias("first_image")).filter("images > 1")


def split_transition(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("building_id", F.col("split").alias("previous")), after.select("building_id", F.col("split").alias("current"))
    joined = b.join(a, "building_id", "full_outer").filter(~F.col("previous").eqNullSafe(F.col("current")))
    return joined.withColumn("old_train_now_holdout", (F.col("previous") == "train") & F.coalesce(F.col("current").isin("val", "test"), F.lit(False)))


def absent_gold(gold: DataFrame, current: DataFrame) -> DataFrame:
    return gold.select("sha256").distinct().join(current.select("sha256"), "sha256", "left_anti")


def train_overlap(training: DataFrame, current: DataFrame) -> DataFrame:
    """Current rows that share an identity with a model's training set."""
    marks = identities(training, []).distinct()
    bits = F.when(F.col("kind") == "building_id", 1).when(F.col("kind") == "view_id", 2).otherwise(4)
    hits = identities(current, ["image_id", "split"]).join(marks, ["kind", "value"], "left_semi").groupBy("image_id", "split").agg(F.bit_or(bits).alias("_h"))
    names = F.concat_ws(",", *[F.when(F.col("_h").bitwiseAND(F.lit(b)) != 0, n) for b, n in ((1, "building_id"), (2, "view_id"), (4, "sha256"))])
    return hits.select("image_id", "split", names.alias("matched_on"))


def unverified_training(training: DataFrame) -> DataFrame:
    return training.filter(F.col("building_id").isNull() | (F.col("metadata_status") != "reviewed") | F.col("sha256").isNull()).select("image_id")


