"""Deterministic selection: hash ranks, round-robins, budgets and top-k picks.

"First n per group" uses map-side group limits; exact ranks over whole groups
use bucketed ranks; greedy picks run as a fixed number of mergeable rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import geometry as G
from driftlens.operators.ranks import bucketed_rank, first_n, hex_bucket, running_totals
from driftlens.operators.split import seeded_hash
from driftlens.session import cut_lineage


def hash_top(rows: DataFrame, group, identity, n: int, seed=42, name="rank") -> DataFrame:
    """The n rows of each group with the smallest seeded hash."""
    hashed = rows.withColumn("_h", seeded_hash(seed, *identity))
    return first_n(hashed, group, ["_h"], n, name).drop("_h")


def complete_bases(cases: DataFrame, base, dims: dict[str, int]) -> DataFrame:
    """Relational division: bases that hold every combination exactly once.

    ``dims`` gives the dimension columns; the number of combinations is the
    product of a base's own distinct scenarios and the fixed other dimensions.
    """
    (a, na), (b, _) = dims.items()
    per = cases.groupBy(base).agg(F.count("*").alias("_n"), F.countDistinct(a, b).alias("_k"), F.countDistinct(b).alias("_b"), F.countDistinct(a).alias("_a"))
    return per.filter((F.col("_n") == F.col("_k")) & (F.col("_k") == F.col("_b") * na) & (F.col("_a") == na)).select(base)


def select_crops(crops: DataFrame, splits, minimum: float, per_building: int) -> DataFrame:
    """Diverse crops per building and the reason each other crop was left out.

    Order is (rank inside its view, rank inside its reference, hash), a
    set-based reading of "prefer unused views, then unused references".
    Needs crop_id, building_id, view_id, reference_hash, crop_hash, split, valid_fraction.
    """
    early = F.when(~F.col("split").isin(*splits), "outside_requested_split").when(F.col("valid_fraction") < minimum, "below_min_valid_fraction")
    marked = crops.withColumn("reason", early)
    fit = marked.filter("reason IS NULL")
    firsts = fit.groupBy("building_id", "crop_hash").agg(F.min("crop_id").alias("_first"))
    fit = fit.join(firsts, ["building_id", "crop_hash"])
    unique = fit.filter("crop_id = _first").withColumn("_h", F.sha2(F.concat_ws("/", F.col("building_id").cast("string"), "view_id", "reference_hash", "crop_hash"), 256))
    ranked = bucketed_rank(unique, ["building_id", "view_id"], hex_bucket(F.col("_h")), ["_h"], "_rv")
    ranked = bucketed_rank(ranked, ["building_id", "reference_hash"], hex_bucket(F.col("_h")), ["_h"], "_rr")
    picked = first_n(ranked, ["building_id"], ["_rv", "_rr", "_h"], per_building, "pick").select("crop_id", "pick")
    out = marked.join(fit.select("crop_id", (F.col("crop_id") != F.col("_first")).alias("_dup")), "crop_id", "left").join(picked, "crop_id", "left")
    reason = F.coalesce("reason", F.when(F.col("_dup"), "duplicate_reference_rgb"), F.when(F.col("pick").isNull(), "crop_budget"))
    return out.select("crop_id", "building_id", "split", "pick", reason.alias("reason"))


def water_level(rows: DataFrame, keys, capacity: str, budget: Column) -> DataFrame:
    """Integer level L and leftover R with sum(min(cap, L)) + R = min(budget, sum(cap)).

    Computed on distinct capacities, so the number of rows per key is bounded
    by distinct capacity values.
    """
    keys = list(keys)
    hist = rows.groupBy(*keys, F.col(capacity).alias("_c")).agg(F.count("*").alias("_n"), F.sum(capacity).alias("_s"))
    run = running_totals(hist, keys, F.floor(F.log2(F.col("_c") + 1) * 16), ["_c"], ["_n", "_s"])
    fits = run.withColumn("_budget", budget).withColumn("_used", F.col("cum__s") + F.col("_c") * (F.col("all__n") - F.col("cum__n")))
    best = fits.groupBy(*keys, "_budget").agg(
        F.max_by(F.struct("_c", "_used", (F.col("all__n") - F.col("cum__n")).alias("_open")), F.when(F.col("_used") <= F.col("_budget"), F.col("_c"))).alias("_m"),
        F.max("all__n").alias("_n"), F.max("all__s").alias("_cap"),
    )
    base = F.coalesce(F.col("_m._c"), F.lit(0))
    open_rows = F.coalesce(F.col("_m._open"), F.col("_n"))
    left = F.greatest(F.lit(0), F.least(F.col("_budget"), F.col("_cap")) - F.coalesce(F.col("_m._used"), F.lit(0)))
    return best.select(
        *keys, (base + F.when(open_rows > 0, F.floor(left / open_rows)).otherwise(0)).cast("bigint").alias("level"),
        F.when(open_rows > 0, left % open_rows).otherwise(0).cast("bigint").alias("leftover"),
    )


def allocate(rows: DataFrame, keys, capacity: str, order, bucket: Column, budget: Column, name="allocated") -> DataFrame:
    """Water-filling: everyone gets the level, the first open rows one more."""
    keys = list(keys)
    levels = water_level(rows, keys, capacity, budget)
    if keys:
        joined = rows.join(levels, keys)
    else:
        joined = rows.withColumn("_w", levels.select(F.struct("level", "leftover")).scalar()).select("*", "_w.*").drop("_w")
    still_open = F.col(capacity) > F.col("level")
    ranked = bucketed_rank(joined.withColumn("_open", still_open), [*keys, "_open"], bucket, order, "_r")
    extra = F.when(F.col("_open") & (F.col("_r") <= F.col("leftover")), 1).otherwise(0)
    return ranked.withColumn(name, (F.least(F.col(capacity), F.col("level")) + extra).cast("bigint")).drop("level", "leftover", "_open", "_r")


def allocate_cells(cases: DataFrame, budget: int) -> DataFrame:
    """Equal shares per (building, scenario) cell, then per case of the cell."""
    cases = cut_lineage(cases)  # four narrow columns, read several times below
    cells = cases.groupBy("building_id", "scenario").agg(F.sum("capacity").alias("capacity"))
    cells = cells.withColumn("_o", F.sha2(F.concat_ws("/", F.col("building_id").cast("string"), "scenario"), 256))
    shares = allocate(cells, [], "capacity", ["_o"], hex_bucket(F.col("_o")), F.lit(budget), "_share").select("building_id", "scenario", "_share")
    joined = cases.join(shares, ["building_id", "scenario"]).withColumn("_o", F.sha2(F.col("case_id").cast("string"), 256))
    return _allocate_by_share(joined)


def _allocate_by_share(joined: DataFrame) -> DataFrame:
    keys = ["building_id", "scenario", "_share"]
    out = allocate(joined, keys, "capacity", ["_o"], hex_bucket(F.col("_o")), F.col("_share"), "allocated")
    return out.drop("_share", "_o")


def sample_positions(pixels: DataFrame, case: str, position: str, wanted: str, seed=42) -> DataFrame:
    """Exactly ``wanted`` positions per case without replacement, by hash rank."""
    hashed = pixels.withColumn("_h", seeded_hash(seed, case, position))
    ranked = bucketed_rank(hashed, [case], hex_bucket(F.col("_h")), ["_h"], "_r")
    return ranked.filter(F.col("_r") <= F.col(wanted)).drop("_h", "_r")


def round_robin_tiles(tiles: DataFrame, cell, identity, split, budget: int, seed=42) -> DataFrame:
    """One tile per cell and round in hash order until the split's budget is spent."""
    hashed = tiles.withColumn("_h", seeded_hash(seed, *identity)).withColumn("_cell", seeded_hash(seed, *cell))
    rounds = first_n(hashed, [split, *cell], ["_h"], budget, "round")
    return first_n(rounds, [split], ["round", "_cell"], budget, "pick").drop("_h", "_cell")


def inspection_coverage(tiles: DataFrame, case, fractions) -> DataFrame:
    """Share of positives and of pixels inside the top ceil(f x n) tiles by maximum score.

    ``tiles`` is (case, ty, tx, score, positives, pixels). Ties use grid order.
    """
    ranked = bucketed_rank(
        tiles, [case], -F.floor(F.col("score") * 1024), [("score", "desc"), "ty", "tx"], "_r", total="_tiles"
    )
    spread = ranked.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    inside = F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_tiles") * F.col("fraction")))
    out = spread.groupBy(case, "fraction").agg(
        F.count("*").alias("tiles"), F.count_if(inside).alias("selected_tiles"),
        (F.sum(F.when(inside, F.col("pixels")).otherwise(0)) / F.sum("pixels")).alias("pixel_share"), F.sum("positives").alias("_p"),
        F.sum(F.when(inside, F.col("positives")).otherwise(0)).alias("_i"),
    )
    return out.withColumn("recall", F.when(F.col("_p") > 0, F.col("_i") / F.col("_p"))).drop("_p", "_i")


def gallery_pick(entries: DataFrame, group, order, limit: int) -> DataFrame:
    """Worst entry per group first (group order), then the worst of the rest."""
    worst = first_n(entries, group, order, 1, "_w").drop("_w").withColumn("_stage", F.lit(0))
    head = worst.orderBy(*group).limit(limit)
    top = entries.orderBy(*order).limit(2 * limit).join(head.select("case_id"), "case_id", "left_anti").withColumn("_stage", F.lit(1))
    # At most 3 x limit rows remain.
    place = Window.partitionBy("_stage").orderBy(*order)
    by_group = Window.partitionBy("_stage").orderBy(*group)
    merged = head.unionByName(top).withColumn("_k", F.when(F.col("_stage") == 0, F.row_number().over(by_group)).otherwise(F.row_number().over(place)))
    return merged.withColumn("pick", F.row_number().over(Window.orderBy("_stage", "_k"))).filter(F.col("pick") <= limit).drop("_stage", "_k")


def facade_round_robin(rows: DataFrame, split_order, order, limit: int) -> DataFrame:
    """First of every split in turn: test, val, train, test, ..."""
    ranked = first_n(rows, ["split"], order, limit, "_round")
    turn = F.array_position(F.array(*[F.lit(s) for s in split_order]), F.col("split"))
    # At most limit rows per split remain.
    return ranked.withColumn("pick", F.row_number().over(Window.orderBy("_round", turn))).filter(F.col("pick") <= limit).drop("_round")


def nonoverlap_pick(crops: DataFrame, group, parent, order, per_group: int, max_iou=0.25) -> DataFrame:
    """Greedy non-overlapping choice in ``per_group`` rounds.

    Each round takes the best remaining crop of every group with a mergeable
    aggregate and removes what overlaps it, which equals the sequential rule
    and never gathers a group. ``order`` is a struct to minimise; its last field
    should break ties. Candidates are read from a narrow checkpoint each round.
    """
    boxes = ["x", "y", "w", "h"]
    remaining, chosen = cut_lineage(crops.select("crop_id", group, parent, *boxes, order.alias("_order"))), None
    for step in range(1, per_group + 1):
        best = cut_lineage(remaining.groupBy(group).agg(F.min_by(F.struct("crop_id", parent, *boxes), "_order").alias("_b")).withColumn("pick", F.lit(step)))
        picked = best.select(F.col("_b.crop_id").alias("crop_id"), group, "pick")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if step == per_group:
            break
        mine = [F.col(c) for c in boxes]
        theirs = [F.col(f"_b.{c}") for c in boxes]
        clash = (F.col(parent) == F.col(f"_b.{parent}")) & ((F.col("crop_id") == F.col("_b.crop_id")) | (G.box_iou(mine, theirs) > max_iou))
        remaining = remaining.join(best.select(group, "_b"), group).filter(~clash).drop("_b")
    return chosen


def even_spaced(keys: DataFrame, order: str, bucket: Column, n: int) -> DataFrame:
    """Rows at n evenly spaced positions of an ordered list."""
    ranked = bucketed_rank(keys, [], bucket, [order], "_r", total="_n")
    count = F.least(F.lit(n), F.col("_n"))
    steps = F.greatest(F.lit(1), count - 1)
    j = F.ceil((F.col("_r") - 1) * steps / F.greatest(F.lit(1), F.col("_n") - 1))
    hit = (F.floor(j * (F.col("_n") - 1) / steps) == F.col("_r") - 1) & (j <= count - 1)
    return ranked.filter(hit).withColumn("position", F.col("_r") - 1).drop("_r", "_n")


def round_robin_windows(windows: DataFrame, order, limit: int) -> DataFrame:
    """Interleave event types, then class groups, strongest first in each group.

    Group order inside an event type comes from the distinct groups (a small
    table); depth comes from a map-side limited rank.
    """
    group = ["event", "from_class", "to_class"]
    kinds = F.array(*[F.lit(k) for k in ("replacement", "appearance", "disappearance")])
    groups = windows.select(*group).distinct().withColumn("_index", F.row_number().over(Window.partitionBy("event").orderBy("from_class", "to_class")))
    deep = first_n(windows, group, order, limit, "depth")
    placed = deep.join(groups, group).withColumn("_kind", F.array_position(kinds, F.col("event")))
    # WindowGroupLimit keeps at most limit rows per group before this last order.
    return first_n(placed, [], ["depth", "_index", "_kind"], limit, "pick").drop("_index", "_kind")


def quick_subset(bases: DataFrame, cases: DataFrame, families, max_bases=10, seed=42) -> DataFrame:
    """About 30 % VAL bases, one per building, with two rotating nuisance families each.

    ``cases`` holds (base_id, family, scenario_id). After the first limit the
    tables have at most ``max_bases`` bases, so plain windows are enough.
    """
    one = bases.filter(F.col("split").isin("val", "test")).groupBy("split", "building_id").agg(
        F.min_by("base_id", F.struct(seeded_hash(seed, "split", "building_id", "base_id"), "base_id")).alias("base_id")
    )
    ranked = first_n(one.withColumn("_h", seeded_hash(seed, "split", "building_id")), ["split"], ["_h", "building_id"], max_bases, "_r")
    target = max(1, round(max_bases * 0.3))
    have = lambda part: F.count_if(F.col("split") == part)
    val = F.least(F.lit(target), have("val"))
    test = F.least(max_bases - val, have("test"))
    val = F.least(have("val"), val + (max_bases - val - test))
    quota = ranked.agg(F.struct(val.alias("val"), test.alias("test"))).scalar()
    picked = ranked.withColumn("_q", quota).filter(F.col("_r") <= F.when(F.col("split") == "val", F.col("_q.val")).otherwise(F.col("_q.test")))
    picked = picked.withColumn("position", F.row_number().over(Window.orderBy(F.col("split").desc(), "_r")) - 1).select("split", "building_id", "base_id", "position")
    have_family = cases.join(picked, "base_id", "left_semi").groupBy("base_id", "family").agg(F.array_sort(F.collect_set("scenario_id")).alias("_scenarios"))
    turn = F.pmod(F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1 - F.pmod(2 * F.col("position"), F.lit(len(families))), F.lit(len(families)))
    chosen = first_n(picked.join(have_family, "base_id").withColumn("_turn", turn), ["base_id"], ["_turn"], 2, "slot")
    times = F.row_number().over(Window.partitionBy("family").orderBy("position")) - 1
    scenario = F.element_at("_scenarios", (F.pmod(times, F.size("_scenarios")) + 1).cast("int"))
    return chosen.select("split", "building_id", "base_id", "position", "slot", "family", scenario.alias("scenario_id"))
