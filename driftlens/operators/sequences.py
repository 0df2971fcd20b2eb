"""Sequences of aligned frames, method choice, cohorts and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.digest import row_id
from driftlens.functions.metrics import ratio


def training_exposure(rows: DataFrame, seen: DataFrame, status: dict[str, str], building="building_id") -> DataFrame:
    """seen / verified_unseen / unknown per method and building.

    ``seen`` lists (method, building) of known training data; ``status`` is the
    verification state per method. Joined as a plain equi-join: the list may
    grow with the data.
    """
    mark = seen.select("method", building).distinct().withColumn("_seen", F.lit(True))
    verified = F.col("method").isin([m for m, s in status.items() if s in ("verified", "not_project_trained")])
    joined = rows.join(mark, ["method", building], "left")
    kind = F.when(F.col("_seen"), "seen").when(verified, "verified_unseen").otherwise("unknown")
    return joined.withColumn("exposure", kind).drop("_seen")


def combined_exposure(exposures: Column) -> Column:
    """Worst case over the methods of a fusion."""
    return F.when(F.array_contains(exposures, "seen"), "seen").when(F.array_contains(exposures, "unknown"), "unknown").otherwise("verified_unseen")


CHAIN = ["split", "building_id", "view_id"]


def sequence_chains(images: DataFrame, prepared: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, frames): status per view history and its ordered accepted frames.

    ``prepared`` lists (reference_id, source_id); ``attempts`` holds
    (reference_sha, source_sha, rank, passed, compatible, geometry_ok).
    Windows run only over groups with one photo per year, so at most 301 rows.
    """
    sizes = images.groupBy(*CHAIN).agg(F.count("*").alias("observations"), F.countDistinct("year").alias("_years"))
    order = F.struct("year", F.col("image_id").cast("string"))
    sizes = sizes.withColumn("_problem", F.when(F.col("observations") < 2, "fewer_than_two_observations").when(F.col("_years") != F.col("observations"), "ambiguous_same_year_observations"))
    usable = images.join(sizes.filter("_problem IS NULL").select(*CHAIN), CHAIN)
    anchors = usable.groupBy(*CHAIN).agg(F.min_by(F.struct("image_id", "sha256"), order).alias("_a"))
    rows = usable.join(anchors, CHAIN)
    is_anchor = F.col("image_id") == F.col("_a.image_id")
    ready = prepared.select(F.col("reference_id").alias("_r"), F.col("source_id").alias("image_id"), F.lit(True).alias("_ready")).distinct()
    tried = attempts.groupBy("reference_sha", "source_sha").agg(
        F.count_if("compatible").alias("_tries"), F.count_if(F.col("compatible") & F.col("passed")).alias("_passed"),
        F.count_if(F.col("compatible") & F.col("passed") & F.col("geometry_ok")).alias("_sound"), F.count("*").alias("_all"),
        F.min(F.when(F.col("compatible") & F.col("passed") & F.col("geometry_ok"), F.col("rank"))).alias("chosen_attempt"),
    )
    rows = rows.join(ready, (F.col("_a.image_id") == F.col("_r")) & (rows.image_id == ready.image_id), "left").drop(ready.image_id).drop("_r")
    rows = rows.join(tried, (F.col("_a.sha256") == F.col("reference_sha")) & (F.col("sha256") == F.col("source_sha")), "left")
    pair_status = (
        F.when(is_anchor, "accepted").when(F.col("_ready").isNull(), "missing_prepared_pair").when(F.coalesce("_all", F.lit(0)) == 0, "missing_alignment")
        .when(F.col("_passed") == 0, "rejected_or_failed_alignment").when(F.col("_sound") == 0, "invalid_alignment_geometry").otherwise("accepted")
    )
    rows = rows.withColumn("pair_status", pair_status).withColumn("chosen_attempt", F.when(~is_anchor, F.col("chosen_attempt")))
    w = Window.partitionBy(*CHAIN).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    accepted = F.col("pair_status") == "accepted"
    rows = rows.withColumn("frame", F.when(accepted, F.count_if(accepted).over(w) - 1))
    per = rows.groupBy(*CHAIN).agg(
        F.count_if(accepted).alias("usable"), F.bool_and(~accepted | F.col("file_present")).alias("_files"),
        F.array_sort(F.collect_list(F.when(accepted, F.struct("frame", "sha256")))).alias("_hashes"),
    )
    joined = sizes.join(per, CHAIN, "left")
    status = (
        F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("usable") < 2, "no_accepted_source")
        .when(~F.col("_files"), "missing_rgb_files").otherwise("accepted")
    )
    groups = joined.select(
        *CHAIN, "observations", F.coalesce("usable", F.lit(0)).alias("usable"), status.alias("status"),
        F.when(status == "accepted", row_id([*[F.col(c) for c in CHAIN], F.concat_ws(",", F.transform("_hashes", lambda h: h["sha256"]))])).alias("sequence_id"),
    )
    return groups, rows.select(*CHAIN, "image_id", "year", "pair_status", "frame", "chosen_attempt")


def choose_method(results: DataFrame, priority, key="pair_id") -> DataFrame:
    """First passed method by priority; otherwise the statuses that excluded the pair."""
    place = F.array_position(F.array(*[F.lit(m) for m in priority]), F.col("method"))
    passed = F.when((F.col("status") == "passed") & (place > 0), place)
    texts = F.concat_ws(";", *[
        F.concat(F.lit(f"{m}:"), F.coalesce(F.max(F.when(F.col("method") == m, F.col("status"))), F.lit("not_attempted"))) for m in priority
    ])
    out = results.groupBy(key).agg(F.min(passed).alias("_p"), texts.alias("_t"))
    chosen = F.element_at(F.array(*[F.lit(m) for m in priority]), F.col("_p").cast("int"))
    return out.select(key, F.when(F.col("_p").isNotNull(), chosen).alias("method"), F.when(F.col("_p").isNull(), F.col("_t")).alias("excluded_statuses"))


def attempt_comparison(pairs: DataFrame, results: DataFrame, methods, key="pair_id") -> DataFrame:
    """Outcome counts per method on one denominator, failures included."""
    statuses = ("passed", "rejected", "failed")
    folded = results.groupBy(key).agg(*[F.max(F.when(F.col("method") == m, F.col("status"))).alias(f"_{m}") for m in methods])
    wide = pairs.select(key).join(folded, key, "left").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(f"_{m}") == s).alias(f"_{m}_{s}") for m in methods for s in statuses],
        *[F.count_if(F.col(f"_{m}").isNull()).alias(f"_{m}_none") for m in methods],
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("method"), *[F.col(f"_{m}_{s}").alias(s) for s in statuses], F.col(f"_{m}_none").alias("not_attempted"), ratio(F.col(f"_{m}_passed"), F.col("_n")).alias("passed_fraction"))
        for m in methods
    ])
    return wide.select(F.inline(rows))


def two_method_outcomes(pairs: DataFrame, results: DataFrame, a, b, key="pair_id") -> DataFrame:
    folded = results.groupBy(key).agg(*[F.max(F.when(F.col("method") == m, F.col("status"))).alias(n) for n, m in (("_a", a), ("_b", b))])
    joined = pairs.select(key).join(folded, key, "left")
    x, y = F.col("_a") == "passed", F.col("_b") == "passed"
    kind = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "not_fully_attempted").when(x & y, "both").when(x, f"{a}_only").when(y, f"{b}_only").otherwise("neither")
    )
    return joined.groupBy(kind.alias("outcome")).agg(F.count("*").alias("pairs"))


def gate_reasons(minimums: dict[str, float]) -> Column:
    """Names of the diagnostics below their minimum; empty means passed."""
    return F.array_compact(F.array(*[F.when(F.col(c) < m, F.lit(c)) for c, m in minimums.items()]))


def history_inventory(images: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per split and building: images, years, views, accepted pairs and long histories."""
    views = images.groupBy("split", "building_id", "view_id").agg(F.count("*").alias("_i"), F.countDistinct("year").alias("_y"))
    pairs = accepted.groupBy("view_id").agg(F.count("*").alias("_p"))
    joined = views.join(pairs, "view_id", "left")
    years = images.groupBy("split", "building_id").agg(F.countDistinct("year").alias("years"))
    out = joined.groupBy("split", "building_id").agg(
        F.sum("_i").alias("images"), F.count("*").alias("views"), F.sum(F.coalesce("_p", F.lit(0))).alias("accepted_pairs"), F.count_if(F.col("_y") >= 3).alias("long_histories")
    )
    return out.join(years, ["split", "building_id"])


def overlay(base: DataFrame, retry: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(merged, failures): a completed retry replaces the same key; failed retries stay apart."""
    done = retry.filter("status = 'completed'")
    merged = base.join(done, list(keys), "left_anti").unionByName(done)
    return merged, retry.filter("status != 'completed'")


def common_cohort(maps: DataFrame, unit_keys, predictors: int) -> DataFrame:
    """Units every predictor has, decided by a distinct count (semi-join key)."""
    return maps.groupBy(*unit_keys).agg(F.countDistinct("predictor").alias("_n")).filter(F.col("_n") == predictors).drop("_n")


def shared_support(pixels: DataFrame, pixel_keys, predictors: int) -> DataFrame:
    """Pixels supported by every predictor."""
    return pixels.groupBy(*pixel_keys).agg(F.count_if("support").alias("_n"), F.count("*").alias("_a")).filter((F.col("_n") == predictors) & (F.col("_a") == predictors)).drop("_n", "_a")


def replay_problems(selection: DataFrame, index: DataFrame, key: str, payload) -> DataFrame:
    """Exact replay: unknown, duplicate, changed and reordered rows.

    Both sides carry ``position``; order must rise with the index position.
    """
    once = selection.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct("position", *payload)).alias("_s"))
    known = index.select(key, F.struct("position", *payload).alias("_i"))
    joined = once.join(known, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(f"_s.{p}").eqNullSafe(F.col(f"_i.{p}")) for p in payload])
    checks = F.array_compact(F.array(
        F.when(F.col("_i").isNull(), "unknown"), F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("_i").isNotNull() & ~same, "changed"),
    ))
    rows = joined.select(key, F.explode(checks).alias("problem"))
    # A saved row is out of order when the row saved just before it comes later
    # in the index; the neighbour is found by position, not by a global sort.
    placed = selection.select(key, F.col("position").alias("_at")).join(index.select(key, F.col("position").alias("_ix")), key)
    after = placed.select((F.col("_at") + 1).alias("_at"), F.col("_ix").alias("_before"))
    moved = placed.join(after, "_at").filter(F.col("_before") > F.col("_ix")).select(key, F.lit("reordered").alias("problem"))
    return rows.unionByName(moved)


def provenance_problems(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against recomputed hashes, in both directions."""
    joined = recorded.select("path", F.col("digest").alias("_r")).join(actual.select("path", F.col("digest").alias("_a")), "path", "full_outer")
    kind = F.when(F.col("_a").isNull(), "file_missing").when(F.col("_r").isNull(), "not_recorded").when(F.col("_r") != F.col("_a"), "hash_differs")
    return joined.select("path", kind.alias("problem")).filter("problem IS NOT NULL")


def arm_problems(units: DataFrame, frames=5) -> DataFrame:
    """Every base needs clean and event arms with equal nuisance and consecutive frames."""
    pairs = units.groupBy("base_id", "frame").agg(
        F.count_if(F.col("arm") == "clean").alias("_c"), F.count_if(F.col("arm") == "event").alias("_e"), F.countDistinct("nuisance").alias("_n")
    )
    base = pairs.groupBy("base_id").agg(
        F.bool_and((F.col("_c") == 1) & (F.col("_e") == 1)).alias("_arms"), F.bool_and(F.col("_n") == 1).alias("_same"),
        F.min("frame").alias("_lo"), F.max("frame").alias("_hi"), F.count("*").alias("_k"),
    )
    checks = F.array_compact(F.array(
        F.when(~F.col("_arms"), "arms_incomplete"), F.when(~F.col("_same"), "nuisance_differs"),
        F.when((F.col("_k") != frames) | (F.col("_hi") - F.col("_lo") != frames - 1), "frames_not_consecutive"),
    ))
    return base.select("base_id", F.explode(checks).alias("problem"))


def category_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Category ids and channels must match one to one, without reordering."""
    per = actual.groupBy("category_id").agg(F.count("*").alias("_n"), F.min("channel").alias("_c"))
    joined = expected.select("category_id", F.col("channel").alias("_e")).join(per, "category_id", "full_outer")
    kind = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate").when(F.col("_c") != F.col("_e"), "reordered")
    )
    return joined.select("category_id", kind.alias("problem")).filter("problem IS NOT NULL")
