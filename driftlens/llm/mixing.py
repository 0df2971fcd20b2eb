"""Mixing sources to target weights by entropy balancing.

Sources in code-point order, NULL last, weigh 1, 2, 3, 1, ... and share all
words; a target stops at ``CAP`` times its source's words and the excess is
shared again. Within a source the document rates w minimise the relative
entropy to equal rates under the word constraint sum(w * words) = target and
w <= CAP. The dual has one multiplier per source and the solution is an
exponential tilt, w = min(CAP, exp(lambda * words / mean words)). Distributed
Newton steps (kept inside a bracket) solve the duals of all sources at once on
the histogram of (source, words).

Rates become whole copies: the integer part for all, and one more for the
documents that systematic rounding over the sizes of a source picks, by id hash
among equal sizes. The words taken differ from the target by less than the
largest document with a fractional rate.

All of it is DataFrame functions. Sums that decide anything are decimals or
integers, so reruns agree whatever the order of rows. NULL and empty texts have
size 0 and are taken 0 times their nothing; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import WORD, table, written

CAP, ROUNDS, UNIT, BLOCK = 3, 80, 1 << 20, 1000


def sizes(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("words"))


def ranked_sources(cells: DataFrame) -> DataFrame:
    """Rows (sid, source, size, docs) with sid 0, 1, ... in code-point order, NULL last."""
    sums = cells.groupBy("source").agg(F.sum(F.col("words") * F.col("c")).alias("size"), F.sum("c").alias("docs"))
    ordered = written(sums.sort(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_m", 33)
    starts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort, so the window and the join's small side are bounded by the partition count.
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ordered.withColumn("_p", part).join(starts, "_p")
    return joined.select((F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("sid"), "source", "size", "docs")


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: shares by weight 1, 2, 3, repeating, stopped at CAP times the size.

    Every round only brings three sums to the driver.
    """
    sources = sources.withColumn("_w", 1 + F.pmod("sid", F.lit(3))).withColumn("_most", CAP * F.col("size"))
    level = F.lit(0.0)
    stopped = -1
    while True:
        full = F.col("_most") < level * F.col("_w")
        row = sources.agg(
            F.sum("size").alias("all"), F.sum(F.when(full, F.col("_most")).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("_w"))).alias("weight"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["all"] or not row["weight"] or row["n"] == stopped:
            break
        stopped, level = row["n"], F.lit((row["all"] - row["held"]) / row["weight"])
    target = F.least(F.col("_most").cast("double"), level * F.col("_w"))
    return sources.withColumn("target", target).drop("_w", "_most")


def rate(multiplier, words, mean):
    """min(CAP, exp(multiplier * words / mean)); a NULL multiplier means CAP throughout."""
    top = F.log(F.lit(float(CAP)))
    tilt = multiplier * words / mean
    return F.when(multiplier.isNull() | (tilt >= top), F.lit(float(CAP))).otherwise(F.exp(F.least(tilt, top)))


def multipliers(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (sid, lam): Newton on every source's dual until each constraint holds to a millionth."""
    mean = F.greatest(F.col("size") / F.col("docs"), F.lit(1e-9))
    state = sources.select(
        "sid", "target", mean.alias("mean"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        # A source at its cap has no finite multiplier.
        F.when(F.col("target") < CAP * F.col("size"), F.lit(0.0)).otherwise(F.when(F.col("size") == 0, F.lit(0.0))).alias("lam"), F.lit(False).alias("done"),
    )
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(ROUNDS):
        tilted = cells.join(state.filter(~F.col("done") & F.col("lam").isNotNull()), "sid")
        w = rate(F.col("lam"), F.col("words"), F.col("mean"))
        mass = F.col("c") * F.col("words") * w
        slope = F.when(w < CAP, mass * F.col("words") / F.col("mean")).otherwise(0.0)
        sums = tilted.groupBy("sid").agg(exact(mass).alias("_f"), exact(slope).alias("_g"))
        gap = F.col("_f") - F.col("target")
        over = gap > 0
        hi, lo = F.when(over, F.col("lam")).otherwise(F.col("hi")), F.when(~over, F.col("lam")).otherwise(F.col("lo"))
        step = F.greatest(F.lit(2.0), F.abs("lam"))
        newton = F.col("lam") - F.when(F.col("_g") > 0, gap / F.col("_g")).otherwise(F.when(over, step).otherwise(-step))
        newton = F.greatest(F.col("lam") - step, F.least(F.col("lam") + step, newton))
        inside = (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        fine = F.col("_f").isNull() | (F.abs(gap) <= 0.1 + F.col("target") * 1e-6)
        state = written(
            state.join(sums, "sid", "left").select(
                "sid", "target", "mean", lo.alias("lo"), hi.alias("hi"),
                F.when(fine, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"), (F.col("done") | fine).alias("done"),
            ), "multipliers",
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("sid", "lam", "mean")


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, words, source_size, target, rate, copies), one per input row."""
    sized = written(sizes(docs), "sizes")
    counted = written(sized.groupBy("source", "words").agg(F.count("*").alias("c")), "cells")
    sources = written(with_targets(ranked_sources(counted)), "targets")
    cells = written(counted.join(sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "cells")
    solved = sources.join(multipliers(cells, sources), "sid").select("sid", "size", "target", "lam", "mean")
    rated = cells.join(solved, "sid").withColumn("rate", rate(F.col("lam"), F.col("words"), F.col("mean")))
    rated = rated.withColumn("_base", F.floor("rate")).withColumn("_part", F.floor((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    # One row per distinct size of a source.
    before = Window.partitionBy("sid").orderBy("words").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("_before", F.coalesce(F.sum(F.col("c") * F.col("_part")).over(before), F.lit(0)))
    rated = written(
        rated.select(F.col("source").alias("_s"), F.col("words").alias("_n"), "sid", F.col("size").alias("source_size"), "target", "rate", "_base", "_part", "_before", F.ceil(F.col("c") / BLOCK).alias("_blocks")), "rates",
    )
    hashed = F.xxhash64("doc_id")
    joined = sized.join(rated, F.col("source").eqNullSafe(F.col("_s")) & (F.col("words") == F.col("_n")))
    joined = joined.withColumn("_hash", hashed).withColumn("_block", F.when(F.col("_blocks") > 1, F.pmod(hashed, F.col("_blocks"))).otherwise(F.lit(0)))
    # Sizes that many documents share are cut into blocks of about BLOCK documents, each with its own offset.
    blocks = joined.filter(F.col("_blocks") > 1).groupBy("sid", "words", "_block").agg(F.sum("_part").alias("_sum"))
    earlier = Window.partitionBy("sid", "words").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("sid", "words", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    placed = joined.join(blocks, ["sid", "words", "_block"], "left").withColumn("_from", F.col("_before") + F.coalesce("_offset", F.lit(0)) + UNIT // 2)
    own = Window.partitionBy("sid", "words", "_block")
    steps = lambda total: F.floor(total / UNIT)
    placed = placed.withColumn("_extra", steps(F.col("_from") + F.count("*").over(own) * F.col("_part")) - steps(F.col("_from")))
    placed = placed.withColumn("_rank", F.row_number().over(own.orderBy("_hash", "doc_id")))
    copies = F.col("_base") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    return placed.select("doc_id", "source", "words", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def repeat(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, columns unchanged."""
    key = ["doc_id", "source", "words"]
    numbered = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    plan = numbered(mix(docs)).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_k").alias("_j"), "copies")
    rows = numbered(docs.withColumn("words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")))
    on = F.col("_k") == F.col("_j")
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    taken = rows.join(plan, on).filter(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(
        "doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("copies") * F.col("words")).alias("taken"), "source", "copies", "rate",
    )
