"""Temporal pairing.

The anchored policy yields one row per later photo and is listed in full. The
adjacent and all-years policies pair every photo of one year with every photo
of another: their size is a product, so they are kept factored as year steps
with exact pair counts. ``expand`` lists pairs of chosen steps when a consumer
needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import names as N
from driftlens.session import cut_lineage


def year_steps(images: DataFrame, policy: str) -> DataFrame:
    """(view, reference_year, source_year): consecutive or all ordered years.

    Distinct valid years per view are at most 301, which bounds both the
    window and the year join.
    """
    years = images.select("view_id", "year").distinct()
    if policy == "adjacent":
        w = Window.partitionBy("view_id").orderBy("year")
        steps = years.select("view_id", F.col("year").alias("reference_year"), F.lead("year").over(w).alias("source_year"))
        return steps.filter("source_year IS NOT NULL")
    listed = years.groupBy("view_id").agg(F.array_sort(F.collect_set("year")).alias("_y"))
    spans = F.flatten(F.transform("_y", lambda a: F.transform(F.filter("_y", lambda b: b > a), lambda b: F.struct(a.alias("reference_year"), b.alias("source_year")))))
    return listed.select("view_id", F.inline(spans))


def step_counts(images: DataFrame, policy: str) -> DataFrame:
    """Exact pair and exclusion counts per year step without listing pairs.

    Pairs that agree on a set of fields are products of group sizes, so each
    exclusion reason is a difference of two such sums: total, same building,
    same partition, same bytes.
    """
    detail = cut_lineage(images.groupBy("view_id", "year", "building_id", "split", "sha256").agg(F.count("*").alias("_k")))
    steps = year_steps(detail, policy)
    out = steps
    levels = [("total", []), ("same_building", ["building_id"]), ("same_split", ["building_id", "split"]), ("same_bytes", ["building_id", "split", "sha256"])]
    keys = ["view_id", "reference_year", "source_year"]
    for name, fields in levels:
        sizes = detail.groupBy("view_id", "year", *fields).agg(F.sum("_k").alias("_n"))
        left = steps.join(sizes.withColumnRenamed("year", "reference_year"), ["view_id", "reference_year"])
        right = sizes.select(F.col("view_id").alias("_v"), F.col("year").alias("_y"), *[F.col(f).alias(f"_{f}") for f in fields], F.col("_n").alias("_m"))
        on = (F.col("view_id") == F.col("_v")) & (F.col("source_year") == F.col("_y"))
        for f in fields:
            on = on & F.col(f).eqNullSafe(F.col(f"_{f}"))
        products = left.join(right, on).groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_m")).alias(f"_{name}"))
        out = out.join(products, keys, "left")
    n = lambda name: F.coalesce(F.col(f"_{name}"), F.lit(0))
    return out.select(
        *keys, n("total").alias("pairs"), (n("total") - n("same_building")).alias("conflicting_building"),
        (n("same_building") - n("same_split")).alias("different_partitions"), n("same_bytes").alias("identical_bytes"),
        (n("same_split") - n("same_bytes")).alias("eligible_pairs"),
    )


def expand(steps: DataFrame, images: DataFrame) -> DataFrame:
    """List the photo pairs of given year steps; output size is their pair count."""
    side = lambda p: images.select(
        "view_id", F.col("year").alias(f"{p}_year"), F.col("image_id").alias(f"{p}_id"),
        F.struct("building_id", "split", "sha256").alias(f"_{p}"),
    )
    rows = steps.join(side("reference"), ["view_id", "reference_year"]).join(side("source"), ["view_id", "source_year"])
    return _finish(rows)


def _finish(rows: DataFrame) -> DataFrame:
    r, s = F.col("_reference"), F.col("_source")
    reason = (
        F.when(~r["building_id"].eqNullSafe(s["building_id"]), "conflicting_or_partial_building")
        .when(~r["split"].eqNullSafe(s["split"]), "different_partitions").when(r["sha256"] == s["sha256"], "identical_bytes")
    )
    return rows.select(
        F.concat_ws("-", F.col("reference_id").cast("string"), F.col("source_id").cast("string")).alias("pair_id"),
        "reference_id", "source_id", "reference_year", "source_year", "view_id",
        r["building_id"].alias("building_id"), r["split"].alias("split"), reason.alias("reason"),
    )


def first_anchor(images: DataFrame) -> DataFrame:
    """The earliest photo of a view against every photo of a later year."""
    order = F.struct(F.col("year"), N.basename(N.normalized_name(F.col("file_name"))), F.col("sha256"), F.col("image_id"))
    payload = F.struct("image_id", "year", "building_id", "split", "sha256")
    anchors = images.groupBy("view_id").agg(F.min_by(payload, order).alias("_a"))
    rows = images.join(anchors, "view_id").filter(F.col("year") > F.col("_a.year"))
    return _finish(rows.select(
        "view_id", F.col("_a.image_id").alias("reference_id"), F.col("image_id").alias("source_id"),
        F.col("_a.year").alias("reference_year"), F.col("year").alias("source_year"),
        F.struct(F.col("_a.building_id").alias("building_id"), F.col("_a.split").alias("split"), F.col("_a.sha256").alias("sha256")).alias("_reference"),
        F.struct("building_id", "split", "sha256").alias("_source"),
    ))


def address_overlaps(views: DataFrame) -> DataFrame:
    """Views whose house-number range meets another on the same street.

    The number of partners is N - (ranges ending before) - (ranges starting
    after) - 1, read off running counts over the distinct house numbers of a
    street, and ``cluster`` is the first number of the chain of touching
    ranges. No view-by-view pairs are formed.
    """
    name = F.col("view_id")
    part = lambda i: F.regexp_extract(name, N.HOUSE_RANGE, i)
    parsed = views.select("view_id").distinct().filter(name.rlike(N.HOUSE_RANGE)).select(
        "view_id", F.lower(part(1)).alias("street"), part(2).cast("bigint").alias("_a"), F.when(part(3) != "", part(3).cast("bigint")).alias("_b")
    ).select("view_id", "street", F.least("_a", F.coalesce("_b", "_a")).alias("low"), F.greatest("_a", F.coalesce("_b", "_a")).alias("high"))
    ends = F.array(F.struct(F.col("low").alias("n"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.col("high").alias("h")), F.struct(F.col("high").alias("n"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(None).cast("bigint").alias("h")))
    marks = parsed.select("street", F.inline(ends)).groupBy("street", "n").agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("h").alias("h"))
    w = Window.partitionBy("street").orderBy("n")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(
        "street", "n", F.sum("s").over(run).alias("_started"), F.coalesce(F.sum("e").over(prior), F.lit(0)).alias("_ended"),
        F.sum("s").over(Window.partitionBy("street")).alias("_all"),
        ((F.col("s") > 0) & F.coalesce(F.col("n") > F.max("h").over(prior), F.lit(True))).alias("_opens"),
    ).withColumn("_cluster", F.last(F.when(F.col("_opens"), F.col("n")), True).over(run))
    low = marks.select("street", F.col("n").alias("low"), "_ended", "_cluster")
    high = marks.select("street", F.col("n").alias("high"), "_started")
    return parsed.join(low, ["street", "low"]).join(high, ["street", "high"]).select(
        "view_id", "street", "low", "high", (F.col("_started") - F.col("_ended") - 1).alias("overlaps"), F.col("_cluster").alias("cluster")
    )
