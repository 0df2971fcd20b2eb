"""Ordered aggregates that never put a whole hot group into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The
helpers here cut each key into ordered buckets: bucket totals are tiny and are
accumulated per key, and only the rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_bucket(value: Column, buckets: int = 1024) -> Column:
    """Order-preserving bucket of a value expected in [0, 1]; outliers share the ends."""
    return F.greatest(F.lit(0), F.least(F.lit(buckets), F.floor(value * buckets))).cast("int")


def score_bucket(value: Column) -> Column:
    """Order-preserving bucket of any float, fine where scores gather.

    Linear in 1/1024 steps between 2^-10 and 1 and eight steps per power of two
    below; larger values get 64 steps per power of two. NaN orders last.
    """
    size = F.abs(value.cast("double"))
    power = F.log2(size)
    steps = (
        F.when(size == 0, 0).when(size < 2.0**-10, F.greatest(F.lit(1), 1 + F.floor((power + 150) * 8)))
        .when(size <= 1, 1200 + F.floor(size * 1024)).otherwise(2300 + F.floor(F.least(power, F.lit(1100.0)) * 64))
    )
    return F.when(F.isnan(value), F.lit(1 << 20)).otherwise(F.when(value < 0, -steps).otherwise(steps)).cast("int")


def hex_bucket(digest: Column, digits: int = 3) -> Column:
    """Order-preserving, evenly filled bucket of a lower-case hex digest."""
    return F.substring(digest, 1, digits)


def running_totals(df, keys, bucket, order, measures, descending=False) -> DataFrame:
    """Add inclusive running sums ``cum_<m>`` and key totals ``all_<m>``.

    ``bucket`` must be non-decreasing in the first order column. Rows should be
    unique on (keys, order), which pre-aggregation gives.
    """
    keys = list(keys)
    staged = df.withColumn("__bucket", bucket)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = staged.groupBy(*keys, "__bucket").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__b"),
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__t_{m}").over(per_key).alias(f"all_{m}") for m in measures],
    )
    inner = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy(*[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = staged.select("*", *[F.sum(m).over(inner).alias(f"__i_{m}") for m in measures])
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = summed.join(offsets, on)
    for m in measures:
        joined = joined.withColumn(f"cum_{m}", F.col(f"__i_{m}") + F.col(f"__o_{m}"))
    private = [c for c in joined.columns if c.startswith("__")]
    return joined.drop(*private)


def bucketed_rank(df, keys, bucket, order, name="rank", total=None) -> DataFrame:
    """Exact 1-based row number inside ``keys``; ``order`` must be a total order.

    Each order entry is a column name, or ``(name, "desc")``. ``bucket`` follows
    the first entry's direction as an ascending value.
    """
    keys = list(keys)
    staged = df.withColumn("__bucket", bucket)
    sizes = staged.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    per_key = Window.partitionBy(*keys)
    offsets = sizes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__b"),
        F.coalesce(
            F.sum("__n").over(per_key.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__offset"),
        F.sum("__n").over(per_key).alias("__total"),
    )
    sort = [F.col(o[0]).desc() if isinstance(o, tuple) else F.col(o).asc() for o in order]
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*sort)
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    ranked = staged.withColumn("__r", F.row_number().over(inner)).join(offsets, on)
    ranked = ranked.withColumn(name, (F.col("__r") + F.col("__offset")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop(*[c for c in ranked.columns if c.startswith("__")])


def first_n(df, keys, order, n, name="rank") -> DataFrame:
    """First ``n`` rows of every key.

    The rank filter is pruned map-side by Spark's window group limit, so a hot
    key ships at most ``n`` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def exact_quantiles(df, keys, value, fractions, bucket, carry=()) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (key, fraction).

    Values are counted first, so ties cost nothing; the two order statistics
    around each position are found on the running counts. ``carry`` names
    columns the bucket needs that are functions of the value.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value, *carry).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, keys, bucket, [value], ["n"])
    spots = F.array(*[F.struct(F.lit(f"{f:g}").alias("fraction"), F.lit(float(f)).alias("f")) for f in fractions])
    placed = ranked.withColumn("_q", F.explode(spots)).withColumn("_pos", F.col("_q.f") * (F.col("all_n") - 1))
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    low, high = F.floor("_pos"), F.ceil("_pos")
    placed = placed.filter(((first <= low) & (low <= last)) | ((first <= high) & (high <= last)))
    return (
        placed.groupBy(*keys, F.col("_q.fraction").alias("fraction"), "_pos")
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .select(
            *keys,
            "fraction",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("quantile"),
        )
    )
