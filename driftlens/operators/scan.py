"""Running results over ordered nodes of a key, as a tree of bounded rows.

A window over a key reads all its rows in one task. Where the running result
comes from an associative function, nodes are combined in groups of ``fan``
instead, level by level; then what stands before a group goes down the tree. No
row holds more than ``fan`` nodes, whatever share of the data one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.session import stored

FAN = 64


def exclusive(nodes: DataFrame, keys, index: str, value: str, combine, start: Column, apply=None, fan: int = FAN) -> DataFrame:
    """Rows (keys, index, before): what the nodes before each node come to, from ``start`` on.

    ``index`` (from 0, gaps allowed) orders the nodes of a key. ``combine`` joins
    two neighbouring values; ``apply`` takes what is before and a value to what
    is before the next one, and is ``combine`` if not given.
    """
    keys, apply = list(keys), apply or combine
    last = nodes.agg(F.max(index)).first()[0] or 0
    levels, below = [], nodes.select(*keys, F.col(index).cast("bigint").alias("_i"), F.col(value).alias("_v"))
    while True:
        listed = F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_n")
        level = below.groupBy(*keys, F.floor(F.col("_i") / fan).alias("_up")).agg(listed)
        last //= fan
        if not last:
            levels.append(level)
            break
        levels.append(stored(level, "scan"))
        values = F.transform("_n", lambda n: n["_v"])
        whole = F.aggregate(F.slice(values, 2, fan), F.get(values, F.lit(0)), combine)
        below = levels[-1].select(*keys, F.col("_up").alias("_i"), whole.alias("_v"))
    before = None
    for level in reversed(levels):
        held = level.withColumn("_b", start) if before is None else level.join(before, [*keys, "_up"])
        empty = F.transform(F.slice("_n", 1, 0), lambda n: F.struct(n["_i"].alias("_up"), F.col("_b")))
        walk = F.aggregate("_n", F.struct(F.col("_b").alias("now"), empty.alias("out")), lambda s, n: F.struct(
            apply(s["now"], n["_v"]).alias("now"), F.concat(s["out"], F.array(F.struct(n["_i"].alias("_up"), s["now"].alias("_b")))).alias("out"),
        ))
        before = held.select(*keys, F.inline(walk["out"]))
    return before.select(*keys, F.col("_up").alias(index), F.col("_b").alias("before"))
