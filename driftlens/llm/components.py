"""Connected components of a distributed edge list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import written


def jumped(parent: DataFrame) -> DataFrame:
    """Replace every parent by its own parent where it has one."""
    up = parent.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return parent.join(up, F.col("b") == F.col("_a"), "left").select("a", F.coalesce("_b", "b").alias("b"))


def to_roots(parent: DataFrame) -> DataFrame:
    """Point every node at the last of its chain of parents; chains shrink fourfold per step."""
    while True:
        up = parent.select(F.col("a").alias("_a"))
        if parent.join(up, F.col("b") == F.col("_a"), "left_semi").isEmpty():
            return parent
        parent = written(jumped(jumped(parent)), "parents")


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b): every node of ``edges`` (columns a, b) that has a smaller one, with its component's least node.

    Each round hooks a node to its least smaller neighbour and contracts the
    graph to the roots of these chains, so rounds grow with the logarithm of
    the size. Only emptiness checks reach the driver.
    """
    oriented = lambda e: e.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = written(oriented(edges), "edges")
    found = []
    while not left.isEmpty():
        parent = to_roots(written(left.groupBy("a").agg(F.min("b").alias("b")), "parents"))
        found.append(parent)
        one, two = (parent.select(F.col("a").alias(f"_{k}"), F.col("b").alias(f"_to{k}")) for k in (1, 2))
        moved = left.join(one, F.col("a") == F.col("_1"), "left").join(two, F.col("b") == F.col("_2"), "left")
        left = written(oriented(moved.select(F.coalesce("_to1", "a").alias("a"), F.coalesce("_to2", "b").alias("b"))), "edges")
    return to_roots(reduce(DataFrame.unionByName, found)) if found else left
