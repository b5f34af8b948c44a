"""Connected components by alternating stars: each step is a grouping and a join, and few steps are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut, discard


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (first two columns, any order) that is not its component's least.

    No edges give no rows; loops and repeated edges don't matter.
    """
    a, b = edges.columns[:2]
    edges = cut(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("component")).filter("node <> component").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges.select("component", "node"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("node"), F.col("m").alias("component")).filter("node <> component").union(lower)
        older, edges, before = edges, cut(small.distinct()), mark
        discard(older)
        mark = _mark(edges)
        if mark == before:
            break
    return edges
