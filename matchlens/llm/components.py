"""Connected components of an edge table, by alternating large-star and small-star rounds (a published MapReduce algorithm).

Only edges move between tasks; a node of high degree is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node hands its larger neighbours to the smallest node around; small: itself and its smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    near = both.join(low, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
    moved = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, comp): comp is the smallest node reached; nodes without an edge don't occur."""
    edges = common.written(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    mark = _mark(edges)
    while mark[0]:
        edges = common.written(_star(_star(edges, True), False), "cc-edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
