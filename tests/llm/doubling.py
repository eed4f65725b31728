"""Prefix doubling with a row for every byte place: the method that op7 shortens, for comparison and to measure what it would cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm import common
from matchlens.operators import prefix


def shared(pairs: DataFrame) -> DataFrame:
    """Places whose pair (a, b) another document has too, with the pair's dense rank from the sorted order; all others leave."""
    groups = pairs.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    ranks = prefix.positions(groups, [], ["a", "b"], "rank").withColumnsRenamed({"a": "ra", "b": "rb"})
    return common.written(pairs.join(ranks, F.expr("a = ra and b = rb")).select("doc", "pos", "rank", "first"), "doubling")


def windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc, pos, first: each place (from 0) whose `width` bytes also start in another document, and the smallest id of these documents."""
    held = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.encode("text", "UTF-8").alias("data"))
    places = held.select("doc", F.posexplode(F.transform(F.filter(F.split(F.hex("data"), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))).alias("pos", "a"))
    ranked, length = shared(places.withColumn("b", F.lit(0))), 1
    while length < width:
        step = min(length, width - length)
        other = ranked.select(F.col("doc").alias("d"), (F.col("pos") - step).alias("p"), F.col("rank").alias("b"))
        ranked = shared(ranked.join(other, F.expr("doc = d and pos = p")).select("doc", "pos", F.col("rank").alias("a"), "b"))
        length += step
    return ranked.select("doc", "pos", "first")
