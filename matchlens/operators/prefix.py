"""Positions and running sums over a global order, without a task that sees a whole group.

Rows are dealt out by range, so a partition is one stretch of the order; each partition is numbered or summed up by itself and the totals
of the partitions before it (a row a partition and group) are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: monotonically_increasing_id numbers the rows of a partition in its lower bits.
ROW_BITS = 33


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _before(totals: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Sum of the group's totals of earlier partitions: a row a partition and group goes through this window."""
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """df with each row's place (from 0) in its group by `order`, nulls first; rows that tie in all of `order` are numbered anyhow.

    The rows are written once in the shared folder, so that ranges and numbers agree.
    """
    keys = [F.asc_nulls_first(c) for c in [*group, *order]]
    dealt = df.repartitionByRange(partitions or _partitions(df), *keys).sortWithinPartitions(*keys)
    kept = scratch.written(dealt.withColumn("__at", F.monotonically_increasing_id()), "positions").withColumn("__part", F.shiftright("__at", ROW_BITS))
    totals = kept.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    offsets = scratch.written(_before(totals, group, "__n"), "positions-before")
    return kept.join(offsets, _same(kept, offsets, [*group, "__part"])).select(*[kept[c] for c in df.columns], (kept["__at"] - offsets["__first"] + offsets["__before"]).alias(name))


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with the sum of `value` over the rows of its group that come before it by `order`; rows that tie have the same sum."""
    keys = [F.asc_nulls_first(c) for c in [*group, *order]]
    dealt = df.repartitionByRange(partitions or _partitions(df), *keys).withColumn("__part", F.spark_partition_id())
    kept = scratch.written(dealt, "running-sum")
    offsets = scratch.written(_before(kept.groupBy(*group, "__part").agg(F.sum(value).alias("__n")), group, "__n"), "running-sum-before")
    # ties share a partition, since the whole order is the range key
    inside = Window.partitionBy(*group, "__part").orderBy(*[F.asc_nulls_first(c) for c in order])
    upto, own = F.sum(value).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum(value).over(Window.partitionBy(*group, "__part", *order))
    summed = kept.withColumn("__own", F.coalesce(upto, F.lit(0)) - F.coalesce(own, F.lit(0)))
    return summed.join(offsets, _same(summed, offsets, [*group, "__part"])).select(*[summed[c] for c in df.columns], (summed["__own"] + offsets["__before"]).alias(name))
