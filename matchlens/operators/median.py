"""Exact medians of groups of any size.

A group's values are counted, the counts are summed up along the global order (`prefix.running_sum`), and the value or the two values whose counts
span the middle are picked: a hot group is spread over all ranges that its values span. Only groups small enough for one task are sorted in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .prefix import running_sum

#: Values up to which a group's median is taken in one task.
LARGE = 1_000_000


def _with(df: DataFrame, other: DataFrame, part: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined with other on part, nulls equal; other's keys don't come along."""
    renamed = other.withColumnsRenamed({p: f"__of_{p}" for p in part})
    same = [F.col(p).eqNullSafe(F.col(f"__of_{p}")) for p in part]
    return df.join(renamed, same, how).drop(*[f"__of_{p}" for p in part])


def ranged_median(df: DataFrame, part: Sequence[str], value: str, name: str) -> DataFrame:
    """part, name: the median of each group's values that aren't null, by ranges of the values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("__n"))
    summed = running_sum(counts, part, [value], "__n", "__before")
    total = summed.groupBy(*part).agg(F.sum("__n").alias("__all"))
    rows = _with(summed, total, part)
    low, high = F.expr("(__all - 1) div 2"), F.expr("__all div 2")
    has = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))
    middle = rows.where(has(low) | has(high)).withColumn("__x", F.col(value) * (has(low).cast("int") + has(high).cast("int")))
    return middle.groupBy(*part).agg((F.sum("__x") / 2.0).alias(name))


def exact_median(df: DataFrame, part: Sequence[str], value: str, name: str, large: int = LARGE) -> DataFrame:
    """part, name: the median of each group's values; a group without values has a null one, as groups of null keys have their own."""
    sizes = scratch.written(df.groupBy(*part).agg(F.count(value).alias("__size")), "median-sizes")
    hot = sizes.where(F.col("__size") > large).select(*part)
    if hot.isEmpty():
        return df.groupBy(*part).agg(F.median(value).alias(name))
    few = _with(df, hot, part, "left_anti").groupBy(*part).agg(F.median(value).alias(name))
    return few.unionByName(ranged_median(_with(df, hot, part, "left_semi"), part, value, name))
