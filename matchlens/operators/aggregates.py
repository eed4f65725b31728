"""Grouped statistics: plain, rank-weighted and recency-weighted, multi-level, centred, hit rates, binned cross-tabs, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from .prefix import running_sum


def keep(df: DataFrame, column: str, values: str | Sequence[str] | None) -> DataFrame:
    """Rows with one value, with any of several, or (None) all rows."""
    if values is None:
        return df
    return df.where(F.col(column) == values) if isinstance(values, str) else df.where(F.col(column).isin(list(values)))


def _present(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(group))


def plain_stat(df: DataFrame, group: Sequence[str], stat: str, agg: str) -> DataFrame:
    """mean, sum or count of the values that aren't null; a sum over none is 0. Null keys are dropped."""
    fn = {"mean": F.avg(stat), "sum": F.coalesce(F.sum(stat), F.lit(0.0)), "count": F.count(stat)}[agg]
    return _present(df, group).groupBy(*group).agg(fn.alias(stat))


def mean_in_order(df: DataFrame, group: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """The mean of column in each group, its values added up one by one in the given order. Sums of doubles differ in their last places by the
    order of additions, so those of partial sums depend on how rows are dealt out, and ranks by them with it. A group's rows pass through one
    task, which holds none of them. Nulls don't count; a group of nulls has no row."""
    so_far = Window.partitionBy(*group).orderBy(*order)
    rows = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = df.where(F.col(column).isNotNull()).select(
        *group, F.sum(column).over(rows).alias("__sum"), F.count(column).over(rows).alias("__n"), F.lead(F.lit(1)).over(so_far).isNull().alias("__last")
    )
    return added.where("__last").select(*group, (F.col("__sum") / F.col("__n")).alias(column))


def _finish(agg: str, sx: Column, sw: Column, z: Column | None, n: Column) -> Column:
    return {
        "mean": S.ratio(F.coalesce(F.sum(sx), F.lit(0.0)), F.sum(sw)),
        "sum": F.coalesce(F.sum(sx), F.lit(0.0)) / (F.first(z) if z is not None else F.lit(1.0)),
        "count": F.sum(n),
    }[agg]


def decay_stat(df: DataFrame, date: str, group: Sequence[str], stat: str, agg: str, total: float = 160, steepness: float = 3, floor: float = 0.05) -> DataFrame:
    """Recency-weighted mean, sum or row count per group.

    A row's weight depends on its date alone, so rows are summed up by (date, group) first and the weights are applied to
    these partial sums. Weights are normalised over the whole frame, rows without a group included; a null value still
    counts in the denominator. Rows without a date are left out.
    """
    part = df.where(F.col(date).isNotNull()).groupBy(date, *group).agg(F.sum(stat).alias("sx"), F.count("*").alias("n"))
    dates = part.groupBy(date).agg(F.sum("n").alias("rows"))
    weight = S.decay(F.datediff(F.col("last"), F.col(date)), total, steepness, floor)
    # one row each: the last date, and the total weight
    last = dates.agg(F.max(date).alias("last"))
    z = dates.join(F.broadcast(last)).agg(F.sum(weight * F.col("rows")).alias("z"), F.first("last").alias("last"))
    rows = _present(part, group).join(F.broadcast(z)).withColumn("w", weight)
    return rows.groupBy(*group).agg(_finish(agg, F.col("w") * F.col("sx"), F.col("w") * F.col("n"), F.col("z"), F.col("n")).alias(stat))


def rank_weight_stat(df: DataFrame, date: str, group: Sequence[str], stat: str, agg: str) -> DataFrame:
    """The same with weights by rank: the average rank of the days ago, descending, over all ranks.

    The rank depends on the date alone: rows are counted by date, and the counts are summed up along the dates by ranges, so that the plan stays
    linear where each row has a time of its own.
    """
    part = scratch.written(df.where(F.col(date).isNotNull()).groupBy(date, *group).agg(F.sum(stat).alias("sx"), F.count("*").alias("n")), "rank-parts")
    dates = part.groupBy(date).agg(F.sum("n").alias("rows"))
    # oldest first: the rows before a date, plus the middle of its own
    ranked = running_sum(dates, [], [date], "rows", "before").select(date, (F.col("before") + (F.col("rows") + 1) / 2).alias("w"))
    total = part.agg(F.sum("n").alias("all_rows"))
    z = F.col("all_rows") * (F.col("all_rows") + 1) / 2
    rows = _present(part, group).join(ranked, date).join(F.broadcast(total)).withColumn("z", z)  # the total is one row
    return rows.groupBy(*group).agg(_finish(agg, F.col("w") * F.col("sx"), F.col("w") * F.col("n"), F.col("z"), F.col("n")).alias(stat))


def group_mean_of_rows(df: DataFrame, group: Sequence[str], stat: str, name: str) -> DataFrame:
    """First level of the two- and three-level statistics: sum of values over number of rows (null values count as rows)."""
    return _present(df, group).groupBy(*group).agg((F.coalesce(F.sum(stat), F.lit(0.0)) / F.count("*")).alias(name))


def two_level(df: DataFrame, unit: Sequence[str], team: str, stat: str) -> DataFrame:
    """Mean of a statistic over units, of its means within units."""
    first = group_mean_of_rows(df, [*unit, team], stat, "m")
    return first.groupBy(team).agg((F.sum("m") / F.count("*")).alias(stat))


def three_level(df: DataFrame, outer: Sequence[str], inner: Sequence[str], team: str, stat: str, scale: float = 3600) -> DataFrame:
    """Mean within (outer, inner), summed within outer and scaled, averaged over outer."""
    first = group_mean_of_rows(df, [*outer, *inner, team], stat, "m")
    second = first.groupBy(*outer, team).agg((F.sum("m") / F.lit(float(scale))).alias("s"))
    return second.groupBy(team).agg((F.sum("s") / F.count("*")).alias(stat))


def centred(df: DataFrame, group: str, value: str, weight: str, name: str) -> DataFrame:
    """Weighted mean per group, less the weighted mean over everything."""
    part = df.groupBy(group).agg(F.sum(F.col(value) * F.col(weight)).alias("sx"), F.sum(weight).alias("sw"))
    whole = part.agg((F.sum("sx") / F.sum("sw")).alias("centre"))
    return part.where(F.col(group).isNotNull()).join(F.broadcast(whole)).select(group, (F.coalesce(F.col("sx"), F.lit(0.0)) / F.col("sw") - F.col("centre")).alias(name))


def hit_rate(df: DataFrame, group: Sequence[str], hit: str, counted: str) -> DataFrame:
    hits, n = F.sum(hit), F.count(counted)
    return _present(df, group).groupBy(*group).agg(hits.alias("hits"), n.alias("n"), S.ratio(hits, n).alias("rate"))


def bin_edges(spark, n: int, top: float) -> DataFrame:
    """bin, lo, hi of n equal bins over (0, top]."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("bin"), (i * F.lit(float(top)) / n).alias("lo"), ((i + 1) * F.lit(float(top)) / n).alias("hi"))


def bin_crosstab(df: DataFrame, value: str, hit: str, n: int, top: float) -> DataFrame:
    """Counts of hit = 0 and 1 in each right-closed bin, empty bins included; values at 0 or above top fall out.

    The bin is computed, not joined; a step to either side makes up for the rounding of the division.
    """
    edges = bin_edges(df.sparkSession, n, top)
    x, edge = F.col(value), lambda b: b * F.lit(float(top)) / n
    guess = F.ceil(x / F.lit(float(top)) * n).cast("int") - 1
    at = F.when(x <= edge(guess), guess - 1).when(x > edge(guess + 1), guess + 1).otherwise(guess)
    counted = df.where((x > 0) & (x <= top)).select(at.alias("bin"), F.col(hit).alias("h")).groupBy("bin").agg(
        F.count_if(F.col("h") == 0).alias("miss"), F.count_if(F.col("h") == 1).alias("hit")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return edges.join(counted, "bin", "left").select("bin", "lo", "hi", zero("miss"), zero("hit"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """r2, mae, mse in one row and one pass."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    m = df.agg(F.sum(e * e).alias("sse"), F.var_pop(y).alias("var"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.count(e).alias("n"))
    return m.select((1 - S.ratio(F.col("sse"), F.col("var") * F.col("n"))).alias("r2"), "mae", "mse")


def sign_loss(df: DataFrame, actual: str, predicted: str, penalty: float = 1.3) -> DataFrame:
    """Mean squared error, wrong signs weighted up."""
    y, p = F.col(actual), F.col(predicted)
    return df.agg(F.avg(F.when(y * p < 0, F.lit(penalty)).otherwise(F.lit(1.0)) * (y - p) * (y - p)).alias("loss"))


def ensemble(df: DataFrame, keys: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Mean and sample variance of the members' predictions (one member: null variance)."""
    return df.groupBy(*keys).agg(F.avg(prediction).alias("prediction"), F.var_samp(prediction).alias("var"))


def gated(df: DataFrame, member: str, actual: str, predicted: str) -> DataFrame:
    """Rows of the members whose r2 is above 0."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    good = df.groupBy(member).agg((1 - S.ratio(F.sum(e * e), F.var_pop(y) * F.count(e))).alias("r2")).where("r2 > 0")
    return df.join(good.select(member), member, "left_semi")
