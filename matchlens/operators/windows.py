"""Percentile ranks and the week calendar: running counts, target weeks, history windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .median import LARGE, exact_median


def pct_rank(value: str, part: Sequence[str], reverse: bool | Column = False) -> Column:
    """Average-tie rank over count, ascending or reversed, within part (never over an undivided frame)."""
    whole = Window.partitionBy(*part)
    rank = F.rank().over(whole.orderBy(value)) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / 2
    n = F.count("*").over(whole)
    up, down = rank / n, (n - rank + 1) / n
    if isinstance(reverse, Column):
        return F.when(reverse, down).otherwise(up)
    return down if reverse else up


def impute_median(df: DataFrame, value: str, part: Sequence[str], large: int = LARGE) -> DataFrame:
    """Nulls of a column become the median of their part; no part of more than `large` values is gathered."""
    mid = exact_median(df, part, value, "mid", large)
    return df.join(mid, list(part), "left").withColumn(value, F.coalesce(F.col(value), F.col("mid"))).drop("mid")


def rank_metrics(long: DataFrame, part: Sequence[str], reverse: Column) -> DataFrame:
    """long: part, team, metric, value. Median-imputed percentile ranks of all metrics with one sort."""
    keys = [*part, "metric"]
    return impute_median(long, "value", keys).withColumn("value", pct_rank("value", keys, reverse))


def calendar(games: DataFrame, season: str = "season", week: str = "week", regular: Column | None = None) -> DataFrame:
    """One row a week: season, week, reg (0/1), ro (regular weeks up to and with it), ord (weeks up to it).

    The table has a row a week, whatever the number of games; it is joined with itself instead of sorted into one partition.
    """
    reg = regular if regular is not None else F.col("game_type") == "REG"
    weeks = games.groupBy(F.col(season).alias("season"), F.col(week).alias("week")).agg(F.max(reg.cast("int")).alias("reg"))
    before = weeks.select(F.col("season").alias("s0"), F.col("week").alias("w0"), F.col("reg").alias("r0"))
    upto = (F.col("s0") < F.col("season")) | ((F.col("s0") == F.col("season")) & (F.col("w0") <= F.col("week")))
    return weeks.join(F.broadcast(before), upto).groupBy("season", "week", "reg").agg(F.sum("r0").alias("ro"), F.count("*").alias("ord"))


def _back(cal: DataFrame) -> DataFrame:
    """Each target week with each earlier week: back = regular weeks from that week to the week before the target."""
    prior = cal.select((F.col("ord") + 1).alias("ord"), F.col("ro").alias("ro_prior"), F.col("season").alias("ps"), F.col("week").alias("pw"), F.col("reg").alias("preg"))
    target = cal.select("season", "week", "ord").join(F.broadcast(prior), "ord")
    # 1 if the week numbered one less in this season is a regular one: it is taken without counting
    free = F.when((F.col("ps") == F.col("season")) & (F.col("pw") == F.col("week") - 1), F.col("preg")).otherwise(0)
    target = target.select("season", "week", "ord", "ro_prior", free.alias("free"), (F.col("pw") == F.col("week") - 1).alias("next"), (F.col("ps") == F.col("season")).alias("same"))
    past = cal.select(F.col("season").alias("h_season"), F.col("week").alias("h_week"), F.col("ord").alias("h_ord"), F.col("ro").alias("h_ro"), F.col("reg").alias("h_reg"))
    pairs = target.join(F.broadcast(past), F.col("h_ord") < F.col("ord"))
    return pairs.withColumn("back", F.col("ro_prior") - F.col("h_ro") + F.col("h_reg"))


def history_weeks(cal: DataFrame, lookback: int) -> DataFrame:
    """season, week, h_season, h_week: the weeks in each target's window; targets whose window isn't complete are left out."""
    pairs = _back(cal).withColumn("used", F.col("back") - F.col("free"))
    last = F.col("same") & F.col("next") & (F.col("h_ord") == F.col("ord") - 1)
    complete = F.max("used").over(Window.partitionBy("season", "week")) >= lookback
    return pairs.withColumn("complete", complete).where("complete").where(last | (F.col("used") < lookback)).select("season", "week", "h_season", "h_week")


def weeks_in_reach(cal: DataFrame, lookback: int) -> DataFrame:
    """season, week, h_season, h_week: each week with every earlier one that has at most lookback regular weeks since."""
    return _back(cal).where(F.col("back") <= lookback).select("season", "week", "h_season", "h_week")


def target_weeks(cal: DataFrame, season: int, week: int, lookback: int) -> DataFrame:
    """season, week of the current week and of every earlier one with at most lookback regular weeks since."""
    now = (F.col("season") == season) & (F.col("week") == week)
    earlier = _back(cal).where(now).where(F.col("back") <= lookback).select(F.col("h_season").alias("season"), F.col("h_week").alias("week"))
    return cal.where(now).select("season", "week").unionByName(earlier)


def newest_without_oldest(keys: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Distinct keys but the n oldest. The oldest n are a top-n, so nothing is sorted as a whole."""
    distinct = keys.select(*order).distinct()
    oldest = distinct.orderBy(*order).limit(n)
    return distinct.join(F.broadcast(oldest), list(order), "left_anti")
