"""Whole runs: one target week with its cache, and the back-fill of all weeks that have results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import windows as W
from ..sources import tables
from ..sources.schemas import SCHED_COLUMNS
from . import features, model
from .features import FEATURES


def run(spark: SparkSession, store: str, season: int, week: int, lookback: int, reuse: bool = False, **fit) -> tuple[DataFrame, DataFrame]:
    """(predictions, member metrics) of a week. store holds `sched` and `pbp`; features and ratings are published under it with these files' version."""
    sched = tables.sched(spark, f"{store}/sched", SCHED_COLUMNS)

    def build() -> DataFrame:
        built, ratings = features.feature_build(tables.plays(spark, f"{store}/pbp"), sched, season, week, lookback)
        tables.publish(ratings, f"{store}/qb", season, week, lookback, version)
        return built

    version = tables.file_version(spark, f"{store}/sched", f"{store}/pbp")
    kept = tables.read_or_compute(spark, f"{store}/stats", season, week, lookback, build, version, reuse)
    return model.predict(kept, season, week, **fit)


def back_fill_weeks(sched: DataFrame, lookback: int) -> DataFrame:
    """t_season, t_week: regular weeks with results, without the oldest `lookback`."""
    keys = W.newest_without_oldest(sched.na.drop(subset=["result"]).where("game_type = 'REG'"), ["season", "week"], lookback)
    return keys.withColumnsRenamed({"season": "t_season", "week": "t_week"})


def training_windows(cal: DataFrame, targets: DataFrame, lookback: int) -> DataFrame:
    """t_season, t_week, season, week: the earlier weeks that each target is trained on."""
    reach = W.weeks_in_reach(cal, lookback).withColumnsRenamed({"season": "t_season", "week": "t_week"})
    return reach.join(targets, model.TARGET, "left_semi").withColumnsRenamed({"h_season": "season", "h_week": "week"})


def back_fill_all(games: DataFrame, cal: DataFrame, targets: DataFrame, lookback: int, columns: Sequence[str] = tuple(FEATURES), members: int = 100, ridge: float = model.RIDGE, places: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """games: GAME, label and the features of all weeks. Returns the predictions of all targets, and a status row for each.

    A week's features depend on that week's own window alone, so they are shared by all targets that train on it. What keeps a target from having predictions is
    its status, not an error: the others are computed all the same.
    """
    m = len(columns) + 1
    games = scratch.written(games.select(*model.GAME, "label", *[F.col(f"`{c}`") for c in columns]), "back-fill-games")
    rows = model.game_rows(games, columns)
    windows = training_windows(cal, targets, lookback)
    fits = scratch.written(model.fit(rows, windows, m, members, ridge), "back-fill-fits")
    predicted = model.forecast(rows, fits, places)
    played = games.groupBy(F.col("season").alias("t_season"), F.col("week").alias("t_week")).agg(F.count("*").alias("n_games"))
    usable = rows.groupBy(F.col("season").alias("t_season"), F.col("week").alias("t_week")).agg(F.count("*").alias("n_predicted"))
    fitted = fits.groupBy(*model.TARGET).agg(F.max("n_train").alias("n_train"), F.count_if(F.col("r2") > 0).alias("n_members"))
    status = targets
    for part in (played, usable, fitted):
        status = status.join(part, model.TARGET, "left")
    counts = ["n_games", "n_predicted", "n_train", "n_members"]
    why = F.when(F.col("n_predicted") == 0, "no features").when(F.col("n_train") == 0, "no training games").when(F.col("n_members") == 0, "no member explains anything").otherwise("done")
    return predicted, status.na.fill(0, subset=counts).select(*model.TARGET, *[F.col(c).cast("long").alias(c) for c in counts], why.alias("status"))


def back_fill(spark: SparkSession, store: str, lookback: int, **fit) -> DataFrame:
    """Stores the predictions of all eligible weeks under `bt` with one write; returns each week's status."""
    sched = tables.sched(spark, f"{store}/sched")
    built, _ = features.feature_build_all(tables.plays(spark, f"{store}/pbp"), sched, lookback)
    predicted, status = back_fill_all(model.label(built), W.calendar(sched), back_fill_weeks(sched, lookback), lookback, **fit)
    keyed = predicted.withColumnsRenamed({"t_season": "season", "t_week": "week"}).withColumn("lookback", F.lit(lookback))
    keyed.repartition(*tables.WINDOW).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tables.WINDOW).parquet(f"{store}/bt")
    return status
