"""Consensus lines from nested odds feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J


def flatten(feed: DataFrame) -> DataFrame:
    """One row an outcome; neither bookmaker nor market is kept, nor the price."""
    b = feed.select("commence_time", "away_team", "home_team", F.explode("bookmakers").alias("b"))
    m = b.select("commence_time", "away_team", "home_team", F.col("b.last_update").alias("last_update"), F.explode("b.markets").alias("m"))
    o = m.select("commence_time", "away_team", "home_team", "last_update", F.explode("m.outcomes").alias("o"))
    return o.select("commence_time", "away_team", "home_team", "last_update", "o.name", "o.point")


def team_dimension(teams: DataFrame, fixes: Mapping[str, str]) -> DataFrame:
    """team_name, abbr with corrected abbreviations."""
    return teams.select("team_name", "abbr").na.replace(dict(fixes), subset=["abbr"])


def consensus(feed: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """date, away_team, spread, home_team, total: medians over books. Books with equal point and update time count once."""
    keys = ["date", "away_team", "home_team"]
    rows = flatten(feed).na.drop("any").distinct().withColumns({"date": S.iso_date(F.col("commence_time")), "last_update": S.iso_timestamp(F.col("last_update"))}).drop("commence_time")
    mid = lambda d, name: d.groupBy(*keys).agg(F.max("last_update").alias(f"{name}_update"), F.median("point").alias(name))
    total, spread = mid(rows.where(F.col("name") == "Over"), "total"), mid(rows.where(F.col("name") == F.col("away_team")), "spread")
    out = total.join(spread, keys).select("date", "away_team", "spread", "home_team", "total")
    return J.replace_values(out, mapping, ["away_team", "home_team"]).select("date", "away_team", "spread", "home_team", "total") if mapping is not None else out
