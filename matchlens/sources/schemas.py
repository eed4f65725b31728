"""Declared schemas of the input tables. Doubles that hold NaN become null when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHED = """season int, week int, game_type string, away_team string, home_team string, away_score double, home_score double, result double,
spread_line double, gameday string, gametime string, away_qb_name string, home_qb_name string, away_rest int, home_rest int, roof string,
surface string, temp double, wind double, away_coach string, home_coach string, referee string"""
#: What the feature build reads of it (fixed values).
SCHED_COLUMNS = [
    "season", "week", "game_type", "away_team", "away_score", "home_team", "home_score", "away_rest", "home_rest", "roof", "surface", "temp", "wind",
    "away_qb_name", "home_qb_name", "away_coach", "home_coach", "referee",
]
PLAYS = """season int, week int, game_id string, game_date string, home_team string, posteam string, defteam string, play_type string, series double,
drive double, series_success double, drive_time_of_possession string, yards_gained double, complete_pass double, incomplete_pass double,
first_down double, third_down_converted double, third_down_failed double, fourth_down_converted double, fourth_down_failed double,
interception double, fumble_lost double, penalty double, sack double, passer string, rusher string, qb_scramble double, rush_attempt double,
pass_touchdown double, rush_touchdown double, rushing_yards double, passing_yards double"""
PASSER_RATINGS = "season int, week int, team_abbr string, player_display_name string, passer_rating double"
ODDS = """commence_time string, away_team string, home_team string, bookmakers array<struct<last_update: string,
markets: array<struct<outcomes: array<struct<name: string, price: double, point: double>>>>>>"""
PREDICTIONS = "home_team string, prediction double, var double, away_team string"


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
