"""What is used more than once is read from partial sums, not from the plays."""

import pytest
from pyspark.sql import functions as F

from matchlens import catalog_runs
from matchlens.operators import windows as W
from matchlens.plans import features
from matchlens.standins import full_plays


def reads_plays(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_team_stats_do_not_go_back_to_the_plays(spark, sf_dir):
    plays = full_plays(spark, sf_dir)
    history = W.history_weeks(W.calendar(plays, regular=F.col("week") <= 10), 3).localCheckpoint()
    assert not reads_plays(features.team_stats(plays, history))


def test_passer_values_do_not_go_back_to_the_plays(spark, sf_dir):
    plays = catalog_runs.passing_plays(spark, sf_dir)
    sched = catalog_runs.full_schedule(plays).localCheckpoint()
    own, dee = features.passer_value(plays, sched, W.history_weeks(W.calendar(sched), 3))
    assert not reads_plays(own) and not reads_plays(dee)


def test_season_features_do_not_go_back_to_the_plays(spark, sf_dir):
    games, cal = catalog_runs.season_features(spark, sf_dir)
    assert not reads_plays(games) and not reads_plays(cal)


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_plays_without_a_unit_count_in_no_mean(spark, missing):
    row = lambda unit, success, clock: ("2024/1", 2024, 1, "a", "b", unit, unit, success, clock)
    columns = "game_id string, season int, week int, posteam string, defteam string, series double, drive double, series_success double, drive_time_of_possession string"
    plays = spark.createDataFrame([row(1.0, 1.0, "1:00"), row(1.0, 0.0, "1:00"), row(2.0, 1.0, "0:30"), row(missing, 1.0, "9:00")], columns)
    got = {(r.kind, r.team): (r.s, r.c) for r in features._unit_sums(plays).collect()}
    assert got == {("off", "a"): (1.5, 2), ("def", "b"): (1.5, 2), ("drive", "a"): (90.0, 2), ("game", "a"): (0.0, 1)}
