"""Splits, picks, the weekly report and the back-test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A


def _is(season: int, week: int) -> Column:
    return F.coalesce((F.col("season") == season) & (F.col("week") == week), F.lit(False))


def _after(season: int, week: int) -> Column:
    return F.coalesce((F.col("season") == season) & (F.col("week") > week), F.lit(False))


def without_future(sched: DataFrame, season: int, week: int) -> DataFrame:
    """Drops the later weeks of the season."""
    return sched.where(~_after(season, week))


def leaked(sched: DataFrame, season: int, week: int) -> DataFrame:
    """Number of rows that should have gone."""
    return sched.where(_after(season, week)).agg(F.count("*").alias("leaked"))


def split_rows(df: DataFrame, season: int, week: int) -> DataFrame:
    """predict = 1 for the target week, 0 for what is trained on."""
    return df.withColumn("predict", _is(season, week).cast("int"))


def graded(bets: DataFrame) -> DataFrame:
    """Adds pred (home minus away), diff, pick, winner, hit, switched, rel_var. A push has no winner."""
    b = bets.withColumn("pred", -F.col("prediction") + 0.0)
    diff = F.col("spread_line") - F.col("pred")
    home, away = F.col("home_team"), F.col("away_team")
    b = b.withColumns({"diff": diff, "diff_abs": F.abs(diff), "abs_pred": F.abs("pred"), "pick": S.pick(diff, home, away), "winner": S.winner(F.col("result"), F.col("spread_line"), home, away)})
    return b.withColumns({
        "hit": S.flag(F.col("pick") == F.col("winner")), "switched": S.sign_switch(F.col("pred"), F.col("spread_line")),
        "rel_var": S.ratio(F.col("var"), F.abs("spread_line")),
    })


def back_test_rows(bets: DataFrame, most_diff: float = 100, most_var: float = 0.1) -> DataFrame:
    return graded(bets.na.drop(subset=["prediction", "result"])).na.drop(subset=["winner"]).where((F.col("diff_abs") <= most_diff) & (F.col("rel_var") <= most_var))


def back_test(sched: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """Hit rates per pick, three binned cross-tabs of the bets with little variance, and their overall rate."""
    keys = ["season", "week", "away_team", "home_team"]
    bets = sched.join(predictions.select(*keys, "prediction", "var"), keys, "left").na.drop(subset=["prediction", "result"])
    won = graded(bets).na.drop(subset=["winner"])
    few = back_test_rows(bets)
    return {
        "by_pick": A.hit_rate(won, ["pick"], "hit", "winner"), "by_diff": A.bin_crosstab(few, "diff_abs", "hit", 100, 10),
        "by_variance": A.bin_crosstab(few, "rel_var", "hit", 50, 1), "by_prediction": A.bin_crosstab(few, "abs_pred", "hit", 100, 10), "overall": few.agg(F.avg("hit").alias("rate")),
    }


def picks(bets: DataFrame, least_pred: float = 1, most_var: float = 0.5, least_diff: float = 3) -> DataFrame:
    return bets.where(F.abs("pred") > least_pred).where(F.col("var") <= most_var).where(F.col("diff_abs") > least_diff)


def top_picks(bets: DataFrame, by: str, ties: Sequence[str], n: int = 3) -> DataFrame:
    return bets.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def weekly_report(lines: DataFrame, predictions: DataFrame, sched: DataFrame, ratings: DataFrame, season: int, week: int) -> DataFrame:
    """Lines against predictions with passers, pick and flags, in the report's order; the prediction's sign is turned at the end."""
    one = lambda d: d.where(_is(season, week))
    name = lambda c: S.strip_suffix(S.short_name(F.col(c)))
    games = one(sched).select("away_team", "home_team", "gameday", "gametime", name("away_qb_name").alias("away_qb"), name("home_qb_name").alias("home_qb"))
    rated = one(ratings).select("name", "weighted_qb_elo")
    for side in ("away", "home"):
        games = games.join(rated.select(F.col("name").alias(f"{side}_qb"), F.col("weighted_qb_elo").alias(f"{side}_qb_elo")), f"{side}_qb", "left")
    keys = ["away_team", "home_team"]
    r = lines.join(one(predictions).select(*keys, "prediction", "var"), keys, "left").join(games, keys, "left").na.drop(subset=["prediction"])
    diff = F.col("prediction") + F.col("spread")
    r = r.withColumns({
        "diff": F.abs(diff), "pick": S.pick(diff, F.col("home_team"), F.col("away_team")), "underdog": S.disagree(F.col("spread"), -F.col("prediction")),
        "away_logo": S.keyed_path("../logos/", F.col("away_team"), ".png"), "home_logo": S.keyed_path("../logos/", F.col("home_team"), ".png"), "prediction": -F.col("prediction"),
        "gameday": F.to_date("gameday"),
    })
    r = r.withColumn("picked", S.flag((F.abs("prediction") > 1) & (F.col("var") <= 0.5) & (F.col("diff") > 3)))
    numbers = ["spread", "prediction", "away_qb_elo", "home_qb_elo", "diff", "var"]
    r = r.withColumns({c: S.round_even(F.col(c)) for c in numbers})
    order = [F.asc_nulls_last(c) for c in ("gameday", "gametime", "away_team")]
    return r.orderBy(*order).select(
        "gameday", "gametime", "away_qb", "away_qb_elo", "away_logo", "away_team", "spread", "prediction", "home_team", "home_logo", "home_qb", "home_qb_elo", "diff", "var", "pick", "picked", "underdog"
    )


def pred_vs_actual(predictions: DataFrame, sched: DataFrame) -> DataFrame:
    """Predictions beside the margins that came to be."""
    keys = ["season", "week", "away_team", "home_team"]
    return predictions.join(sched.select(*keys, "home_score", "away_score"), keys, "left").withColumn("actual", F.col("home_score") - F.col("away_score")).drop("home_score", "away_score")
