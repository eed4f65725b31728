"""An ensemble of ridge regressions on the matchup features, fitted for any number of target weeks in one aggregation.

A member is a bootstrap: each game counts as often as a Poisson number says that a hash of the game and the member draws, so members don't depend on
how rows are dealt out. The sums of products that a regression needs are added up by week and member, and a target's sums are those of its training
weeks; games are read once, whatever the number of targets. Each (target, member) is then a system of a few equations, solved by column expressions.
Members that explain nothing of their training rows (r2 <= 0) are left out; the others' predictions are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .features import FEATURES
from .reports import split_rows

TARGET = ["t_season", "t_week"]
GAME = ["season", "week", "away_team", "home_team"]
#: Weight of the squared coefficients (not of the constant).
RIDGE = 0.1
#: Shares of a Poisson draw of mean 1 that are at most 0, 1, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def label(games: DataFrame) -> DataFrame:
    return games.withColumn("label", (F.col("away_score") - F.col("home_score")).cast("double"))


def draws(member: Column, keys: Sequence[str]) -> Column:
    """How often a row counts in a member: Poisson with mean 1, by hash. Member 0 counts every row once."""
    text = F.concat_ws("|", member.cast("string"), *[F.col(k).cast("string") for k in keys])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / (1 << 32)
    return F.when(member == 0, F.lit(1)).otherwise(sum(((u >= p).cast("int") for p in POISSON), F.lit(0)))


def game_rows(features: DataFrame, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """GAME, label, x: the constant 1 and the features as an array; games that lack a feature are left out."""
    x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns])
    return features.select(*GAME, "label", x.alias("x")).where(~F.exists("x", lambda v: v.isNull()))


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def week_sums(rows: DataFrame, m: int, members: int) -> DataFrame:
    """season, week, member, n, s: sums of products of (x, label) over a week's games, by the members' draws. m: entries of x."""
    z = F.concat("x", F.array("label"))
    drawn = rows.where("label is not null").select(*GAME, z.alias("z"), F.explode(F.sequence(F.lit(0), F.lit(members))).alias("member"))
    w = drawn.select("season", "week", "member", "z", draws(F.col("member"), GAME).alias("w")).where("w > 0")
    sums = F.array(*[F.sum(F.col("w") * F.col("z")[i] * F.col("z")[j]) for i, j in _pairs(m + 1)])
    return w.groupBy("season", "week", "member").agg(F.sum("w").alias("n"), sums.alias("s"))


def target_sums(weeks: DataFrame, windows: DataFrame, m: int) -> DataFrame:
    """The same by target: windows has t_season, t_week and its training weeks, season, week."""
    laid = windows.join(weeks, ["season", "week"])
    return laid.groupBy(*TARGET, "member").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(len(_pairs(m + 1)))]).alias("s"))


def _square(s: Column, m: int, ridge: float = 0.0) -> Column:
    """The m x m leading part of a packed symmetric matrix with its last column beside it."""
    at = {p: k for k, p in enumerate(_pairs(m + 1))}
    entry = lambda i, j: s[at[min(i, j), max(i, j)]] + (F.lit(ridge) if i == j and i else F.lit(0.0))
    return F.array(*[F.array(*[entry(i, j) for j in range(m)], s[at[i, m]]) for i in range(m)])


def solve(a: Column, m: int) -> Column:
    """The solution of m equations in rows of m coefficients and a right side, by elimination; a must be positive definite."""

    def step(rows: Column, k: Column) -> Column:
        pivot = F.transform(F.get(rows, k), lambda v: F.try_divide(v, F.get(F.get(rows, k), k)))
        return F.transform(rows, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda v, p: v - F.get(row, k) * p)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), a, step), lambda row: F.get(row, F.lit(m)))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fit(rows: DataFrame, windows: DataFrame, m: int, members: int, ridge: float = RIDGE) -> DataFrame:
    """TARGET, member, n_train, b (coefficients), r2 and mse on the target's training games."""
    sums = target_sums(week_sums(rows, m, members), windows, m)
    once = sums.where("member = 0").select(*TARGET, F.col("n").alias("n_train"), F.col("s").alias("s0"))
    solved = sums.where("member > 0").join(once, TARGET).withColumn("b", solve(_square(F.col("s"), m, ridge), m))
    last = len(_pairs(m + 1)) - 1
    yy, y1 = F.col("s0")[last], F.col("s0")[m]
    # |y - Xb|^2 from the sums over all training games
    fitted = F.aggregate(F.zip_with(_square(F.col("s0"), m), "b", lambda row, v: v * (_dot(F.slice(row, 1, m), F.col("b")) - 2 * F.get(row, F.lit(m)))), F.lit(0.0), lambda a, b: a + b)
    sse, spread = yy + fitted, yy - y1 * y1 / F.col("n_train")
    return solved.select(*TARGET, "member", "n_train", "b", (1 - F.try_divide(sse, spread)).alias("r2"), (sse / F.col("n_train")).alias("mse"))


def forecast(rows: DataFrame, fits: DataFrame, places: int | None = 1) -> DataFrame:
    """TARGET, away_team, home_team, prediction, var: the target week's games by the members that explain something."""
    good = fits.where("r2 > 0").select(F.col("t_season").alias("season"), F.col("t_week").alias("week"), "member", "b")
    one = _dot(F.col("x"), F.col("b"))
    each = rows.join(good, ["season", "week"]).select(*GAME, (F.bround(one, places) if places is not None else one).alias("prediction"))
    return A.ensemble(each, GAME).withColumnsRenamed({"season": "t_season", "week": "t_week"})


def absolute_errors(rows: DataFrame, windows: DataFrame, fits: DataFrame) -> DataFrame:
    """TARGET, member, mae on the target's training games."""
    laid = windows.join(rows.where("label is not null"), ["season", "week"]).join(fits.select(*TARGET, "member", "b"), TARGET)
    return laid.groupBy(*TARGET, "member").agg(F.avg(F.abs(F.col("label") - _dot(F.col("x"), F.col("b")))).alias("mae"))


def predict(features: DataFrame, season: int, week: int, members: int = 100, columns: Sequence[str] = tuple(FEATURES), ridge: float = RIDGE) -> tuple[DataFrame, DataFrame]:
    """(away_team, home_team, prediction, var) of the target week, fitted on all other rows, and each member's training metrics."""
    rows, m = game_rows(label(features), columns), len(columns) + 1
    weeks = split_rows(features.select("season", "week").distinct(), season, week).where("predict = 0")
    windows = weeks.select(F.lit(season).alias("t_season"), F.lit(week).alias("t_week"), "season", "week")
    fits = fit(rows, windows, m, members, ridge)
    metrics = fits.join(absolute_errors(rows, windows, fits), [*TARGET, "member"]).select("member", "r2", "mae", "mse")
    return forecast(rows, fits).select("away_team", "home_team", "prediction", "var"), metrics
