"""Team statistics, passer values and matchup features for all target weeks in one plan.

Plays are summed up once to (week, date, side, team, bucket of play types); these partial sums, not the plays, are laid
against the target weeks whose window covers them, since a play's weight depends on the target and its date alone. Partial sums are
written: each later use would else read the plays again, with the columns that it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars as S
from ..operators import joins as J
from ..operators import windows as W

# Which play types each filter takes, the statistics, and the feature list.
FILTERS = {"run": ["run"], "pass": ["pass"], "rp": ["run", "pass"], "six": ["kickoff", "run", "pass", "punt", "field_goal", "extra_point"], "all": None}
SUMS = [
    "yards_gained", "complete_pass", "first_down", "third_down_converted", "third_down_failed", "fourth_down_converted", "fourth_down_failed",
    "interception", "fumble_lost", "penalty",
]
FEATURES = [f"away_{side}_{m}" for m in ("run_ypp", "pass_ypp", "pass_completion_%", "series_success_%", "first_down_pp", "third_down_%", "fourth_down_%", "turnovers_pp", "penalties_pp", "qb_elo") for side in ("off", "def")]
TARGET = ["season", "week"]


def window_stat(rows: DataFrame, history: DataFrame, date: str, team: str, stat: str, total: float = 160, steepness: float = 3, floor: float = 0.05) -> DataFrame:
    """season, week, team: decay-weighted mean (stat), sum (stat_sum) and count (n) over each target's window, from partial sums."""
    part = rows.groupBy(F.col("season").alias("h_season"), F.col("week").alias("h_week"), date, team).agg(F.sum(stat).alias("sx"), F.count("*").alias("c"))
    laid = part.join(F.broadcast(history), ["h_season", "h_week"])  # the history has one row a pair of weeks
    last = laid.groupBy(*TARGET).agg(F.max(date).alias("last"))
    w = laid.join(last, TARGET).withColumn("w", S.decay(S.days_between(F.col("last"), F.col(date)), total, steepness, floor))
    z = w.groupBy(*TARGET).agg(F.sum(F.col("w") * F.col("c")).alias("z"))
    sx = F.coalesce(F.sum(F.col("w") * F.col("sx")), F.lit(0.0))
    per = w.where(F.col(team).isNotNull()).groupBy(*TARGET, team).agg(sx.alias("sx"), F.sum(F.col("w") * F.col("c")).alias("sw"), F.sum("c").alias("n"))
    return per.join(z, TARGET).select(*TARGET, team, (F.col("sx") / F.col("sw")).alias(stat), (F.col("sx") / F.col("z")).alias(f"{stat}_sum"), "n")


def _sides(plays: DataFrame) -> DataFrame:
    """Each play once as offence and once as defence."""
    side = F.explode(F.array(F.struct(F.lit("off").alias("side"), F.col("posteam").alias("team")), F.struct(F.lit("def").alias("side"), F.col("defteam").alias("team"))))
    return plays.withColumn("__s", side).select("*", "__s.side", "__s.team").drop("__s")


def _passes(name: str) -> Column:
    kinds = FILTERS[name]
    return F.lit(True) if kinds is None else F.coalesce(F.col("play_type").isin(kinds), F.lit(False))


def team_stats(plays: DataFrame, history: DataFrame, decayed: bool = True, total: float = 160, steepness: float = 3, floor: float = 0.05) -> DataFrame:
    """season, week, team and all off_/def_ metrics for each target. decayed=False: plain sums and non-null counts (the older form).

    off_run_ypp is an unweighted mean in both forms, and only teams with a run play are listed.
    """
    dated = plays.where(F.col("game_date").isNotNull())
    part = _sides(dated).groupBy(F.col("season").alias("h_season"), F.col("week").alias("h_week"), "game_date", "side", "team", "play_type").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS], *[F.count(c).alias(f"n_{c}") for c in (SUMS[:1] if decayed else SUMS)]
    )
    laid = scratch.written(part, "play-sums").join(F.broadcast(history), ["h_season", "h_week"])
    # per target and filter, over rows with and without a team: the last date and the total weight
    last = laid.where("side = 'off'").groupBy(*TARGET).agg(*[F.max(F.when(_passes(f), F.col("game_date"))).alias(f"last_{f}") for f in FILTERS])
    w = laid.join(last, TARGET)
    for f in FILTERS:
        days = S.days_between(F.col(f"last_{f}"), F.col("game_date"))
        w = w.withColumn(f"w_{f}", F.when(_passes(f), S.decay(days, total, steepness, floor) if decayed else F.lit(1.0)))
    z = w.where("side = 'off'").groupBy(*TARGET).agg(*[F.sum(F.col(f"w_{f}") * F.col("n")).alias(f"z_{f}") for f in FILTERS])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    wx = lambda f, c: zero(F.sum(F.col(f"w_{f}") * F.col(c))) / (F.first(f"z_{f}") if decayed else F.lit(1.0))
    count = lambda f, c: F.sum(F.when(_passes(f), F.col("n") if decayed else F.col(f"n_{c}")))
    mean = lambda f, c: S.ratio(zero(F.sum(F.col(f"w_{f}") * F.col(c))), F.sum(F.col(f"w_{f}") * F.col("n" if decayed else f"n_{c}")))
    rate = lambda f, c: S.ratio(wx(f, c), count(f, c))
    share = lambda a, b: S.ratio(a, a + b)
    metrics = {
        "run_ypp": mean("run", "yards_gained"), "pass_ypp": mean("pass", "yards_gained"),
        "run_%": S.ratio(count("run", "yards_gained"), count("rp", "yards_gained")), "pass_%": S.ratio(count("pass", "yards_gained"), count("rp", "yards_gained")),
        "pass_completion_%": rate("pass", "complete_pass"), "first_down_pp": rate("rp", "first_down"),
        "third_down_%": share(wx("rp", "third_down_converted"), wx("rp", "third_down_failed")), "fourth_down_%": share(wx("rp", "fourth_down_converted"), wx("rp", "fourth_down_failed")),
        "turnovers_pp": S.ratio(wx("six", "interception") + wx("six", "fumble_lost"), count("six", "interception")), "penalties_pp": rate("all", "penalty"),
    }
    plain_run = S.ratio(F.sum(F.when(F.col("play_type") == "run", F.col("yards_gained"))), F.sum(F.when(F.col("play_type") == "run", F.col("n_yards_gained"))))
    per = w.where(F.col("team").isNotNull()).join(z, TARGET).groupBy(*TARGET, "side", "team").agg(
        *[m.alias(k) for k, m in metrics.items()], plain_run.alias("plain_run"), F.sum(F.when(F.col("play_type") == "run", F.col("n"))).alias("runs")
    )
    off = per.where("side = 'off' and runs > 0").select(*TARGET, "team", *[(F.col("plain_run") if k == "run_ypp" else F.col(f"`{k}`")).alias(f"off_{k}") for k in metrics])
    dee = per.where("side = 'def'").select(*TARGET, "team", *[F.col(f"`{k}`").alias(f"def_{k}") for k in metrics if k not in ("run_%", "pass_%")])
    out = off.join(dee, [*TARGET, "team"], "left")
    units = _unit_sums(dated)
    return out.join(_series(units, history), [*TARGET, "team"], "left").join(_possession(units, history), [*TARGET, "team"], "left")


def _unit_sums(plays: DataFrame) -> DataFrame:
    """h_season, h_week, kind, team, s, c: the sum of units' means and their number.

    A unit is a game's series of either side (off, def), a game's drive in seconds (drive), or a game with a drive (game). Plays are shuffled
    once, by game, and a game's units are summed up where it lies: they are about as many as plays, so that summing them up before a shuffle saves nothing.
    """
    own = plays.na.drop(subset=["game_id"]).select(
        "season", "week", "game_id", "posteam", "defteam", "series", "drive", F.col("series_success").cast("double").alias("success"), S.clock_seconds(F.col("drive_time_of_possession")).cast("double").alias("sec")
    ).repartition(int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")), "season", "week", "game_id")
    # not a number is no unit either
    has_drive = F.when(F.col("drive").isNotNull() & (F.col("drive").cast("string") != "NaN"), F.lit(0))
    entries = [("off", "posteam", F.col("series"), F.col("success")), ("def", "defteam", F.col("series"), F.col("success")), ("drive", "posteam", F.col("drive"), F.col("sec")), ("game", "posteam", has_drive, F.lit(None).cast("double"))]
    structs = [F.struct(F.lit(kind).alias("kind"), F.col(team).alias("team"), unit.alias("unit"), x.alias("x")) for kind, team, unit, x in entries]
    long = own.select("season", "week", "game_id", F.inline(F.array(*structs))).na.drop(subset=["team", "unit"])
    unit = long.groupBy("season", "week", "game_id", "kind", "team", "unit").agg((F.coalesce(F.sum("x"), F.lit(0.0)) / F.count("*")).alias("m"))
    part = unit.groupBy(F.col("season").alias("h_season"), F.col("week").alias("h_week"), "kind", "team").agg(F.sum("m").alias("s"), F.count("*").alias("c"))
    return scratch.written(part, "unit-sums")


def _series(units: DataFrame, history: DataFrame) -> DataFrame:
    """Success per series, then the mean over series: units of one game share a date, so their weights cancel out."""
    laid = units.where("kind in ('off', 'def')").join(F.broadcast(history), ["h_season", "h_week"])
    per = laid.groupBy(*TARGET, "team").pivot("kind", ["off", "def"]).agg((F.sum("s") / F.sum("c")).alias("x"))
    return per.select(*TARGET, "team", F.col("off").alias("off_series_success_%"), F.col("def").alias("def_series_success_%"))


def _possession(units: DataFrame, history: DataFrame) -> DataFrame:
    """Seconds per drive, summed over a game, averaged over games."""
    seconds, games = F.sum(F.when(F.col("kind") == "drive", F.col("s"))), F.sum(F.when(F.col("kind") == "game", F.col("c")))
    laid = units.where("kind in ('drive', 'game')").join(F.broadcast(history), ["h_season", "h_week"])
    return laid.groupBy(*TARGET, "team").agg((seconds / 3600 / games).alias("off_possession_%"))


def passer_games(plays: DataFrame) -> DataFrame:
    """season, week, game_date, name, value: a passer's value in each game.

    A passer without a rusher row has a null rush count when scrambles are added, and the fill makes it 0: scrambles are lost then.
    """
    keys = ["season", "week", "game_date"]
    p = plays.where(F.col("passer").isNotNull() & F.col("game_date").isNotNull()).groupBy(*keys, F.col("passer").alias("name")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(a) for c, a in (
            ("qb_scramble", "qb_scramble"), ("rushing_yards", "scramble_yards"), ("incomplete_pass", "incomplete_pass"), ("complete_pass", "complete_pass"),
            ("passing_yards", "passing_yards"), ("pass_touchdown", "pass_touchdown"), ("interception", "interception"), ("sack", "sack"))]
    )
    r = plays.where(F.col("rusher").isNotNull()).groupBy(*keys, F.col("rusher").alias("name")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("rush_attempt", "rushing_yards", "rush_touchdown")])
    g = p.join(r, [*keys, "name"], "left").withColumns({
        "pass_attempt": F.col("incomplete_pass") + F.col("complete_pass"), "rush_attempt": F.col("rush_attempt") + F.col("qb_scramble"), "rushing_yards": F.col("rushing_yards") + F.col("scramble_yards"),
    }).na.fill(0.0)
    return g.select(*keys, "name", S.passer_value().alias("value"))


def passer_value(plays: DataFrame, sched: DataFrame, history: DataFrame, total: float = 160, steepness: float = 3, floor: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(season, week, name, weighted_qb_elo) and (season, week, team, def_qb_elo) of every target.

    The player rating always decays with steepness 4 and floor 0.4; only the defence takes the parameters.
    """
    games = scratch.written(passer_games(plays), "passer-games")
    days = scratch.written(plays.select(*TARGET, "home_team", "game_date").distinct(), "game-days")
    s = sched.where(F.col("game_type").isNotNull()).select("season", "week", "away_team", "home_team", S.short_name(F.col("away_qb_name")).alias("away_qb"), S.short_name(F.col("home_qb_name")).alias("home_qb"))
    s = J.attr_lookup(J.semi_keys(s, days, TARGET), days, ["season", "week", "home_team"], "game_date")
    value = games.select("season", "week", F.col("name"), "value")
    s = J.role_join(s, value, "name", {"away_qb": "away_", "home_qb": "home_"}, on=TARGET)
    faced = J.role_union(s, ["season", "week", "game_date"], [{"away_team": "team", "home_value": "value"}, {"home_team": "team", "away_value": "value"}]).where("game_date is not null")
    lay = lambda d: d.withColumnsRenamed({"season": "h_season", "week": "h_week"}).join(F.broadcast(history), ["h_season", "h_week"])

    def weighted(d: DataFrame, t: float, k: float, f: float) -> DataFrame:
        last = d.groupBy(*TARGET).agg(F.max("game_date").alias("last"))
        return d.join(last, TARGET).withColumn("w", S.decay(S.days_between(F.col("last"), F.col("game_date")), t, k, f))

    sums = lambda d, *keys: d.groupBy(*TARGET, *keys).agg(F.coalesce(F.sum(F.col("value") * F.col("w")), F.lit(0.0)).alias("sx"), F.sum("w").alias("sw"))
    dee = sums(weighted(lay(faced), total, steepness, floor), "team")
    centre = dee.groupBy(*TARGET).agg((F.sum("sx") / F.sum("sw")).alias("centre"))
    dee = dee.where("team is not null").join(centre, TARGET).select(*TARGET, "team", (F.col("sx") / F.col("sw") - F.col("centre")).alias("def_qb_elo"))
    own = sums(weighted(lay(games), total, 4, 0.4), "name").select(*TARGET, "name", (F.col("sx") / F.col("sw")).alias("weighted_qb_elo"))
    return own, dee


def starters(sched: DataFrame, ratings: DataFrame) -> DataFrame:
    """Adds the team that a rated passer starts for in the target week (null if none)."""
    short = sched.select(*TARGET, "away_team", "home_team", S.short_name(F.col("away_qb_name")).alias("away_qb"), S.short_name(F.col("home_qb_name")).alias("home_qb"))
    team = J.role_union(short, TARGET, [{"away_qb": "name", "away_team": "team"}, {"home_qb": "name", "home_team": "team"}])
    return ratings.withColumn("name", S.strip_suffix(F.col("name"))).join(team, [*TARGET, "name"], "left")


def passer_profile(ratings: DataFrame, sched: DataFrame) -> DataFrame:
    """team, off_passer_rating, def_passer_rating: means of own and opposing passers' ratings over a team's away games."""
    q = ratings.select("season", "week", "team_abbr", "passer_rating")
    side = lambda team, name: J.right_then_drop(
        sched, q.withColumnsRenamed({"team_abbr": team, "passer_rating": name}), ["season", "week", team], "away_team"
    )
    away, home = side("away_team", "off_passer_rating"), side("home_team", "def_passer_rating")
    both = J.nullsafe_left(away, home.select(*sched.columns, "def_passer_rating"), sched.columns)
    return both.groupBy(F.col("away_team").alias("team")).agg(F.avg("off_passer_rating").alias("off_passer_rating"), F.avg("def_passer_rating").alias("def_passer_rating"))


def _reversed(metric: Column) -> Column:
    """Direction of a metric's rank: defence reversed, and the other way round for turnovers and penalties."""
    return (F.substring(metric, 1, 3) == "def") != metric.rlike("turnovers|penalties")


def matchup_features(stats: DataFrame, pairs: DataFrame, target: Sequence[str] = TARGET, wanted: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Each pair's features: percentile ranks within the target, away against home, scaled by the away team's shares of play types."""
    needed = {f"{side}_{name[9:]}" for name in wanted for side in ("off", "def")}
    ranked = [c for c in stats.columns if c in needed]
    shares = [c for c in ("off_run_%", "off_pass_%") if c in stats.columns]
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in ranked]))
    long = stats.select(*target, "team", entries.alias("e")).select(*target, "team", "e.metric", "e.value")
    ranks = W.rank_metrics(long, target, _reversed(F.col("metric"))).groupBy(*target, "team").pivot("metric", ranked).agg(F.first("value"))
    if shares:
        ranks = ranks.join(stats.select(*target, "team", *[F.col(f"`{c}`") for c in shares]), [*target, "team"])
    both = J.matchup(pairs, ranks, target)
    out = []
    for name in wanted:
        side, metric = name[5:8], name[9:]
        other = "def" if side == "off" else "off"
        if f"{side}_{metric}" not in ranked or f"{other}_{metric}" not in ranked:
            continue
        x = F.col(f"`away_{side}_{metric}`") - F.col(f"`home_{other}_{metric}`")
        if side == "off" and "pass" in metric:
            x = x * (F.col("`away_off_pass_%`") + 0.5)
        elif side == "off" and "run" in metric:
            x = x * (F.col("`away_off_run_%`") + 0.5)
        out.append(x.alias(name))
    return both.select(*target, "away_team", "home_team", *out)


def _built(plays: DataFrame, sched: DataFrame, games: DataFrame, history: DataFrame, places: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    own, dee = passer_value(plays, sched, history)
    ratings = starters(games, own)
    best = ratings.where("team is not null").groupBy(*TARGET, "team").agg(F.min_by("weighted_qb_elo", "name").alias("off_qb_elo"))
    stats = reduce(lambda a, b: a.join(b, [*TARGET, "team"], "left"), [team_stats(plays, history), best, dee])
    stats = stats.select(*[S.rounded(F.col(f"`{c}`"), places[c]).alias(c) if c in places else F.col(f"`{c}`") for c in stats.columns]) if places else stats
    # a row a week and team, read three times from here on
    stats = scratch.written(stats, "team-stats")
    return games.join(matchup_features(stats, games), [*TARGET, "away_team", "home_team"], "left"), ratings


def feature_build(plays: DataFrame, sched: DataFrame, season: int, week: int, lookback: int) -> tuple[DataFrame, DataFrame]:
    """(features, passer ratings) of the target week and of every earlier week in reach of lookback, in one plan."""
    past = sched.where(~F.coalesce((F.col("season") == season) & (F.col("week") > week), F.lit(False)))
    cal = W.calendar(past)
    wanted = W.target_weeks(cal, season, week, lookback)
    history = W.history_weeks(cal, lookback).join(F.broadcast(wanted), TARGET, "left_semi")
    return _built(plays, past, past.join(F.broadcast(wanted), TARGET, "left_semi"), history)


def feature_build_all(plays: DataFrame, sched: DataFrame, lookback: int, places: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, passer ratings) of all weeks whose window is complete: a week's window ends before it, so weeks to come change nothing.

    places: decimals that statistics are rounded to before they are ranked, so that equal ones tie in whatever order their sums were added up.
    """
    history = W.history_weeks(W.calendar(sched), lookback)
    return _built(plays, sched, sched.join(history, TARGET, "left_semi"), history, places)
