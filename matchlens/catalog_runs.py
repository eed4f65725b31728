"""Registered queries of whole runs (back-fill, ensemble, cached run, landing) on the supplied tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import scratch
from .catalog import BETS, HISTORY, KEYED, ODDS, ORACLES, PASSER_VALUES, TEAM_COLUMNS, TEAM_STATS, odds_feed, odds_mapping, query, r
from .functions import scalars as S
from .operators import aggregates as A
from .operators import windows as W
from .operators.median import exact_median
from .plans import features, model, odds, reports, runs
from .sources import tables
from .sources.schemas import SCHED_COLUMNS
from .standins import FULL_PLAYS, GAMES, PREDICTIONS, full_plays, games, predictions, table

# --- ensemble and back-fill -----------------------------------------------------------------------------------------

LOOKBACK, MEMBERS = 3, 4
#: Of both sides, with both directions of the rank and both kinds of scaling.
WANTED = ["away_off_run_ypp", "away_def_run_ypp", "away_off_pass_completion_%", "away_def_pass_ypp", "away_off_turnovers_pp", "away_def_turnovers_pp", "away_off_penalties_pp", "away_def_series_success_%"]
PASSERS = ("off_qb_elo", "def_qb_elo")
PLACES = {k: p for k, _, p in TEAM_COLUMNS} | dict.fromkeys(PASSERS, 4)
#: Statistics' names and their plain names.
PLAIN = {k: n for k, n, _ in TEAM_COLUMNS} | {k: k for k in PASSERS}


def team_games(plays):
    """A schedule from the plays themselves: a game a month and pair of teams; runs and passes make its scores."""
    won = lambda c, k: F.sum(F.when(F.col("play_type") == k, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0))
    pair = plays.where("posteam is not null").groupBy("season", "week", F.col("posteam").alias("away_team"), F.col("defteam").alias("home_team"))
    return pair.agg(won("yards_gained", "run").alias("away_score"), won("yards_gained", "pass").alias("home_score")).withColumns({
        "game_type": F.when(F.col("week") <= 10, "REG").otherwise("POST"), "result": F.col("home_score") - F.col("away_score"),
    })


def season_features(spark, d):
    """(games with label and features, calendar) of the line items: the statistics are rounded, so that equal ones tie."""
    plays = full_plays(spark, d)
    # a row a month and pair of teams: read for the calendar, the labels, the pairs and the back-fill
    games = scratch.written(team_games(plays), "team-games")
    cal = W.calendar(games)
    stats = features.team_stats(plays, W.history_weeks(cal, LOOKBACK))
    kept = [c for c in stats.columns if c in PLACES]
    stats = scratch.written(stats.select("season", "week", "team", *[S.rounded(F.col(f"`{c}`"), PLACES[c]).alias(c) for c in kept]), "season-stats")
    matched = features.matchup_features(stats, games, wanted=WANTED)
    return model.label(games).join(matched, model.GAME, "left"), cal


def _metric_sql(wanted=WANTED) -> str:
    """Ranks of the statistics that the wanted features need, as one table a metric and then side by side."""
    plain = PLAIN
    need = sorted({f"{side}_{w[9:]}" for w in wanted for side in ("off", "def")})
    long = " union all ".join(f"select season, week, team, '{k}' as metric, {plain[k]} as value, {int((k[:3] == 'def') != ('turnovers' in k or 'penalties' in k))} as reversed from s" for k in need)
    wide = ", ".join(f"max(pct) filter (metric = '{k}') as {plain[k]}" for k in need)
    return f"""long as ({long}), filled as (select season, week, team, metric, reversed, coalesce(value, median(value) over (partition by season, week, metric)) as value from long),
rk as (select *, rank() over (partition by season, week, metric order by value) + (count(*) over (partition by season, week, metric, value) - 1) / 2.0 as k, count(*) over (partition by season, week, metric) as n from filled),
wide as (select season, week, team, {wide} from (select *, case when reversed = 1 then (n - k + 1) / n else k / n end as pct from rk) group by all),
ranks as (select wide.*, s.off_run_share, s.off_pass_share from wide join s using (season, week, team))"""


def _feature_sql(name: str) -> str:
    side, metric = name[5:8], name[9:]
    plain, other = PLAIN[f"off_{metric}"][4:], "def" if side == "off" else "off"
    x = f"(a.{side}_{plain} - h.{other}_{plain})"
    if side == "off" and ("pass" in metric or "run" in metric):
        x += f" * (a.off_{'pass' if 'pass' in metric else 'run'}_share + 0.5)"
    return x


GAME_SQL = """g as (select season, week, pos as away_team, def as home_team, sum(case when kind = 'run' then coalesce(yards, 0) else 0 end) - sum(case when kind = 'pass' then coalesce(yards, 0) else 0 end) as label
  from p where pos is not null group by all)"""
#: x: the constant and the features of each game that has them all.
ROWS_SQL = "with " + FULL_PLAYS + f""", s as ({TEAM_STATS}), {_metric_sql()}, {GAME_SQL},
x as (select * from (select g.*, [1.0, {', '.join(map(_feature_sql, WANTED))}]::double[] as x from g join ranks a on a.season = g.season and a.week = g.week and a.team = away_team
  join ranks h on h.season = g.season and h.week = g.week and h.team = home_team) where len(list_filter(x, lambda v: v is null)) = 0)"""
N = len(WANTED) + 1
DRAW = " + ".join(f"(u >= {p!r})::int" for p in model.POISSON)
SUMS_SQL = ROWS_SQL + f""", m as (select * from range(0, {MEMBERS + 1}) t(member)),
u as (select season, week, member, list_append(x, label) as z, ('0x' || left(md5(member || '|' || season || '|' || week || '|' || away_team || '|' || home_team), 8))::bigint / 4294967296.0 as u from x, m),
dr as (select *, case when member = 0 then 1 else {DRAW} end as w from u),
ws as (select season, week, member, sum(w) as n, [{', '.join(f'sum(w * z[{i + 1}] * z[{j + 1}])' for i, j in model._pairs(N + 1))}] as s from dr where w > 0 group by all)"""


@query(SUMS_SQL + """ select season, week, member, n::bigint as n, round(s[1], 3) as s_ones, round(list_sum(s), 3) as s_all, round(s[len(s)], 3) as s_labels, round(s[2], 3) as s_first from ws""")
def ensemble_sums(spark, d):
    """What the ensemble's fits are made of: sums of products by week and member."""
    games, _ = season_features(spark, d)
    s = model.week_sums(model.game_rows(games, WANTED), N, MEMBERS)
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    return r(s.select("season", "week", "member", "n", F.col("s")[0].alias("s_ones"), total.alias("s_all"), F.element_at("s", -1).alias("s_labels"), F.col("s")[1].alias("s_first")), 3)


_AT = {p: k for k, p in enumerate(model._pairs(N + 1))}
_MATRIX = lambda s, ridge: "[" + ", ".join("[" + ", ".join(f"{s}[{_AT[min(i, j), max(i, j)] + 1}]" + (f" + {ridge}" if i == j and i else "") for j in range(N)) + f", {s}[{_AT[i, N] + 1}]]" for i in range(N)) + "]"
BACK_FILL_SQL = SUMS_SQL + f""", eligible as (select season as ts, week as tw from (select season, week, row_number() over (order by season, week) as rn from (select distinct season, week from g where week <= 10)) where rn > {LOOKBACK}),
windows as (select ts, tw, h_season as season, h_week as week from eligible join pairs on pairs.season = ts and pairs.week = tw where back <= {LOOKBACK}),
tsum as (select ts, tw, member, sum(n) as n, [{', '.join(f'sum(s[{k + 1}])' for k in range(len(_AT)))}] as s from windows join ws using (season, week) group by all),
eq as (select ts, tw, member, {_MATRIX('s', model.RIDGE)} as a from tsum where member > 0),
sol as (select ts, tw, member, list_transform(list_reduce(list_prepend(a, list_transform(range({N}), lambda k: [[k::double]])), lambda acc, st: list_transform(range({N}), lambda i:
    case when i = st[1][1]::int then list_transform(range({N + 1}), lambda j: acc[i + 1][j + 1] / acc[i + 1][i + 1])
    else list_transform(range({N + 1}), lambda j: acc[i + 1][j + 1] - acc[i + 1][st[1][1]::int + 1] * acc[st[1][1]::int + 1][j + 1] / acc[st[1][1]::int + 1][st[1][1]::int + 1]) end)), lambda row: row[{N + 1}]) as b from eq),
train as (select windows.ts, windows.tw, x.x, x.label from windows join x using (season, week)),
fit as (select ts, tw, member, any_value(b) as b, 1 - sum((label - list_dot_product(x, b)) ** 2) / (var_pop(label) * count(*)) as r2, count(*) as n_train from train join sol using (ts, tw) group by ts, tw, member),
pred as (select season, week, away_team, home_team, avg(round_even(list_dot_product(x, b), 1)) as prediction, var_samp(round_even(list_dot_product(x, b), 1)) as var from x join fit on season = ts and week = tw where r2 > 0 group by all)"""


def _back_fill(spark, d):
    games, cal = season_features(spark, d)
    return runs.back_fill_all(games, cal, runs.back_fill_weeks(games, LOOKBACK), LOOKBACK, WANTED, MEMBERS)


@query(BACK_FILL_SQL + " select season, week, away_team, home_team, round(prediction, 4) + 0.0 as prediction, round(var, 4) as var from pred")
def back_fill_all(spark, d):
    """Predictions of all eligible months by an ensemble trained on each month's own window, in one plan."""
    predicted, _ = _back_fill(spark, d)
    return r(predicted.withColumnsRenamed({"t_season": "season", "t_week": "week"}), 4)


@query(BACK_FILL_SQL + """ select ts as t_season, tw as t_week, coalesce(n_games, 0) as n_games, coalesce(n_predicted, 0) as n_predicted, coalesce(n_train, 0) as n_train, coalesce(n_members, 0) as n_members,
case when n_predicted is null then 'no features' when n_train is null then 'no training games' when n_members = 0 then 'no member explains anything' else 'done' end as status
from eligible left join (select season as ts, week as tw, count(*) as n_games from g group by all) using (ts, tw) left join (select season as ts, week as tw, count(*) as n_predicted from x group by all) using (ts, tw)
left join (select ts, tw, max(n_train) as n_train, count(*) filter (r2 > 0) as n_members from fit group by all) using (ts, tw)""")
def back_fill_status(spark, d):
    """A row a target month: what it had to go on, and why it has no predictions if it has none."""
    return _back_fill(spark, d)[1]


# --- the whole feature build --------------------------------------------------------------------------------------

#: A month is one game of each passer, so its plays share a date.
MONTH = ("l_shipdate::date as game_date", "date_trunc('month', l_shipdate)::date as game_date")
SCHEDULE = """sch as (select *, case when week <= 10 then 'REG' else 'POST' end as game_type, (week % 4 + 6)::int as away_rest, (season % 3 + 6)::int as home_rest, case when week <= 3 then 'dome' else 'outdoors' end as roof,
  'grass' as surface, case when week <= 10 then week * 2.0 end::double as temp, (season - 1990)::double as wind, 'Pat ' || away_team::int % 20 as away_qb_name, 'Pat ' || (home_team::int + 7) % 20 as home_qb_name,
  'C' || away_team as away_coach, 'C' || home_team as home_coach, 'R' || week as referee,
  from (select season, week, pos as away_team, def as home_team, sum(case when kind = 'run' then coalesce(yards, 0) else 0 end)::double as away_score, sum(case when kind = 'pass' then coalesce(yards, 0) else 0 end)::double as home_score
  from p where pos is not null group by all)),
nm as (select *, 'P.' || away_qb_name[5:] as away_qb, 'P.' || home_qb_name[5:] as home_qb from sch)"""
PASSER_SQL = PASSER_VALUES.format(day="date_trunc('month', l_shipdate)::date").replace("p as (", "pp as (", 1).replace("from p where", "from pp where") + """,
hv as (select h.season, h.week, name, value, game_date from hist h join v on v.season = h_season and v.week = h_week),
own as (select season, week, name, sum(value * w) / sum(w) as rating from (select *, greatest(exp(-4.0 * pow(date_diff('day', game_date, max(game_date) over (partition by season, week)) / 160.0, 3)), 0.4) as w from hv) group by all),
st as (select season, week, away_qb as name, away_team as team from nm union select season, week, home_qb, home_team from nm),
best as (select season, week, team, round(arg_min(rating, name), 4) as off_qb_elo from own join st using (season, week, name) group by all),
k as (select distinct season, week, def as home_team, game_date from p),
vs as (select nm.season, nm.week, away_team, home_team, k.game_date, x.value as away_value, y.value as home_value from nm join k using (season, week, home_team)
  left join v x on x.season = nm.season and x.week = nm.week and x.name = away_qb left join v y on y.season = nm.season and y.week = nm.week and y.name = home_qb),
faced as (select season, week, game_date, away_team as team, home_value as value from vs union all select season, week, game_date, home_team, away_value from vs),
fl as (select h.season, h.week, team, value, game_date from hist h join faced f on f.season = h_season and f.week = h_week),
fw as (select *, greatest(exp(-3.0 * pow(date_diff('day', game_date, max(game_date) over (partition by season, week)) / 160.0, 3)), 0.05) as w from fl),
fe as (select season, week, team, coalesce(sum(value * w), 0) as sx, sum(w) as sw from fw group by season, week, team), fc as (select season, week, sum(sx) / sum(sw) as centre from fe group by season, week),
allowed as (select season, week, team, round(sx / sw - centre, 4) as def_qb_elo from fe join fc using (season, week))"""
#: Shares scale features and are not ranked: they are ratios of counts and stay as they are.
SHARES = ("off_run_%", "off_pass_%")
SHARED_STATS = TEAM_STATS.replace(*MONTH).replace("round(o.run_share, 6) as", "o.run_share as").replace("round(o.pass_share, 6) as", "o.pass_share as")
FEATURE_SQL = "with " + FULL_PLAYS.replace(*MONTH) + f""", {SCHEDULE}, {PASSER_SQL}, s0 as ({SHARED_STATS}),
s as (select s0.*, off_qb_elo, def_qb_elo from s0 left join best using (season, week, team) left join allowed using (season, week, team)), {_metric_sql(features.FEATURES)},
f as (select g.season, g.week, away_team, home_team, {', '.join(f'{_feature_sql(w)} as "{w}"' for w in features.FEATURES)}
  from sch g left join ranks a on a.season = g.season and a.week = g.week and a.team = away_team left join ranks h on h.season = g.season and h.week = g.week and h.team = home_team)
"""


def passing_plays(spark, d):
    """Plays with the columns of passers and rushers too."""
    c, n = F.col, lambda x: x.cast("double")
    name = lambda x, k: F.concat(F.lit("P."), (c(x) % k).cast("string"))
    plays = full_plays(
        spark, d, (c("l_partkey") % 32).cast("string").alias("home_team"), F.when(c("l_returnflag") == "R", name("l_suppkey", 20)).alias("passer"), F.when(c("l_returnflag") == "A", name("l_partkey", 40)).alias("rusher"),
        n(c("l_discount") > 0.08).alias("qb_scramble"), F.nullif("l_quantity", F.lit(3.0)).alias("rushing_yards"), n(c("l_tax") > 0.05).alias("incomplete_pass"), c("l_quantity").alias("passing_yards"),
        n(c("l_quantity") > 45).alias("pass_touchdown"), n(c("l_tax") < 0.01).alias("sack"), F.lit(1.0).alias("rush_attempt"), n(c("l_quantity") > 48).alias("rush_touchdown"),
    )
    return plays.withColumn("game_date", F.trunc("game_date", "month"))


def full_schedule(plays):
    """The plays' games with every column of a schedule that the feature build reads; a team has other passers at home than away."""
    c, text = F.col, lambda lead, x: F.concat(F.lit(lead), x.cast("string"))
    number = lambda x: c(x).cast("int")
    return team_games(plays).withColumns({
        "away_rest": c("week") % 4 + 6, "home_rest": c("season") % 3 + 6, "roof": F.when(c("week") <= 3, "dome").otherwise("outdoors"), "surface": F.lit("grass"),
        "temp": F.when(c("week") <= 10, c("week") * 2.0).otherwise(F.lit(float("nan"))), "wind": (c("season") - 1990).cast("double"),
        "away_qb_name": text("Pat ", number("away_team") % 20), "home_qb_name": text("Pat ", (number("home_team") + 7) % 20),
        "away_coach": text("C", c("away_team")), "home_coach": text("C", c("home_team")), "referee": text("R", c("week")),
    })


@query(FEATURE_SQL + f"""select {', '.join(SCHED_COLUMNS)}, {', '.join(f'round("{w}", 6) + 0.0 as "{w}"' for w in features.FEATURES)} from sch join f using (season, week, away_team, home_team) where (season, week) in (select (season, week) from hist)""")
def feature_build(spark, d):
    """The feature build of all target months: the landed schedule's columns, and all features of each game."""
    plays, landed = passing_plays(spark, d), scratch.path(spark, "sched")
    tables.write_table(full_schedule(plays), landed)
    built, _ = features.feature_build_all(plays, tables.sched(spark, landed, SCHED_COLUMNS), LOOKBACK, {k: p for k, p in PLACES.items() if k not in SHARES})
    return r(built.select(*SCHED_COLUMNS, *[F.col(f"`{w}`") for w in features.FEATURES]))


@query("with " + FULL_PLAYS.replace(*MONTH) + f""", {SCHEDULE}, {PASSER_SQL} select season, week, name, round(rating, 4) + 0.0 as weighted_qb_elo, team, count(*) as n
from own left join (select season, week, away_qb as name, away_team as team from nm union all select season, week, home_qb, home_team from nm) using (season, week, name) group by all""")
def starter_ratings(spark, d):
    """Each passer's rating with the teams that the passer starts for in the target month (null if none), by the number of games."""
    plays = passing_plays(spark, d)
    sched = full_schedule(plays)
    own, _ = features.passer_value(plays, sched, W.history_weeks(W.calendar(sched), LOOKBACK))
    return features.starters(sched, r(own, 4)).groupBy("season", "week", "name", "weighted_qb_elo", "team").agg(F.count("*").alias("n"))


# --- medians and ranks of any size ------------------------------------------------------------------------------------


@query("select l_returnflag, round(median(l_extendedprice), 4) as mid, count(*) filter (l_extendedprice > 90000) as n_high from lineitem group by l_returnflag")
def hot_median(spark, d):
    """Medians of three groups, each too large for one task by the limit set here: their values are spread by range."""
    lines = table(spark, d, "lineitem")
    high = lines.groupBy("l_returnflag").agg(F.count_if(F.col("l_extendedprice") > 90000).alias("n_high"))
    return r(exact_median(lines, ["l_returnflag"], "l_extendedprice", "mid", large=1000).join(high, "l_returnflag").select("l_returnflag", "mid", "n_high"), 4)


@query("""with k as (select event_type, nullif(value, 0) as value, ts, rank() over (order by ts) + (count(*) over (partition by ts) - 1) / 2.0 as rk from events where ts is not null)
select event_type, round(sum(value * rk) / sum(rk), 6) as value from k where event_type is not null group by event_type""")
def rank_weight_times(spark, d):
    """Rank weights by time stamps, of which almost each event has its own."""
    e = table(spark, d, "events").select("event_type", F.nullif("value", F.lit(0.0)).alias("value"), "ts")
    return r(A.rank_weight_stat(e, "ts", ["event_type"], "value", "mean"))


# --- landing, scans and the cached run --------------------------------------------------------------------------------


@query("with " + FULL_PLAYS + " select p.season, p.week, count(*) as n, sum(success)::bigint as successes from p where (season, week) in (select (h_season, h_week) from hist where season = 1998 and week = 9) group by all")
def season_scan(spark, d):
    """Plays landed by season; those of one target's window, with the seasons that it doesn't touch left unread."""
    plays, path = full_plays(spark, d), tables.shared_path(spark, "landed-plays")
    tables.write_by_season(plays.select("season", "week", "series_success"), path)
    window = W.history_weeks(W.calendar(plays, regular=F.col("week") <= 10), LOOKBACK).where("season = 1998 and week = 9").select("h_season", "h_week")
    scan = tables.in_seasons(tables.parquet(spark, path), window)
    kept = scan.join(F.broadcast(window.withColumnsRenamed({"h_season": "season", "h_week": "week"})), ["season", "week"], "left_semi")
    return kept.groupBy("season", "week").agg(F.count("*").alias("n"), F.sum("series_success").cast("long").alias("successes"))


@query(ODDS)
def landed_odds(spark, d):
    """Consensus lines from the landed text of the feed: a JSON array a day, read an element a row."""
    path = tables.shared_path(spark, "landed-odds")
    feed = odds_feed(spark, d).select(F.to_json(F.struct("commence_time", "away_team", "home_team", "bookmakers")).alias("e"), F.col("commence_time").alias("day"))
    feed.groupBy("day").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ","), F.lit("]")).alias("text")).select("text").write.text(path)
    return odds.consensus(tables.odds_array(spark, path).where("_bad is null").drop("_bad"), odds_mapping(spark, d)).withColumn("date", F.col("date").cast("string"))


#: A season a member, four weeks each, so that windows are few files.
FEW = KEYED.replace("select game_id, member,", "select game_id % 4 as game_id, member,").replace("group by game_id, member,", "group by game_id % 4, member,")


@query(ORACLES["hit_rate"].replace(PREDICTIONS, FEW))
def csv_back_test(spark, d):
    """Predictions landed as CSV by window and read back into the back-test: hit rates by pick."""
    keys = ["season", "week", "away_team", "home_team"]
    rows = predictions(spark, d).withColumnsRenamed({"member": "season"}).withColumn("week", (F.col("game_id") % 4).cast("int")).groupBy(*keys)
    path = tables.shared_path(spark, "landed-csv")
    tables.write_keyed_csv(rows.agg(F.avg("prediction").alias("prediction"), F.min("var").alias("var")).select(*keys[:2], "home_team", "prediction", "var", "away_team"), path, "bt", 20)
    lines = rows.agg(F.min("spread_line").alias("spread_line"), F.min("result").alias("result"))
    back = tables.predictions_csv(spark, path, 20, "home_team long, prediction double, var double, away_team long")
    return r(reports.back_test(lines, back)["by_pick"])


@query("select c_name as team_name, c_mktsegment as abbr, c_custkey::varchar as abbr_2 from customer")
def header_promoted(spark, d):
    """A landed table without a header, whose first line names the columns, one name twice."""
    path = tables.shared_path(spark, "landed-headerless")
    c = table(spark, d, "customer").select(F.concat_ws(",", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")).alias("value"))
    head = spark.range(0, 1, numPartitions=1).select(F.lit("team_name,abbr,abbr").alias("value"))
    head.unionByName(c).write.text(path)
    return tables.promoted(spark, path)


@query("with " + HISTORY.format(n=3) + """ select h.season, h.week, away_team as team, count(*) as n, round(sum(price), 2) as price, 2::bigint as n_computed
from hist h join games g on g.season = h_season and g.week = h_week where h.season = 2000 and h.week = 3 group by all""")
def cached_run(spark, d):
    """A window read or computed four times: as it is twice, then twice with another version of its input; n_computed counts what was computed."""
    g, path, calls = games(spark, d), tables.shared_path(spark, "cached-run"), []

    def compute():
        calls.append(1)
        window = W.history_weeks(W.calendar(g), 3).where("season = 2000 and week = 3")
        played = g.withColumnsRenamed({"season": "h_season", "week": "h_week"}).join(F.broadcast(window), ["h_season", "h_week"])
        return played.groupBy("season", "week", F.col("away_team").alias("team")).agg(F.count("*").alias("n"), F.sum("price").alias("price"))

    before, after = tables.content_version(g.where("season < 2000")), tables.content_version(g)
    for version in (before, before, after, after):
        kept = tables.read_or_compute(spark, path, 2000, 3, 3, compute, version)
    return r(kept.withColumn("n_computed", F.lit(len(calls)).cast("long")), 2)


# --- the weekly report ------------------------------------------------------------------------------------------------

REPORT = "with " + GAMES + """, sched as (select season, week, away_team::varchar as away_team, home_team::varchar as home_team, min(kickoff)::date as gameday, lpad((away_team % 24)::varchar, 2, '0') || ':00' as gametime,
  'P.' || away_team % 20 as away_qb, 'P.' || home_team % 20 as home_qb, avg(price) / 10000 - 15 as prediction, nullif(min(price) / 300000, 0) as var from games group by season, week, games.away_team, games.home_team),
ratings as (select 'P.' || l_suppkey % 20 as name, avg(l_quantity) as elo from lineitem where year(l_shipdate) = 2000 and month(l_shipdate) = 3 and l_suppkey % 20 < 17 group by all),
lines as (select distinct away_team::varchar as away_team, home_team::varchar as home_team, ((away_team * 7 + home_team * 3) % 21 - 10) / 2.0 as spread from games),
b as (select s.*, spread, prediction + spread as d, x.elo as away_elo, y.elo as home_elo from lines join sched s using (away_team, home_team) left join ratings x on x.name = away_qb left join ratings y on y.name = home_qb where season = 2000 and week = 3)
select gameday::varchar as gameday, gametime, away_qb, round_even(away_elo, 1) as away_qb_elo, '../logos/' || away_team || '.png' as away_logo, away_team, round_even(spread, 1) + 0.0 as spread, round_even(-prediction, 1) + 0.0 as prediction, home_team,
  '../logos/' || home_team || '.png' as home_logo, home_qb, round_even(home_elo, 1) as home_qb_elo, round_even(abs(d), 1) as diff, round_even(var, 1) as var, case when d < 0 then home_team when d > 0 then away_team end as pick,
  coalesce(abs(prediction) > 1 and var <= 0.5 and abs(d) > 3, false)::int as picked, (spread * -prediction < 0)::int as underdog from b"""


@query(REPORT)
def weekly_report(spark, d):
    """A month's report from lines, predictions, schedule and ratings, written as CSV and read back."""
    g = games(spark, d)
    text, name = lambda c: F.col(c).cast("string"), lambda c: F.concat(F.lit("Pat "), (F.col(c) % 20).cast("string"), F.when(F.col(c) % 3 == 0, " Jr.").otherwise(""))
    pair = g.groupBy("season", "week", "away_team", "home_team").agg(F.to_date(F.min("kickoff")).cast("string").alias("gameday"), (F.avg("price") / 10000 - 15).alias("prediction"), F.nullif(F.min("price") / 300000, F.lit(0.0)).alias("var"))
    pair = pair.withColumns({"gametime": F.concat(F.lpad((F.col("away_team") % 24).cast("string"), 2, "0"), F.lit(":00")), "away_qb_name": name("away_team"), "home_qb_name": name("home_team")})
    pair = pair.withColumns({"away_team": text("away_team"), "home_team": text("home_team")})
    lines = g.select("away_team", "home_team").distinct().select(text("away_team").alias("away_team"), text("home_team").alias("home_team"), ((F.col("away_team") * 7 + F.col("home_team") * 3) % 21 - 10).alias("k")).withColumn("spread", F.col("k") / 2).drop("k")
    ratings = table(spark, d, "lineitem").where("l_suppkey % 20 < 17").groupBy(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), F.concat(F.lit("P."), (F.col("l_suppkey") % 20).cast("string")).alias("name")).agg(F.avg("l_quantity").alias("weighted_qb_elo"))
    report = reports.weekly_report(lines, pair.select("season", "week", "away_team", "home_team", "prediction", "var"), pair, ratings, 2000, 3)
    path = tables.shared_path(spark, "weekly-report")
    tables.write_csv(report, path)
    numbers = {c: F.col(c) + 0.0 for c in ("spread", "prediction")}
    return spark.read.schema(report.schema).csv(path, header=True).withColumns(numbers | {"gameday": F.col("gameday").cast("string")})
