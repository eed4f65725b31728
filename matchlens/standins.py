"""The supplied star schema seen as the domain's tables (see FIXTURES.md): the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("team"), (c("l_partkey") % 100).alias("opponent"), c("l_returnflag").alias("play_type"), c("l_linestatus").alias("status"),
        c("l_shipdate").cast("date").alias("game_date"), c("l_orderkey").alias("game_id"), (c("l_linenumber") % 3).alias("series"), c("l_linenumber").alias("drive"),
        c("l_quantity").alias("stat"), F.nullif(c("l_quantity"), F.lit(1.0)).alias("nstat"), (c("l_discount") > 0.05).cast("double").alias("made"),
        (c("l_tax") > 0.04).cast("double").alias("failed"), c("l_extendedprice").alias("price"), (c("l_discount") + 0.0).alias("discount"), (c("l_tax") + 0.0).alias("tax"), c("l_partkey").alias("part"),
    )


PLAYS = """plays as (select l_suppkey as team, l_partkey % 100 as opponent, l_returnflag as play_type, l_linestatus as status,
  cast(l_shipdate as date) as game_date, l_orderkey as game_id, l_linenumber % 3 as series, l_linenumber as drive, l_quantity as stat,
  nullif(l_quantity, 1.0) as nstat, cast(l_discount > 0.05 as int)::double as made, cast(l_tax > 0.04 as int)::double as failed,
  l_extendedprice as price, l_discount + 0.0 as discount, l_tax + 0.0 as tax, l_partkey as part from lineitem)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as a schedule: months are weeks, November and December are play-offs."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    week = F.month("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), week.alias("week"), F.when(week <= 10, "REG").otherwise("POST").alias("game_type"),
        F.col("c_nationkey").cast("long").alias("away_team"), (F.col("o_orderkey") % 25).alias("home_team"), F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("kickoff"), F.col("o_orderstatus").alias("status"),
    )


GAMES = """games as (select o_orderkey as game_id, year(o_orderdate)::int as season, month(o_orderdate)::int as week,
  case when month(o_orderdate) <= 10 then 'REG' else 'POST' end as game_type, c_nationkey::bigint as away_team, o_orderkey % 25 as home_team,
  o_totalprice as price, o_orderdate as kickoff, o_orderstatus as status from orders join customer on o_custkey = c_custkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, results and pseudo-predictions of an ensemble whose member is the line number."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("game_id"), c("l_linenumber").alias("member"), c("l_suppkey").alias("away_team"), (c("l_partkey") % 100).alias("home_team"),
        F.round(c("l_discount") * 100 - 5, 0).alias("spread_line"), F.round(c("l_tax") * 100 - 4, 0).alias("result"),
        ((c("l_partkey") * 7) % 21 - 10).cast("double").alias("prediction"), (c("l_quantity") / 10).alias("var"),
    )


PREDICTIONS = """predictions as (select l_orderkey as game_id, l_linenumber as member, l_suppkey as away_team, l_partkey % 100 as home_team,
  round(l_discount * 100 - 5, 0) + 0.0 as spread_line, round(l_tax * 100 - 4, 0) + 0.0 as result, ((l_partkey * 7) % 21 - 10)::double as prediction, l_quantity / 10 as var from lineitem)"""


def full_plays(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items as plays with every column that the team statistics read, and more; a game is an order's items of one day."""
    c, d = F.col, lambda x: x.cast("double")
    day = c("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.year(day).alias("season"), F.month(day).alias("week"), F.concat_ws("/", c("l_orderkey").cast("string"), day.cast("string")).alias("game_id"), day.alias("game_date"),
        F.nullif((c("l_suppkey") % 32).cast("string"), F.lit("31")).alias("posteam"), (c("l_partkey") % 32).cast("string").alias("defteam"),
        F.when(c("l_returnflag") == "A", "run").when(c("l_returnflag") == "R", "pass").when(c("l_linestatus") == "O", "punt").alias("play_type"),
        d(c("l_linenumber") % 3).alias("series"), d(c("l_linenumber") % 2).alias("drive"), d(c("l_quantity") > 25).alias("series_success"),
        F.concat(c("l_linenumber").cast("string"), F.lit(":"), F.lpad((c("l_partkey") % 60).cast("string"), 2, "0")).alias("drive_time_of_possession"),
        F.nullif(c("l_quantity"), F.lit(1.0)).alias("yards_gained"), d(c("l_discount") > 0.05).alias("complete_pass"), d(c("l_quantity") > 40).alias("first_down"),
        d(c("l_tax") > 0.04).alias("third_down_converted"), d(c("l_tax") < 0.02).alias("third_down_failed"), d(c("l_tax") > 0.06).alias("fourth_down_converted"), d(c("l_tax") < 0.01).alias("fourth_down_failed"),
        d(c("l_quantity") == 7).alias("interception"), d(c("l_quantity") == 9).alias("fumble_lost"), d(c("l_discount") < 0.01).alias("penalty"), *more,
    )


FULL_PLAYS = """p as (select year(l_shipdate)::int as season, month(l_shipdate)::int as week, l_orderkey || '/' || l_shipdate::date as game_id, l_shipdate::date as game_date, nullif((l_suppkey % 32)::varchar, '31') as pos,
  (l_partkey % 32)::varchar as def, case when l_returnflag = 'A' then 'run' when l_returnflag = 'R' then 'pass' when l_linestatus = 'O' then 'punt' end as kind, l_linenumber % 3 as series, l_linenumber % 2 as drive,
  (l_quantity > 25)::int as success, l_linenumber * 60 + l_partkey % 60 as sec, nullif(l_quantity, 1.0) as yards, (l_discount > 0.05)::int as complete, (l_tax > 0.04)::int as conv, (l_tax < 0.02)::int as failed,
  (l_quantity > 40)::int as first, (l_tax > 0.06)::int as conv4, (l_tax < 0.01)::int as failed4, (l_discount < 0.01)::int as pen,
  (l_quantity in (7, 9))::int as lost from lineitem),
weeks as (select season, week, (week <= 10)::int as reg from p group by 1, 2),
cal as (select *, sum(reg) over (order by season, week) as ro, row_number() over (order by season, week) as ord from weeks),
pairs as (select t.season, t.week, t.ord, h.season as h_season, h.week as h_week, h.ord as h_ord, q.ro - h.ro + h.reg as back,
  case when q.season = t.season and q.week = t.week - 1 then q.reg else 0 end as free, q.season = t.season and q.week = t.week - 1 as next
  from cal t join cal q on q.ord = t.ord - 1 join cal h on h.ord < t.ord),
hist as (select season, week, h_season, h_week from (select *, max(back - free) over (partition by season, week) as most from pairs) where most >= 3 and ((next and h_ord = ord - 1) or back - free < 3)),
l as (select h.season as ts, h.week as tw, p.* from hist h join p on p.season = h_season and p.week = h_week)"""
