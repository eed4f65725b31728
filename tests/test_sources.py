"""Landed feeds, keyed files, promoted headers, pruned scans and the skew-aware sink."""

import json

from pyspark.sql import functions as F

from matchlens.sources import schemas, tables


def test_season_scan_is_pruned(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(2000 + id % 10 as int) as season", "id as x")
    tables.write_by_season(df, str(tmp_path / "p"))
    weeks = spark.createDataFrame([(2003, 1, 5), (2003, 2, 6), (2004, 1, 7)], "h_season int, h_week int, t int").where("t > 4")
    scan = tables.in_seasons(tables.parquet(spark, str(tmp_path / "p")), weeks)
    assert "dynamicpruning" in scan._jdf.queryExecution().executedPlan().toString().lower()
    assert scan.groupBy("season").count().count() == 2 and scan.count() == 200


def test_hot_season_is_written_by_many_tasks(spark, tmp_path):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000, numPartitions=8).selectExpr("cast(if(id % 10 = 0, 2001, 2000) as int) as season", "uuid() as x")
        tables.write_by_season(df, str(tmp_path / "p"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = lambda s: len(list((tmp_path / f"p/season={s}").glob("*.parquet")))
    assert files(2000) >= 5
    tables.write_by_season(spark.range(3).selectExpr("cast(2001 as int) as season", "'a' as x"), str(tmp_path / "p"))
    assert {r.season: r["count"] for r in tables.parquet(spark, str(tmp_path / "p")).groupBy("season").count().collect()} == {2000: 54_000, 2001: 3}


def test_one_array_in_many_tasks(spark, tmp_path):
    books = [{"last_update": "2025-09-01T00:00:00Z", "markets": [{"outcomes": [{"name": 'O "v" {"commence_time"', "price": 1.5, "point": 2.0}]}]}]
    rows = [{"commence_time": f"2025-09-{i % 28 + 1:02d}", "away_team": f"a{i} é", "home_team": "[x],]", "bookmakers": books} for i in range(3000)]
    text = json.dumps(rows, ensure_ascii=False, indent=None, separators=(", ", ":"))
    text = text.replace('"away_team":"a7 é"', '"away_team":7.5.')
    (tmp_path / "feed.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        feed = tables.odds_array(spark, str(tmp_path / "feed.json"))
        assert feed.rdd.getNumPartitions() > 4
        got = feed.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and [r._bad is not None for r in got].count(True) == 1
    good = {r.away_team: r for r in got if r._bad is None}
    assert len(good) == 2999 and good["a8 é"].bookmakers[0].markets[0].outcomes[0].name == 'O "v" {"commence_time"' and good["a8 é"].home_team == "[x],]"
    (tmp_path / "none.json").write_text("[]")
    assert tables.odds_array(spark, str(tmp_path / "none.json")).collect() == []


def test_keyed_csv_accounts_for_all(spark, tmp_path):
    (tmp_path / "bt_2024_5_20.csv").write_text("home_team,prediction,var,away_team\nA,1.5,0.2,B\nC,x,0.2,D\n")
    (tmp_path / "notes.csv").write_text("home_team,prediction,var,away_team\nA,1.5,0.2,B\n")
    df = spark.createDataFrame([(2024, w, "A", 1.25 * w, None, "B") for w in (6, 7)], f"season int, week int, {schemas.PREDICTIONS}")
    tables.write_keyed_csv(df, str(tmp_path / "landed"), "bt", 20)
    got = sorted((r.season, r.week, r.home_team, r.prediction) for r in tables.predictions_csv(spark, str(tmp_path), 20).collect())
    assert got == [(2024, 5, "A", 1.5), (2024, 6, "A", 7.5), (2024, 7, "A", 8.75)]
    account = {r.file.rpartition("=")[2]: (r.keyed, r.n_rows, r.n_bad) for r in tables.csv_account(spark, str(tmp_path)).collect()}
    assert account == {"bt_2024_5_20.csv": (True, 2, 1), "notes.csv": (False, 1, 0), "bt_2024_6_20.csv": (True, 1, 0), "bt_2024_7_20.csv": (True, 1, 0)}


def test_header_is_promoted(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/part-0.csv").write_text('team_name,abbr,"abbr"\n"Rams, LA",LA,x\n')
    (tmp_path / "t/part-1.csv").write_text("".join(f"T{i},{i},y\n" for i in range(50)) + "team_name,abbr,abbr\n")
    df = tables.promoted(spark, str(tmp_path / "t"))
    assert df.columns == ["team_name", "abbr", "abbr_2"] and df.count() == 52
    assert df.where(F.col("abbr") == "LA").first().team_name == "Rams, LA"


def test_schedule_columns(spark, tmp_path):
    """Of the wanted columns only; one that the files lack is null, and so is a number that is none."""
    path = str(tmp_path / "sched")
    spark.createDataFrame([(2020, 1, "A", "B", float("nan"), 3.5)], "season int, week int, away_team string, home_team string, temp double, spread_line double").write.parquet(path)
    df = tables.sched(spark, path, schemas.SCHED_COLUMNS)
    assert df.columns == schemas.SCHED_COLUMNS
    row = df.first()
    assert (row.season, row.away_team, row.temp, row.roof, row.away_score) == (2020, "A", None, None, None)
    assert "spread_line" not in df._jdf.queryExecution().executedPlan().toString()
