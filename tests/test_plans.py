import math
import random

import pytest
from pyspark.sql import functions as F

from matchlens.operators import windows as W
from matchlens.plans import features, model, odds, reports, runs
from matchlens.sources import schemas, tables

TEAMS = ["AA", "BB", "CC", "DD"]
STATS = [f.split()[0] for f in schemas.PLAYS.replace("\n", " ").split(", ") if f.endswith("double")]


def world(seed=1, weeks=5):
    """A schedule of two seasons and random plays of its games, with nulls."""
    rnd = random.Random(seed)
    sched, plays = [], []
    for season in (2023, 2024):
        for week in range(1, weeks + 1):
            order = rnd.sample(TEAMS, 4)
            for away, home in ((order[0], order[1]), (order[2], order[3])):
                g = {"season": season, "week": week, "game_type": "REG" if week < weeks else "POST", "away_team": away, "home_team": home, "away_score": float(rnd.randint(0, 40)), "home_score": float(rnd.randint(0, 40)),
                     "spread_line": float(rnd.randint(-6, 6)), "gameday": f"{season}-09-{week * 5:02d}", "gametime": "13:00", "away_qb_name": f"Ann {away}", "home_qb_name": f"Bob {home} Jr."}
                g["result"] = g["home_score"] - g["away_score"]
                sched.append(g)
                for k in range(rnd.randint(20, 30)):
                    off, dee = (away, home) if rnd.random() < 0.5 else (home, away)
                    p = {c: float(rnd.random() < 0.3) if rnd.random() > 0.1 else None for c in STATS}
                    qb = f"{'A' if off == away else 'B'}.{off}"
                    p |= {"season": season, "week": week, "game_id": f"{season}{week}{away}", "game_date": g["gameday"], "home_team": home, "posteam": off if rnd.random() > 0.05 else None, "defteam": dee,
                          "play_type": rnd.choice(["run", "pass", "punt", "kickoff", "no_play", None]), "series": float(k // 4), "drive": float(k // 8), "drive_time_of_possession": f"{k % 3}:{k:02d}",
                          "yards_gained": float(rnd.randint(-5, 20)) if rnd.random() > 0.1 else None, "passer": qb if rnd.random() < 0.5 else None, "rusher": qb if rnd.random() < 0.2 else None, "passing_yards": float(rnd.randint(0, 30)), "rushing_yards": float(rnd.randint(0, 9))}
                    plays.append(p)
    return sched, plays


def frame(spark, data, schema):
    names = [f.strip().split(" ")[0] for f in schema.replace("\n", " ").split(", ")] if "<" not in schema else None
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    sched, plays = world()
    store = str(tmp_path_factory.mktemp("store"))
    tables.write_table(frame(spark, sched, schemas.SCHED), f"{store}/sched")
    tables.write_by_season(frame(spark, plays, schemas.PLAYS), f"{store}/pbp")
    return store, sched, plays


def decay(plays, k=3, total=160, floor=0.05):
    from datetime import date

    last = max((p["game_date"] for p in plays), default=None)
    days = [(date.fromisoformat(last) - date.fromisoformat(p["game_date"])).days for p in plays]
    w = [max(math.exp(-k * (d / total) ** 3), floor) for d in days]
    z = sum(w)
    return [x / z for x in w]


def direct_stat(plays, kinds, side, stat, agg):
    own = [p for p in plays if kinds is None or p["play_type"] in kinds]
    w = decay(own)
    out = {}
    for p, x in zip(own, w):
        if p[side] is not None:
            out.setdefault(p[side], []).append((p[stat], x))
    total = lambda v: sum((a or 0) * b for a, b in v)
    return {t: len(v) if agg == "count" else total(v) if agg == "sum" else total(v) / sum(b for _, b in v) for t, v in out.items()}


def test_team_stats_equal_a_direct_count(spark, tiny):
    store, sched, plays = tiny
    cal = W.calendar(tables.sched(spark, f"{store}/sched"))
    history = W.history_weeks(cal, 3)
    past = {(r.h_season, r.h_week) for r in history.where("season = 2024 and week = 3").collect()}
    own = [p for p in plays if (p["season"], p["week"]) in past]
    got = {r.team: r.asDict() for r in features.team_stats(tables.plays(spark, f"{store}/pbp"), history).where("season = 2024 and week = 3").collect()}
    six = features.FILTERS["six"]
    for team in TEAMS:
        g = got[team]
        runs_ = [p["yards_gained"] for p in own if p["play_type"] == "run" and p["posteam"] == team and p["yards_gained"] is not None]
        assert g["off_run_ypp"] == pytest.approx(sum(runs_) / len(runs_))
        for side, key in (("off", "posteam"), ("def", "defteam")):
            s = lambda kinds, stat, agg: direct_stat(own, kinds, key, stat, agg)[team]  # noqa: B023, E731
            if side == "def":
                assert g["def_run_ypp"] == pytest.approx(s(["run"], "yards_gained", "mean"))
            assert g[f"{side}_pass_completion_%"] == pytest.approx(s(["pass"], "complete_pass", "sum") / s(["pass"], "complete_pass", "count"))
            a, b = s(["run", "pass"], "third_down_converted", "sum"), s(["run", "pass"], "third_down_failed", "sum")
            assert g[f"{side}_third_down_%"] == pytest.approx(a / (a + b))
            assert g[f"{side}_turnovers_pp"] == pytest.approx((s(six, "interception", "sum") + s(six, "fumble_lost", "sum")) / s(six, "interception", "count"))
            assert g[f"{side}_penalties_pp"] == pytest.approx(s(None, "penalty", "sum") / s(None, "penalty", "count"))
            unit = {}
            for p in own:
                if p[key] == team:
                    unit.setdefault((p["game_id"], p["series"]), []).append(p["series_success"] or 0)
            assert g[f"{side}_series_success_%"] == pytest.approx(sum(sum(v) / len(v) for v in unit.values()) / len(unit))


def test_passer_value(spark, tiny):
    store, _, plays = tiny
    games = {(r.season, r.week, r.name): r.value for r in features.passer_games(tables.plays(spark, f"{store}/pbp")).collect()}
    from matchlens.functions.scalars import PASSER_VALUE

    for (season, week, name), value in games.items():
        own = lambda c, by: sum(p[c] or 0 for p in plays if (p["season"], p["week"], p[by]) == (season, week, name))  # noqa: B023, E731
        rushed = any((p["season"], p["week"], p["rusher"]) == (season, week, name) for p in plays)
        x = {c: own(c, "passer") for c in ("complete_pass", "passing_yards", "pass_touchdown", "interception", "sack")}
        x["pass_attempt"] = own("incomplete_pass", "passer") + x["complete_pass"]
        x["rush_attempt"] = own("rush_attempt", "rusher") + own("qb_scramble", "passer") if rushed else 0
        x["rushing_yards"] = own("rushing_yards", "rusher") + own("rushing_yards", "passer") if rushed else 0
        x["rush_touchdown"] = own("rush_touchdown", "rusher") if rushed else 0
        assert value == pytest.approx(sum(PASSER_VALUE[c] * v for c, v in x.items()))


def test_feature_build_and_runs(spark, tiny):
    store, sched, _ = tiny
    built, ratings = features.feature_build(tables.plays(spark, f"{store}/pbp"), tables.sched(spark, f"{store}/sched"), 2024, 4, 3)
    rows = built.collect()
    assert set(features.FEATURES) <= set(built.columns) and max(r.week for r in rows if r.season == 2024) == 4
    now = [r for r in rows if (r.season, r.week) == (2024, 4)]
    assert len(now) == 2 and all(r[f] is not None for r in now for f in features.FEATURES)
    assert all(-1.5 <= r[f] <= 1.5 for r in now for f in features.FEATURES)
    assert {r.name for r in ratings.where("season = 2024 and week = 4").collect()} <= {f"{x}.{t}" for x in "AB" for t in TEAMS}
    few = features.FEATURES[:3]
    predicted, metrics = runs.run(spark, store, 2024, 4, 3, members=3, columns=few)
    predicted = predicted.collect()
    assert metrics.count() == 3 and len(predicted) in (0, 2)
    again, _ = runs.run(spark, store, 2024, 4, 3, reuse=True, members=3, columns=few)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, predicted))
    weeks = runs.back_fill_weeks(tables.sched(spark, f"{store}/sched"), 3)
    assert sorted(map(tuple, weeks.collect())) == [(2023, 4), (2024, 1), (2024, 2), (2024, 3), (2024, 4)]
    # the back-fill of all weeks in one plan has the same predictions as the run of one week
    status = {(r.t_season, r.t_week): r.asDict() for r in runs.back_fill(spark, store, 3, members=3, columns=few).collect()}
    assert set(status) == {tuple(r) for r in weeks.collect()} and all(r["n_games"] == 2 or r["status"] == "no features" for r in status.values())
    kept = tables.window_slice(spark, f"{store}/bt", 2024, 4, 3).select("away_team", "home_team", "prediction", "var").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, predicted))


def test_matchup_by_hand(spark):
    stats = spark.createDataFrame([(1, "A", 5.0, 1.0, 0.25), (1, "B", 3.0, 2.0, 0.5), (1, "C", None, 3.0, 0.5)], "t int, team string, `off_run_ypp` double, `def_run_ypp` double, `off_run_%` double")
    pairs = spark.createDataFrame([(1, "A", "B")], "t int, away_team string, home_team string")
    r = features.matchup_features(stats, pairs, ["t"], ["away_off_run_ypp", "away_def_run_ypp"]).first()
    # ranks off: B 3, C median 4, A 5; defence reversed: A 1, B 2/3
    assert r["away_off_run_ypp"] == pytest.approx((1 - 2 / 3) * 0.75) and r["away_def_run_ypp"] == pytest.approx(1 - 1 / 3)


def test_passer_profile(spark):
    sched = spark.createDataFrame([(1, 1, "A", "B"), (1, 2, "B", "A"), (1, 3, "A", "C")], "season int, week int, away_team string, home_team string")
    q = spark.createDataFrame([(1, 1, "A", "x", 90.0), (1, 1, "A", "y", 70.0), (1, 1, "B", "z", 50.0), (1, 2, "A", "x", 10.0), (1, 3, "A", "x", 100.0)], schemas.PASSER_RATINGS)
    got = {r.team: (r.off_passer_rating, r.def_passer_rating) for r in features.passer_profile(q, sched).collect()}
    assert got["A"] == (pytest.approx(260 / 3), 50.0) and "B" not in got


def test_consensus(spark, tmp_path):
    feed = """[{"commence_time":"2025-09-07T17:00:00Z","away_team":"Rams","home_team":"Bears","bookmakers":[
      {"last_update":"2025-09-01T00:00:00Z","markets":[{"outcomes":[{"name":"Over","price":1.9,"point":44.5},{"name":"Under","price":1.9,"point":44.5}]},{"outcomes":[{"name":"Rams","price":1.9,"point":-3.0},{"name":"Bears","price":1.9,"point":3.0}]}]},
      {"last_update":"2025-09-01T00:00:00Z","markets":[{"outcomes":[{"name":"Over","price":1.8,"point":44.5}]},{"outcomes":[{"name":"Rams","price":1.7,"point":-3.0}]}]},
      {"last_update":"2025-09-02T00:00:00Z","markets":[{"outcomes":[{"name":"Over","price":1.9,"point":47.5}]},{"outcomes":[{"name":"Rams","price":1.9,"point":null}]}]}]}]"""
    (tmp_path / "book.json").write_text(feed)
    mapping = spark.createDataFrame([("Rams", "LA")], "old string, new string")
    r = odds.consensus(tables.odds(spark, str(tmp_path / "book.json")), mapping).collect()
    # the two books with equal point and time count once
    assert [(str(x.date), x.away_team, x.spread, x.home_team, x.total) for x in r] == [("2025-09-07", "LA", -3.0, "Bears", 46.0)]
    tables.land(spark, str(tmp_path / "book.json"), str(tmp_path / "bronze"))
    assert odds.flatten(tables.odds(spark, str(tmp_path / "bronze"))).count() == 8


def test_csv_keys_and_windows(spark, tmp_path):
    for name in ("bt_2024_5_20.csv", "bt_2024_6_20.csv", "bt_2024_7_40.csv", "notes.csv"):
        (tmp_path / name).write_text("home_team,prediction,var,away_team\nA,1.5,0.2,B\n")
    (tmp_path / "x.txt").write_text("no")
    assert sorted((r.season, r.week) for r in tables.predictions_csv(spark, str(tmp_path), 20).collect()) == [(2024, 5), (2024, 6)]
    assert tables.predictions_csv(spark, str(tmp_path)).count() == 3
    path, calls = str(tmp_path / "stats"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.read_or_compute(spark, path, 2024, 5, 20, compute).count() == 3
    assert len(calls) == 1
    assert tables.read_or_compute(spark, path, 2024, 6, 20, compute, reuse=False).count() == 3 and len(calls) == 2
    assert tables.published(spark, path, 2024, 5, 20).count() == 3 and tables.published(spark, path, 2024, 7, 20) is None
    # another version of the input, and a window that is empty
    assert tables.read_or_compute(spark, path, 2024, 5, 20, compute, "new").count() == 3 and len(calls) == 3
    assert tables.read_or_compute(spark, path, 2024, 5, 20, compute, "new").count() == 3 and len(calls) == 3
    for _ in range(2):
        assert tables.read_or_compute(spark, path, 2024, 8, 20, lambda: compute().where("id > 5")).count() == 0
    assert len(calls) == 4 and tables.published(spark, path, 2024, 6, 20).count() == 3
    tables.write_csv(spark.createDataFrame([("A", 1.5, None)], "home_team string, prediction double, var double"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["home_team", "prediction", "var"]


def test_nan_becomes_null_and_seasons_stay(spark, tmp_path):
    df = spark.createDataFrame([(2023, 1.0), (2024, float("nan"))], "season int, x double")
    tables.write_by_season(df, str(tmp_path / "p"))
    tables.write_by_season(df.where("season = 2024"), str(tmp_path / "p"))
    got = tables.parquet(spark, str(tmp_path / "p"))
    assert sorted((r.season, str(r.x)) for r in got.collect()) == [(2023, "1.0"), (2024, "None")]
    assert got.where(F.col("season").isin(1999)).count() == 0
    assert tables.replace_everywhere(spark.createDataFrame([("LAR", "x")], "a string, b string"), {"LAR": "LA"}).first().a == "LA"


def test_back_test_and_report(spark, tiny):
    store, games, _ = tiny
    sched = tables.sched(spark, f"{store}/sched")
    pred = spark.createDataFrame([(g["season"], g["week"], g["away_team"], g["home_team"], 2.25, 0.3) for g in games[:6]], "season int, week int, away_team string, home_team string, prediction double, var double")
    out = reports.back_test(sched, pred)
    hits = n = 0
    for g in games[:6]:
        diff = g["spread_line"] + 2.25
        pick = g["home_team"] if diff < 0 else g["away_team"]
        won = g["away_team"] if g["result"] < g["spread_line"] else g["home_team"] if g["result"] > g["spread_line"] else None
        if won:
            n += 1
            hits += pick == won
    by = out["by_pick"].agg(F.sum("hits"), F.sum("n")).first()
    assert (by[0], by[1]) == (hits, n)
    assert out["by_diff"].count() == 100 and out["by_variance"].count() == 50
    g = games[0]
    lines = spark.createDataFrame([(g["away_team"], 3.0, g["home_team"], 44.0)], "away_team string, spread double, home_team string, total double")
    ratings = spark.createDataFrame([(g["season"], g["week"], f"A.{g['away_team']}", 12.34)], "season int, week int, name string, weighted_qb_elo double")
    r = reports.weekly_report(lines, pred, sched, ratings, g["season"], g["week"]).first()
    assert (r.prediction, r["diff"], r.pick, r.away_qb_elo, r.home_qb_elo, r.away_logo) == (-2.2, 5.2, g["away_team"], 12.3, None, f"../logos/{g['away_team']}.png")
    assert r.underdog == 1 and r.picked == 1


def test_model_gate(spark):
    rnd = random.Random(1)
    rows = [(2024, w, f"a{k}", f"h{k}", float(3 * x + rnd.random()), 0.0, x, rnd.random()) for w in range(1, 6) for k in range(30) for x in [rnd.uniform(-5, 5)]]
    df = spark.createDataFrame(rows, "season int, week int, away_team string, home_team string, away_score double, home_score double, `away_x.%` double, noise double")
    predicted, metrics = model.predict(df, 2024, 5, members=4, columns=["away_x.%", "noise"])
    truth = {r[2]: r[4] for r in rows if r[1] == 5}
    got = {r.away_team: r.prediction for r in predicted.collect()}
    assert set(got) == set(truth) and all(abs(got[t] - truth[t]) < 2 for t in truth)
    assert all(r.r2 > 0.9 for r in metrics.collect())


def test_fits_equal_least_squares(spark):
    """Each target's and member's coefficients and metrics against a direct ridge solution on the drawn rows."""
    import hashlib

    import numpy as np

    rnd = random.Random(4)
    rows = [(1, w, f"a{k}", f"h{k}", 2 * a - b + rnd.gauss(0, 1), [1.0, a, b]) for w in range(1, 7) for k in range(15) for a, b in [(rnd.random(), rnd.gauss(0, 2))]]
    df = spark.createDataFrame(rows, "season int, week int, away_team string, home_team string, label double, x array<double>")
    windows = spark.createDataFrame([(1, t, 1, w) for t in (4, 6) for w in range(1, 7) if t - 3 <= w < t], "t_season int, t_week int, season int, week int")

    def drawn(m, r):
        u = int(hashlib.md5("|".join(map(str, (m, *r[:4]))).encode()).hexdigest()[:8], 16) / 2**32
        return sum(u >= p for p in model.POISSON)

    seen = 0
    for r in model.fit(df, windows, 3, 5).collect():
        own = [x for x in rows if r.t_week - 3 <= x[1] < r.t_week]
        X, y, w = np.array([x[5] for x in own]), np.array([x[4] for x in own]), np.array([drawn(r.member, x) for x in own])
        b = np.linalg.solve(X.T @ (X * w[:, None]) + np.diag([0, model.RIDGE, model.RIDGE]), X.T @ (w * y))
        e = y - X @ b
        assert r.b == pytest.approx(list(b)) and r.n_train == len(own) and r.mse == pytest.approx((e @ e) / len(own)) and r.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
        seen += 1
    assert seen == 10


def test_stream_of_plays(spark, tmp_path):
    from matchlens.streaming import partials

    _, plays = world(3)
    df = frame(spark, plays, schemas.PLAYS)
    for season in (2023, 2024):
        df.where(F.col("season") == season).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame(spark, [{"season": 2025, "week": 1, "game_date": "2026-12-01"}], schemas.PLAYS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sums = partials.partial_sums(partials.read_plays(spark, str(tmp_path / "in")), ["yards_gained"], "400 days")
    partials.keep_sums(sums, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("season = 2023").agg(F.sum("n"), F.sum("yards_gained")).first()
    own = [p for p in plays if p["season"] == 2023]
    assert got[0] == len(own) and got[1] == sum(p["yards_gained"] or 0 for p in own)
