import math
import random

import pytest
from pyspark.sql import functions as F

from matchlens.functions import scalars as S
from matchlens.operators import aggregates as A
from matchlens.operators import joins as J
from matchlens.operators import windows as W


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def plays(spark):
    data = [
        ("2024-09-01", "A", "run", 4.0), ("2024-09-01", "A", "run", None), ("2024-09-11", "A", "pass", 7.0), ("2024-09-11", "B", "run", 2.0), ("2024-09-01", "B", "pass", None),
        ("2024-09-11", None, "run", 9.0), ("2024-09-11", "C", None, 5.0), ("2024-09-01", "D", "run", None),
    ]
    return spark.createDataFrame(data, "d string, team string, play_type string, x double").withColumn("d", F.to_date("d"))


def weight(days, total=160, k=3, floor=0.05):
    return max(math.exp(-k * (days / total) ** 3), floor)


def test_decay_stat(spark):
    p = A.keep(plays(spark), "play_type", ["run", "pass"])
    w = {0: weight(0), 10: weight(10)}
    mean = dict(rows(A.decay_stat(p, "d", ["team"], "x", "mean")))
    # a null value keeps its weight in the denominator; a group without values is 0; null keys are dropped
    assert mean["A"] == pytest.approx((4 * w[10] + 7 * w[0]) / (2 * w[10] + w[0]))
    assert mean["D"] == 0 and set(mean) == {"A", "B", "D"}
    z = 4 * w[10] + 3 * w[0]  # the row without a team counts here
    assert dict(rows(A.decay_stat(p, "d", ["team"], "x", "sum")))["B"] == pytest.approx(2 * w[0] / z)
    assert dict(rows(A.decay_stat(p, "d", ["team"], "x", "count"))) == {"A": 3, "B": 2, "D": 1}


def test_weights_sum_to_one(spark):
    p = plays(spark).withColumn("one", F.lit(1.0)).where("team is not null")
    assert sum(v for _, v in rows(A.decay_stat(p, "d", ["team"], "one", "sum"))) == pytest.approx(1)
    assert sum(v for _, v in rows(A.rank_weight_stat(p, "d", ["team"], "one", "sum"))) == pytest.approx(1)


def test_partial_sums_equal_direct_weights(spark):
    rnd = random.Random(1)
    data = [(rnd.randrange(300), rnd.choice("abc") if rnd.random() > 0.1 else None, rnd.random() if rnd.random() > 0.2 else None) for _ in range(500)]
    df = spark.createDataFrame(data, "o int, team string, x double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("o")))
    last = max(o for o, _, _ in data)
    w = [weight(last - o) for o, _, _ in data]
    for t in "abc":
        own = [(x, k) for (_, u, x), k in zip(data, w) if u == t]
        got = dict(rows(A.decay_stat(df, "d", ["team"], "x", "mean")))[t]
        assert got == pytest.approx(sum((x or 0) * k for x, k in own) / sum(k for _, k in own))


def test_rank_weights(spark):
    p = plays(spark).where("play_type = 'run'")
    # days ago: three rows on the first day (average rank 2), two on the last (4.5)
    got = dict(rows(A.rank_weight_stat(p, "d", ["team"], "x", "mean")))
    assert got["A"] == pytest.approx(4 * 2 / 4) and got["B"] == 2 and got["D"] == 0


def test_plain_stat_counts_values(spark):
    p = plays(spark)
    assert dict(rows(A.plain_stat(p, ["team"], "x", "count"))) == {"A": 2, "B": 1, "C": 1, "D": 0}
    assert dict(rows(A.plain_stat(p, ["team"], "x", "sum")))["D"] == 0
    assert dict(rows(A.plain_stat(p, ["team"], "x", "mean")))["D"] is None


def test_levels(spark):
    df = spark.createDataFrame([("g", 1, "A", 1.0), ("g", 1, "A", 1.0), ("g", 2, "A", None), ("h", 1, "A", 0.0), (None, 1, "A", 9.0)], "game string, series int, team string, x double")
    assert rows(A.two_level(df, ["game", "series"], "team", "x")) == [("A", pytest.approx(1 / 3))]
    assert rows(A.three_level(df, ["game"], ["series"], "team", "x", 2)) == [("A", pytest.approx((0.5 + 0) / 2))]


def test_bins(spark):
    df = spark.createDataFrame([(x, h) for x, h in [(0.0, 1), (0.1, 1), (0.3, 0), (10.0, 1), (11.0, 1), (None, 1), (0.30000001, 1)]], "x double, hit int")
    got = {r.bin: (r.miss, r.hit) for r in A.bin_crosstab(df, "x", "hit", 100, 10).collect()}
    assert len(got) == 100 and got[0] == (0, 1) and got[2] == (1, 0) and got[3] == (0, 1) and got[99] == (0, 1)
    assert sum(a + b for a, b in got.values()) == 4
    rnd = random.Random(3)
    xs = [i / 10 for i in range(0, 101)] + [rnd.uniform(-1, 11) for _ in range(300)]
    got = {r.bin: r.hit for r in A.bin_crosstab(spark.createDataFrame([(x, 1) for x in xs], "x double, hit int"), "x", "hit", 100, 10).collect()}
    assert got == {b: sum(b * 10.0 / 100 < x <= (b + 1) * 10.0 / 100 for x in xs) for b in range(100)}


def test_metrics_and_gate(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, -2.0, 1.0), (2, 1.0, 1.0), (2, 3.0, 2.5)], "m int, y double, p double")
    r2, mae, mse = rows(A.regression_metrics(df, "y", "p"))[0]
    assert mae == pytest.approx(1.125) and mse == pytest.approx((1 + 9 + 0 + 0.25) / 4) and r2 == pytest.approx(1 - 10.25 / 14)
    assert rows(A.sign_loss(df, "y", "p"))[0][0] == pytest.approx((1 + 1.3 * 9 + 0.25) / 4)
    assert {r.m for r in A.gated(df, "m", "y", "p").collect()} == {2}
    assert rows(A.ensemble(df.where("m = 1 or y = 1"), ["m"], "p").orderBy("m")) == [(1, 1.0, 0.0), (2, 1.0, None)]


def test_ranks(spark):
    df = spark.createDataFrame([("t", x) for x in (1.0, 2.0, 2.0, 5.0)], "g string, x double")
    got = rows(df.select("x", W.pct_rank("x", ["g"]), W.pct_rank("x", ["g"], True)).orderBy("x"))
    assert [r[1] for r in got] == [0.25, 0.625, 0.625, 1.0]
    assert all(a + b == pytest.approx(5 / 4) for _, a, b in got)
    some = spark.createDataFrame([("t", 1.0), ("t", None), ("t", 3.0)], "g string, x double")
    assert sorted(r.x for r in W.impute_median(some, "x", ["g"]).collect()) == [1, 2, 3]


def season_games(spark):
    return spark.createDataFrame([(s, w, "REG" if w <= 4 else "POST") for s in (2020, 2021, 2022) for w in range(1, 7)], "season int, week int, game_type string")


def test_history_weeks(spark):
    h = {}
    for s, w, a, b in rows(W.history_weeks(W.calendar(season_games(spark)), 3)):
        h.setdefault((s, w), set()).add((a, b))
    assert h[2022, 1] == {(2021, 6), (2021, 5), (2021, 4), (2021, 3)}
    assert h[2022, 4] == {(2022, 3), (2022, 2), (2022, 1), (2021, 6), (2021, 5)}
    assert all(p < t for t, past in h.items() for p in past)
    assert (2020, 3) not in h


@pytest.mark.parametrize("seed", range(4))
def test_history_equals_the_walk(spark, seed):
    rnd = random.Random(seed)
    weeks = [(s, w, "REG" if w <= n - 2 or rnd.random() < 0.3 else "POST") for s in range(2018, 2023) for n in [rnd.randint(4, 8)] for w in range(1, n + 1)]
    kind, last = {(s, w): g for s, w, g in weeks}, {}
    for s, w, _ in weeks:
        last[s] = max(w, last.get(s, 0))
    for lookback in (1, 2, 5):
        want = {}
        for s, w, _ in weeks:
            a, b, left, past = s, w - 1, lookback, set()
            try:
                while left > 0:
                    past |= {(a, b)} & set(kind)
                    b -= 1
                    if b <= 0:
                        a -= 1
                        b = last[a]
                    if kind[a, b] == "REG":
                        left -= 1
                want[s, w] = past
            except KeyError:
                pass
        got = {}
        for s, w, a, b in rows(W.history_weeks(W.calendar(spark.createDataFrame(weeks, "season int, week int, game_type string")), lookback)):
            got.setdefault((s, w), set()).add((a, b))
        assert got == {k: v for k, v in want.items() if v}


def test_targets(spark):
    got = set(rows(W.target_weeks(W.calendar(season_games(spark)), 2022, 2, 2)))
    assert got == {(2022, 2), (2022, 1), (2021, 6), (2021, 5), (2021, 4)}


def test_scalars(spark):
    names = spark.createDataFrame([("Patrick Mahomes",), ("Solo",), (None,), ("  Ann  Lee Jr. ",)], "n string")
    assert [r[0] for r in names.select(S.short_name(F.col("n"))).collect()] == ["P.Mahomes", None, None, "A.Lee"]
    suffix = spark.createDataFrame([(x,) for x in ("M Penix Jr.", "A Sr.", "B III", "C IV", "D Jr")], "n string")
    assert [r[0] for r in suffix.select(S.strip_suffix(F.col("n"))).collect()] == ["M Penix", "A", "B", "C IV", "D Jr"]
    assert one(spark, S.clock_seconds(F.lit("2:05"))) == 125 and one(spark, S.clock_seconds(F.lit("x"))) is None
    assert one(spark, S.round_even(F.lit(0.25))) == 0.2 and one(spark, S.signed(F.lit(3.0))) == "+3.0" and one(spark, S.signed(F.lit(-1.26))) == "-1.3"
    ts = F.lit("2025-10-05 13:05:00").cast("timestamp")
    assert one(spark, S.report_day(F.to_date(ts))) == "Sun 10/05" and one(spark, S.report_time(ts)) == "1:05 PM" and one(spark, S.time_of_day(ts)) == "13:05"
    assert one(spark, S.iso_timestamp(F.lit("bad"))) is None and str(one(spark, S.iso_date(F.lit("2025-10-05T17:00:00Z")))) == "2025-10-05"
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None
    null = F.lit(None).cast("double")
    assert one(spark, S.pick(null, F.lit("h"), F.lit("a"))) is None and one(spark, S.flag(null > 1)) == 0
    assert one(spark, S.winner(F.lit(3.0), F.lit(3.0), F.lit("h"), F.lit("a"))) is None
    assert one(spark, S.sign_switch(F.lit(-1.0), F.lit(2.0))) == 1 and one(spark, S.disagree(F.lit(0.0), F.lit(2.0))) == 0


def test_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None, 5), (2, "x", 6), (2, "x", 7)], "k int, v string, z int")
    assert sorted(map(str, rows(J.nullsafe_left(a, b, ["k", "v"])))) == sorted(map(str, [(1, None, 5), (2, "x", 6), (2, "x", 7), (2, "x", 6), (2, "x", 7)]))
    assert rows(J.semi_keys(a, b.where("k = 2"), ["k"])) == [(2, "x")]
    assert sorted(r[0] for r in rows(J.distinct_over(b, ["k", "z"], "t"))) == [1, 2, 5, 6, 7]
    mapping = spark.createDataFrame([("x", "X")], "old string, new string")
    assert sorted(map(str, (r.v for r in J.replace_values(a, mapping, ["v"]).collect()))) == ["None", "X", "X"]
