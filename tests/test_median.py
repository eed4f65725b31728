"""Exact medians by ranges against those of one task; a hot group is not gathered."""

import random
import statistics

from matchlens.operators import median
from matchlens.operators import windows as W


def test_medians(spark):
    rnd = random.Random(2)
    rows = [("hot", float(rnd.randint(-50, 50))) for _ in range(3000)] + [("even", 1.0), ("even", 4.0), ("odd", 3.0), ("none", None), ("none", None), (None, 2.0), (None, 7.0), (None, None), ("one", 0.1), ("same", 5.0), ("same", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: (statistics.median(vs) if vs else None) for g in {k for k, _ in rows} for vs in [[v for k, v in rows if k == g and v is not None]]}
    for large in (10**6, 100, 0):
        assert {r.g: r.m for r in median.exact_median(df, ["g"], "v", "m", large).collect()} == {g: m for g, m in want.items() if large or m is not None or g == "none"}
    filled = W.impute_median(df.na.drop(subset=["g"]), "v", ["g"], 100).collect()
    assert len(filled) == len(rows) - 3 and {r.v for r in filled if r.g == "none"} == {None}


def test_hot_group_is_spread(spark):
    df = spark.range(0, 4000, numPartitions=4).selectExpr("'a' as g", "cast(id as double) as v")
    from matchlens.operators import prefix
    from pyspark.sql import functions as F

    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    summed = prefix.running_sum(counts, ["g"], ["v"], "n", "before", partitions=8)
    # each stretch is a partition of its own window; none has much more than its share
    plan = summed._jdf.queryExecution().toString()
    assert "Window" in plan and "__part" in plan
    assert median.ranged_median(df, ["g"], "v", "m").first().m == 1999.5
