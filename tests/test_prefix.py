"""Positions and running sums over a global order; scratch space in a session that names no shared folder."""

import os
import subprocess
import sys

from matchlens.operators import prefix


def test_positions(spark):
    rows = [(g, x) for g, xs in {"a": range(100), "b": [5, 5, 5, None, 1], None: [3, 2]}.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = {}
    for r in prefix.positions(df, ["g"], ["x"], partitions=9).collect():
        got.setdefault(r.g, []).append((r.pos, r.x))
    for g in got:
        xs = sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x or 0))
        assert sorted(got[g], key=lambda p: p[0]) == list(enumerate(xs))
    assert prefix.positions(df.where("false"), ["g"], ["x"]).collect() == []


def test_running_sum(spark):
    df = spark.range(500).selectExpr("id % 50 as t", "id as v")
    got = prefix.running_sum(df, [], ["t"], "v", "before", partitions=7).collect()
    assert len(got) == 500
    assert all(r.before == sum(v for v in range(500) if v % 50 < r.t) for r in got)


def test_own_folder_without_setting(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\nfrom matchlens import scratch\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert scratch.written(s.range(5), 'x').count() == 5 and scratch.shared_dir(s) == scratch.shared_dir(s)\nprint('fine')"
    )
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
