import os

import pytest

import __spark_entry__ as entry
from matchlens import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_a_name_and_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["team", "stat"] and df.count() > 0


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    wrong = []
    for name, query in catalog.QUERIES.items():
        df = query(spark, sf_dir)
        rel = con.sql(catalog.ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        at = [rel.columns.index(c) for c in columns]
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        if mine != theirs:
            wrong.append((name, [p for p in zip(mine, theirs) if p[0] != p[1]][:2]))
    assert not wrong, wrong
