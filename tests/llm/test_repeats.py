import random

import brute
import numpy as np
import pytest

from matchlens.llm import common, repeats, suffix_dedup, vectors, window_index

DOCS = "doc_id long, text string, node int, bucket string, key double, found string, d int"


def made(seed, parts, n=250):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(n)]
    return rows + [(5001, None), (5002, ""), (5003, "x" * 49), (5004, " \n\t ")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 0.5, None, 3) for r in rows], DOCS).repartition(5)


@pytest.mark.parametrize("gathered", [repeats.WINDOWS_GATHERED, 3])
def test_bytes(spark, gathered, monkeypatch):
    monkeypatch.setattr(repeats, "WINDOWS_GATHERED", gathered)
    rnd = random.Random(7)
    parts = ["".join(rnd.choice("abcde é") for _ in range(rnd.randint(5, 120))) for _ in range(30)] + ["a" * 130, "ab" * 80, " " * 70]
    rows = made(1, parts)
    got = {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.dedup(table(spark, rows)).collect()}
    assert got == brute.byte_repeats(rows)


@pytest.mark.parametrize("gathered", [repeats.WINDOWS_GATHERED, 3])
def test_words(spark, gathered, monkeypatch):
    monkeypatch.setattr(repeats, "WINDOWS_GATHERED", gathered)
    rnd = random.Random(7)
    parts = [" ".join(rnd.choice(["a", "bb", "c", "é", "D"]) for _ in range(rnd.randint(5, 40))) + " " for _ in range(30)] + ["a " * 60, "a b " * 40, "\n \t x "]
    rows = made(2, parts)
    got = {r.doc_id: (r.n_tokens, r.n_removed, brute.sha(bytes(r.kept))) for r in window_index.dedup(table(spark, rows)).collect()}
    assert got == brute.word_repeats(rows)


def test_index_is_incremental(spark):
    text = " ".join(f"w{i}" for i in range(40))
    w = window_index.repeats.Windows(20, 6, words=True, same_document=True)
    index = window_index.Index(spark)
    first = window_index.add_batch(index, table(spark, [(1, text)]), w)
    assert first.where("key is null").count() == 0
    for i in (2, 3, 4):
        again = window_index.add_batch(index, table(spark, [(i, text)]), w)
        assert again.where("key is null").selectExpr("sum(hi - lo + 1)").first()[0] == 21
    assert len(index.tables) <= window_index.MAX_TABLES


def test_levels():
    """Any number of batches: few tables, and each entry is written once a level."""
    levels, sizes, written = [], [], 0
    for n in range(1, 201):
        keep, level = window_index.kept_tables(levels)
        size = 1 + sum(sizes[keep:])
        levels, sizes, written = [*levels[:keep], level], [*sizes[:keep], size], written + size
        assert sum(sizes) == n and written <= n * (1 + max(levels)) and 3 ** max(levels) <= n
        assert len(levels) <= window_index.MAX_TABLES * (1 + max(levels))
        if n == 20:
            assert written < 4 * n


def test_many_batches(spark):
    """Tables of three levels: found as by a plain version, entries written less than four times, no table of the catalog left."""
    rnd = random.Random(5)
    parts = [" ".join(rnd.choice(["a", "bb", "c", "é", "D"]) for _ in range(rnd.randint(15, 40))) + " " for _ in range(25)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(3))) for i in range(60)] + [(100 + i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(30)]
    docs = table(spark, rows)
    before = len(spark.catalog.listTables())
    w = repeats.Windows(20, 6, words=True, same_document=True)
    index, found, wrote = window_index.Index(spark, common.scratch(spark, "many-batches")), None, 0
    entries = lambda t: t.selectExpr("coalesce(sum(length(key16)), 0)").first()[0]
    for batch in window_index.batches_of(docs, 11):
        one = window_index.add_batch(index, batch, w)
        wrote += entries(index.tables[-1])
        found = one if found is None else found.unionByName(one)
    assert index.levels == [2, 0, 0] and wrote < 4 * sum(map(entries, index.tables))
    assert len(spark.catalog.listTables()) == before
    windows = repeats.ranked(repeats.open_windows(docs, found.where("key is not null").distinct(), w), w)
    out = repeats.removed(docs, found.where("key is null").unionByName(windows), w)
    assert {r.doc_id: (r.n_tokens, r.n_removed, brute.sha(bytes(r.kept))) for r in out.collect()} == brute.word_repeats(rows)


def test_null_and_repeated_ids(spark):
    long = "0123456789" * 6
    out = suffix_dedup.dedup(table(spark, [(None, long), (7, long), (7, long), (7, "other"), (3, "tiny")]))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_removed) for r in out.collect())
    assert got == [("3", 4, 0), ("7", 5, 0), ("7", 60, 0), ("7", 60, 0), ("None", 60, 60)]


@pytest.mark.parametrize("dedup", [suffix_dedup.dedup, window_index.dedup])
def test_empty(spark, dedup):
    assert dedup(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_index_is_opened_again(spark):
    """Another session's batch is decided against the history in the folder; the history isn't shuffled again."""
    w = repeats.Windows(20, 6, words=True, same_document=True)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    path = common.scratch(spark, "index-test")
    for k in range(4):
        index = window_index.Index(spark, path)
        assert index.version == k and len(index.files) == min(k, 1 + (k - 1) % window_index.MAX_TABLES if k else 0)
        found = window_index.add_batch(index, table(spark, [(10 * k + 1, text(k)), (10 * k + 2, text(max(0, k - 1)))]), w)
        rows = found.where("key is null").groupBy("doc_id").agg({"lo": "count"}).collect()
        assert [r.doc_id for r in rows] == [10 * k + 2]
    opened = window_index.Index(spark, path)
    rows = repeats.run_rows(table(spark, [(99, "a")]), w, opened.buckets).repartition(opened.parts, "bucket")
    for t in opened.tables:
        rows = rows.unionByName(t.select(*window_index.COLUMNS))
    plan = rows.groupBy("bucket").applyInArrow(lambda t: t, repeats.RUNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan


def test_documents_without_an_id(spark):
    long = "0123456789" * 8
    rows = [(None, f"{k} {long}") for k in range(30)] + [(None, "seen before: " + "xyz" * 30), (5, "xyz" * 30)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(table(spark, rows)).collect())
    assert got == sorted([("5", 0), ("None", 90)] + [("None", 0)] * 30)


def test_words_of_pieces():
    rows = [b"  a bb\tccc", b"", b"d", b" \n"]
    off = np.cumsum([0, *map(len, rows)])
    starts, ends, first = vectors.words(np.frombuffer(b"".join(rows), np.uint8), off)
    raw = b"".join(rows)
    assert [raw[a:b] for a, b in zip(starts, ends)] == [b"a", b"bb", b"ccc", b"d"]
    assert first.tolist() == [0, 3, 3, 4, 4]
