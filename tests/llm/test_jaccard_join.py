import random

import brute
import numpy as np
import pytest

from matchlens.llm import jaccard_join as jj
from matchlens.llm.components import components


def rows_of(seed):
    rnd, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(120):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 12, 15, 30, 60]))]
        for j in range(3):
            copy = list(base)
            for _ in range(j):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append((len(out), " ".join(copy)))
    return out + [(5001, None), (5002, ""), (5003, " \n"), (5004, "ÄB A b"), (5005, "Äb a B")]


@pytest.mark.parametrize("rule", [jj.Rule(3, 90, 100), jj.Rule(5, 8, 10)])
@pytest.mark.parametrize("block", [None, 7])
def test_same_as_all_pairs(spark, rule, block, monkeypatch):
    if block:
        monkeypatch.setattr(jj, "BLOCK_SETS", block)
        monkeypatch.setattr(jj, "BROADCAST_ROWS", 0)
    rows = rows_of(rule.words)
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, n int, tree string, rep int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.classes(docs, rule).collect()}
    want = brute.jaccard_classes(rows, rule.words, rule.num, rule.den)
    assert got == want
    kept = {r.doc_id for r in jj.one_of_each(docs, rule).collect()}
    assert kept == {i for i, (n, c) in want.items() if c == i}


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(3)
    for rule in (jj.Rule(3, 90, 100), jj.Rule(5, 8, 10)):
        lows = rule.ranges()
        for n in [*range(1, 80), 200, 1000]:
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(4):
                gone = rnd.integers(0, max(1, n // 5) + 1)
                new = rnd.integers(0, max(1, n // 5) + 1)
                b = np.unique(np.concatenate([rnd.permutation(a)[gone:], rnd.integers(0, 1 << 63, new).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and both * rule.den >= rule.num * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                    assert len(np.intersect1d(jj.keys(a, lows, rule), jj.keys(b, lows, rule)))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z z z z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jj.classes(docs, jj.Rule(3, 9, 10)).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert jj.classes(docs.limit(0), jj.Rule()).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert all(got[x] == top(x) for p in pairs if p[0] != p[1] for x in p)


def test_keys_leave_a_batch_once():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 50):
        flat, own = rnd.integers(0, 20, n).astype(np.uint64), rnd.integers(-9, 9, n)
        keys, nodes = jj.near_by(flat, own)
        known = np.isin(keys, flat)
        assert sorted(keys[known].tolist()) == sorted(set(flat.tolist()))

        def trees(pairs):
            top = {}
            for k, v in pairs:
                both = top.get(("k", k), {("k", k)}) | top.get(("v", v), {("v", v)})
                for x in both:
                    top[x] = both
            return {frozenset(v for t, v in group if t == "v") for group in top.values()}

        assert trees(zip(keys.tolist(), nodes.tolist())) == trees(zip(flat.tolist(), own.tolist()))


def test_many_sets_of_one_size(spark, monkeypatch):
    """A tree whose sets are all of one size is dealt over several blocks."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 10)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:20], f"x{i}", *base[20:]])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = jj.Rule(3, 80, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.classes(docs, rule).collect()}
    assert got == brute.jaccard_classes(rows, 3, 80, 100)


def test_many_rows_without_id(spark):
    rows = [(None, f"a{i} b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.classes(docs, jj.Rule(3, 8, 10)).collect()
    assert len(got) == 300 and {r.component_id for r in got} == {None}
    assert jj.one_of_each(docs, jj.Rule(3, 8, 10)).count() == 1


@pytest.mark.parametrize("name, value", [("HOT", 0), ("SMALL", 1), ("KEY_BITS", 8)])
def test_any_way_of_grouping(spark, name, value, monkeypatch):
    monkeypatch.setattr(jj, name, value)
    monkeypatch.setattr(jj, "BLOCK_SETS", 40)
    rows, rule = rows_of(9), jj.Rule(5, 8, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.classes(docs, rule).collect()}
    assert got == brute.jaccard_classes(rows, rule.words, rule.num, rule.den)


def test_shared_passages_dont_gather_sets(spark, monkeypatch):
    """Texts that hang together over common passages only are told apart before their sets are laid out for comparing."""
    rnd = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(8)]
    rows = [(d, " ".join([*[f"d{d}w{i}" for i in range(30)], *rnd.sample(passages, 3)])) for d in range(300)]
    rows += [(1000 + d, rows[d][1] + " more") for d in range(5)]
    compared, written = [], jj.common.written

    def counted(df, name):
        out = written(df, name)
        if name == "join-member-sets":
            compared.append(out.count())
        return out

    monkeypatch.setattr(jj.common, "written", counted)
    rule = jj.Rule(5, 8, 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.classes(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()}
    assert got == brute.jaccard_classes(rows, rule.words, rule.num, rule.den)
    assert compared[0] <= 20
