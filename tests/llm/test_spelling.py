"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from matchlens.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    out = {}
    for w, n in counts.items():
        close = [(m, v) for v, m in counts.items() if one_edit(w, v)]
        m, form = min(((-m, v) for m, v in close), default=(0, None))
        form = form if form and -m >= 5 * n else None
        out[w] = [form, n, len(close), -m if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return sorted((w, *v) for w, v in out.items())


def made(seed, n=900, letters="abé"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(n)}
    return {w: int(5 * 7 ** (4 * r.random() ** 3)) for w in words}


def key(rows):
    return sorted((tuple(r) for r in rows))


@pytest.mark.parametrize("crowd", [4000, 5])
def test_all_pairs(spark, crowd):
    counts = made(crowd) | {"x" * 3000: 900, "x" * 3001: 5, "x" * 1500 + "y" + "x" * 1499: 6, "xxxxxx": 50, "yxxxxx": 7, "xxxxxxy": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert key(spelling.variants(words, crowd).collect()) == plain(counts)


def test_machine_alone():
    for seed in range(30):
        counts = made(seed, 60, "ab")
        for size in (6, 7, 8):
            words = [(w, n) for w, n in counts.items() if len(w) in (size, size + 1)]
            got = {w: k for w, k, _, _ in spelling.near_words(words, size, 0, size)}
            for w, _ in words:
                assert got.get(w, 0) == sum(one_edit(w, v) and min(len(w), len(v)) == size for v, _ in words)


TEXTS = [(i, f"Hello{'x' * (i % 3)} WORLDLY naïveté ÀÉcole{i % 4} colour's colours, Coloürs × {'letters ' * (i % 9)}") for i in range(400)]
ODD = [(None, "letters letters"), (5, None), (6, ""), (7, "1234 !!"), (8, "z" * 100_000)]


def counted(rows):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if x.isascii() else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def test_query(spark, tmp_path):
    rows = TEXTS + ODD
    spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, word string").write.parquet(str(tmp_path / "documents.parquet"))
    assert key(spelling.op13_spelling(spark, str(tmp_path)).collect()) == plain(counted(rows))
    assert len(counted(rows)) > 5
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert spelling.op13_spelling(spark, str(tmp_path / "none")).collect() == []
