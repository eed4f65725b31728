"""The Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest

from matchlens.llm import manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = None if n_chars is None else n_chars + more
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def up(nodes, k):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
    return levels


def way(levels, at, k):
    """(siblings by level, own slot) from a node to the top."""
    out = []
    for level in levels[:-1]:
        run = level[at - at % k : at - at % k + k]
        out.append((run, at % k))
        at //= k
    return out


def plain(rows, k=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, up([leaf(r) for r in own], k)
    top = up([trees[lang][1][-1][0] for lang in langs], k)
    out = []
    for i, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            path = way(levels, at, k) + way(top, i, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf(r, 1) if hit else leaf(r)
            for run, slot in path:
                x = H(run[:slot] + [x] + run[slot + 1 :])
            proof = H(s for run, slot in path for j, s in enumerate(run) if j != slot)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return sorted(out, key=str)


ROWS = [(i, ["web", None, "book"][i % 3], [None, "en", "de", "fr"][min(3, i % 7)], None if i % 11 == 0 else i, f"text {i}" * (i % 4)) for i in range(230)]
ODD = [(None, None, None, None, None), (None, "a", "en", 3, ""), (7, "a", "en", 3, "x"), (7, "a", "en", 3, "x"), (7, "a", "en", 3, "y"), (900, "é", "zz", 1, "ü" * 300_000)]


def run(spark, rows, monkeypatch, tmp_path, extra=False):
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        df = df.selectExpr("*", "1 as tree", "2 as pos", "3 as size", "'x' as leaf", "4 as block")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in manifest.op11_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("block", [4, 2048])
def test_equals_plain(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(manifest, "BLOCK", block)
    assert run(spark, ROWS + ODD, monkeypatch, tmp_path, extra=True) == plain(ROWS + ODD)


def test_one_language_one_row_none(spark, monkeypatch, tmp_path):
    for i, rows in enumerate(([(5, "s", "en", 1, "t")], [r for r in ROWS if r[2] == "de"], [])):
        assert run(spark, rows, monkeypatch, tmp_path / str(i)) == (plain(rows) if rows else [])


def test_other_arity(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 30)
    rows = ROWS + ODD
    df = spark.createDataFrame(rows, COLUMNS)
    c = {n: df[n] for n in df.columns}
    m = manifest.build(df.select("doc_id", "lang", manifest.leaf_digest(**c).alias("leaf")), arity=5)
    folded = manifest.fold(m, m.leaves, "leaf", ["doc_id", "leaf"]).collect()
    expected = plain(rows, 5)
    assert {m.root} == {e[3] for e in expected} and all(r.folded_root == m.root for r in folded)
    assert sorted((str(r.doc_id), r.leaf, H([r.proof])) for r in folded) == sorted((str(e[0]), e[1], e[4]) for e in expected)
    # every parent's digest is that of its children
    for p in m.parents.collect():
        assert p.digest.hex() == H(c.hex() for c in p.children) and len(p.states) == len(p.children)
