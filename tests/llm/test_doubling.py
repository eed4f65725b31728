import doubling

from matchlens.llm import common, suffix_dedup


def kept(text, places, width=50):
    """What remains of a text's bytes, from the places where removed strings start."""
    gone = {p + i for p in places for i in range(width)}
    return bytes(c for i, c in enumerate((text or "").encode()) if i not in gone)


def test_equals_doubling_over_all_places(spark, sf_dir):
    """Whole supplied table, and texts that repeat parts of each other: the same bytes go as by ranks that double from single bytes on."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = ["é" * 40, "abc" * 30, "the same passage, longer than fifty bytes, in several texts"]
    more = [(100_000 + i, f"{i} " + "".join(parts[j] for j in range(3) if i >> j & 1)) for i in range(8)]
    docs = common.written(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")), "t")
    places = {}
    for r in doubling.windows(docs).where("first < doc").collect():
        places.setdefault(r.doc, []).append(r.pos)
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect()}
    assert any(n for n, _ in got.values())
    want = {r.doc_id: kept(r.text, places.get(r.doc_id, [])) for r in docs.collect()}
    assert {d: k for d, (_, k) in got.items()} == want
