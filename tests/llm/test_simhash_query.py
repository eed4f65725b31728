from matchlens.llm import common, simhash


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    fp = {i: int(r.fingerprint, 16) for i, r in got.items()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        assert got[i].n_chars == len(docs[i])
        assert abs(got[i].near_next - (1 - bin(fp[i] ^ fp[order[(k + 1) % len(order)]]).count("1") / simhash.BITS)) < 1e-9
        near = {f for f in fp.values() if 0 < bin(f ^ fp[i]).count("1") <= simhash.RADIUS}
        assert got[i].n_within == (len(near) if i % simhash.QUERY_EVERY == 0 else None)


def test_each_repeated_row_is_returned(spark, tmp_path):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c"), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op6_simhash(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None", "None"]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
