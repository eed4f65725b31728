"""Stateful streaming deduplication against a plain one."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from matchlens.llm import common, stream_dedup

SCHEMA = "doc_id long, text string, lang string, digest string"


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, text))
    return sorted(out, key=str)


def land(spark, rows, where, mode="append"):
    spark.createDataFrame([(i, t, "en", "x") for i, t in rows], SCHEMA).repartition(3).write.mode(mode).parquet(where)


def stream(spark, where, files=1000):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(where)


BATCHES = [
    [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 1"), (None, "alone"), (None, "alone"), (50, None), (51, "")],
    [(100 + i, f"text {i % 9}") for i in range(40)] + [(3, "text 3"), (3, "text 3"), (139, "text 3"), (139, "text 3"), (60, "é" * 400_000)],
    [(1, "text 8"), (200, "é" * 400_000), (201, "é" * 399_999 + "e"), (None, "")],
]


@pytest.mark.parametrize("weak", [False, True])
def test_batches_equal_plain(spark, tmp_path, weak):
    # weak: a digest that most texts share
    digest = (lambda text: b"same" if len(text) % 3 else b"other") if weak else stream_dedup.sha256
    where, source = common.scratch(spark, "test-dedup"), str(tmp_path / "in")
    seen = []
    for batch in BATCHES:
        land(spark, batch, source)
        seen += batch
        stream_dedup.advance(stream(spark, source, 2), where, digest)
        got = stream_dedup.result(spark, where).collect()
        expected = plain(seen)
        assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((e[:4] for e in expected), key=str)
        assert {bytes(r.digest) for r in got} == {digest(e[4].encode()) for e in expected}


def test_merge_and_contents(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(stream_dedup, "CACHE_BYTES", 3000)
    monkeypatch.setattr(stream_dedup, "SENT_IDS", 4)
    rows = [(i, "hot" if i % 2 else f"cold {i % 16}") for i in range(400)] + [(None, None)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows[a : a + 50]], "text": [r[1] for r in rows[a : a + 50]]}) for a in range(0, len(rows), 50)]
    out = [r for b in stream_dedup.merge_copies(iter(batches), stream_dedup.sha256) for r in b.to_pylist()]
    assert sorted(((i, r["text"].decode()) for r in out for i in r["ids"]), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert len(out) < 120 and all(r["digest"] == hashlib.sha256(r["text"]).digest() for r in out)

    monkeypatch.setattr(stream_dedup, "FILE_BYTES", 300)
    store = stream_dedup.Contents("file://" + str(tmp_path / "c"))
    texts = [bytes([i]) * (i * 50) for i in range(30)]
    places = [store.put(t) for t in texts]
    assert [store.get(*p) for p in places] == texts and len({p[0] for p in places}) > 1
    store.flush()
    assert [stream_dedup.Contents("file://" + str(tmp_path / "c")).get(*p) for p in places] == texts


def test_query_and_sql(spark, sf_dir, tmp_path):
    got = sorted(map(tuple, stream_dedup.op12_stream_dedup(spark, sf_dir).collect()))
    assert got == sorted(duckdb.sql(stream_dedup.ORACLE.replace("from documents", f"from '{sf_dir}/documents.parquet'")).fetchall())
    land(spark, [], str(tmp_path / "documents.parquet"))
    assert stream_dedup.op12_stream_dedup(spark, str(tmp_path)).collect() == []
