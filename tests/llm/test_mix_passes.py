import pytest

from matchlens.llm import mixing


@pytest.mark.parametrize("few", [100_000, 0])
def test_no_document_more_than_twice(spark, few, monkeypatch):
    """Source b's target is exactly twice its size: each of its documents, the empty ones too, is taken twice and not a third time."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rows = [(i, "w " * 50, "a") for i in range(40)] + [(100 + i, "w w", "b") for i in range(5)] + [(200, "", "b"), (201, None, "b"), (202, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 1, 1)).collect()}
    assert {got[i].repeats for i in (100, 104, 200, 201)} == {2} and got[100].target == 20
    assert mixing.mixed_rows(docs, weights=(1, 1, 1)).where("source = 'b'").count() == 14
