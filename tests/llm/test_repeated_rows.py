import brute
import pytest

from matchlens.llm import repeats, window_index

DOCS = "doc_id long, text string"


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("gathered", [repeats.WINDOWS_GATHERED, 1])
def test_rows_of_one_id_and_of_none(spark, gathered, monkeypatch):
    monkeypatch.setattr(repeats, "WINDOWS_GATHERED", gathered)
    a, p, q, own, known = words("a", 60), words("p", 25), words("q", 25), words("o", 25), words("k", 30)
    rows = [
        (7, a), (7, a), (7, a),  # repeated rows keep everything
        (8, f"{p} x1 x2 x3"), (8, f"{p} y1 y2"),  # the same place in two texts of one id
        (9, f"{q} u {q}"), (9, f"{q} u {q}"),  # a repeat within a repeated row still goes
        (1, known),
        (None, f"s {q} t"), (None, f"b c {p} d"),  # without an id: after all others
        (None, f"{own} e {own}"), (None, f"{own} e {own}"), (None, f"f {own} g"), (None, f"h i {known} {own}"),  # but not after each other
        (10, f"z {known}"), (10, f"z {known} v"),
    ]
    got = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in window_index.dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect())
    want = [
        ("7", a), ("7", a), ("7", a), ("8", f"{p} x1 x2 x3"), ("8", f"{p} y1 y2"), ("9", f"{q} u"), ("9", f"{q} u"), ("1", known),
        ("None", "s t"), ("None", "b c d"), ("None", f"{own} e"), ("None", f"{own} e"), ("None", f"f {own} g"), ("None", f"h i {own}"),
        ("10", "z"), ("10", "z v"),
    ]
    assert got == sorted(want)


def test_unique_ids_are_as_before(spark):
    p = words("p", 30)
    rows = [(i, f"w{i} {p} v{i} {p}" if i % 2 else f"{p[9:]} n{i}") for i in range(40)]
    got = {r.doc_id: (r.n_tokens, r.n_removed, brute.sha(bytes(r.kept))) for r in window_index.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.word_repeats(rows)
