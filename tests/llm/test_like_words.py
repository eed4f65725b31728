"""Long unlike words whose plain polynomial hashes are equal, and one long text that repeats a benchmark phrase."""

import numpy as np
import pytest

from matchlens.llm import decontaminate, jaccard_join, vectors, window_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
V = W.translate(str.maketrans("ab", "ba"))
#: The same of blocks of eight letters, whose overlapping eights depend on one block alone.
BLOCKS = {"a": "0000000a", "b": "0000000b"}
LONG_W, LONG_V = ("".join(BLOCKS[x] for x in w) + "0000000" for w in (W, V))


def land(spark, texts, where):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_span_hashes():
    for text in (W, V):
        assert vectors.span_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([1024]))[0]
    both = np.frombuffer((W + V).encode(), np.uint8)
    for n in (1, 3, 7, 8, 9, 64, 512, 1024):
        h = vectors.span_hashes(both, np.array([0, 1024]), np.array([n, 1024 + n]))
        assert h[0] != h[1]
        again = vectors.span_hashes(both[1024 : 1024 + n], np.array([0]), np.array([n]))
        assert again[0] == h[1]
    tokens = vectors.mix(both.astype(np.uint64))
    h = vectors.token_span_hashes(tokens, np.array([0, 1024, 1]), np.array([1024, 2048, 2]))
    assert h[0] != h[1] and h[2] == vectors.token_span_hashes(tokens[1:2], np.array([0]), np.array([1]))[0]


def test_word_hashes():
    both = np.frombuffer((LONG_W + LONG_V + "short" + "y" * 64).encode(), np.uint8)
    n = len(LONG_W)
    starts, ends = np.array([0, n, 2 * n, 2 * n + 5]), np.array([n, 2 * n, 2 * n + 5, len(both)])
    one, two = (vectors.word_hashes(both, starts, ends, seed) for seed in (41, 51))
    assert one[0] != one[1] and two[0] != two[1] and not set(one.tolist()) & set(two.tolist())
    assert one[2:].tolist() == vectors.span_hashes(both, starts[2:], ends[2:], 41).tolist()
    assert one[1] == vectors.word_hashes(both[n:], np.array([0]), np.array([n]), 41)[0]


@pytest.mark.parametrize(("W", "V"), [(W, V), (LONG_W, LONG_V)], ids=["letters", "blocks"])
def test_jaccard_and_windows(spark, tmp_path, W, V):
    d = land(spark, [f"x1 x2 {W} x3 x4", f"x1 x2 {V} x3 x4"], tmp_path / "a")
    assert sorted(r.component_id for r in jaccard_join.op10_jaccard_join(spark, d).collect()) == [0, 1]
    words = lambda w: " ".join([f"w{i}" for i in range(10)] + [w] + [f"w{i}" for i in range(10, 25)])
    d = land(spark, [words(W), words(V), words(V)], tmp_path / "b")
    assert [r.n_removed for r in sorted(window_index.op9_window_index(spark, d).collect())] == [0, 0, 26]


@pytest.mark.parametrize("times", [8000])
def test_repeated_phrase(spark, times):
    phrase = "one two three four five six seven eight nine "
    docs = spark.createDataFrame([(1, phrase * times), (2, "nothing of the kind here " * 5)], "doc_id long, text string")
    items = spark.createDataFrame([(7, phrase * 3)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7, 12, 12)]
