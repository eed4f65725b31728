import numpy as np
import pytest

from matchlens.llm import vectors


def direct(values, w):
    return [s + min(range(w), key=lambda i: (int(values[s + i]) >> 24, i)) for s in range(len(values) - w + 1)]


@pytest.mark.parametrize("n", [0, 6, 7, 32, 33, 63, 64, 65, 400])
def test_slices_equal_the_whole(n, monkeypatch):
    values = np.random.default_rng(n).integers(0, 40, n).astype(np.uint64) << np.uint64(24)  # many ties
    monkeypatch.setattr(vectors, "PLACES", 32)
    assert vectors.sliding_argmin(values, 7).tolist() == direct(values, 7)


def test_more_places_than_24_bits():
    n, w = (1 << 24) + 100, 27
    values = vectors.mix(np.arange(n, dtype=np.uint64), 3)
    got = vectors.sliding_argmin(values, w)
    assert len(got) == n - w + 1
    tail = n - 300
    assert (got[tail:] - tail).tolist() == direct(values[tail:], w)
