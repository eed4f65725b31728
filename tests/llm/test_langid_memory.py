"""A worker's scorer keeps its terms in arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa

from matchlens.llm import langid


def model_of(words):
    table = pa.table({"n": pa.array([0] * len(words), pa.int32()), "term": words, "lang": ["aa" if i % 2 else "bb" for i in range(len(words))], "c": pa.array(range(1, len(words) + 1), pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return langid.Model(["aa", "bb"], np.array([[[10.0, 5.0], [10.0, 5.0]]]), sink.getvalue().to_pybytes(), "m")


def held(words):
    model = model_of(words)
    tracemalloc.start()
    scorer = langid.Scorer(model)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return size, scorer


def test_a_term_takes_few_bytes():
    words = [f"wordé{i}" for i in range(50_000)]
    few, many = held(words[:1])[0], held(words)[0]
    # two scores of 8 bytes, the term, and its place
    assert (many - few) / len(words) < 80


def test_terms_are_found_and_others_are_not():
    words = [f"wordé{i}" for i in range(1000)]
    scorer = held(words)[1]
    assert [scorer.tables[0].get(w) for w in words] == list(range(1000))
    assert scorer.tables[0].get("wordé") is None and scorer.tables[0].get("") is None
    assert len(langid.Terms(pa.array([], pa.string()), 0)) == 0 and langid.Terms(pa.array([], pa.string()), 0).get("a") is None
    part = langid.Terms(pa.array(words).slice(10, 5), 7)
    assert part.get(words[12]) == 9 and part.get(words[9]) is None
    # another string under the same hash
    part.data = part.data.replace(words[12].encode(), b"x" * len(words[12].encode()))
    assert part.get(words[12]) is None
