import brute

import corpus_pipeline as cp
from matchlens.llm import common


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = common.written(cp.by_language(spark, docs, sf_dir), "t")
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    one = common.written(cp.one_of_each(spark, kept, sf_dir), "t")
    classes = brute.jaccard_classes([(r.doc_id, r.text) for r in kept.collect()], 5, 8, 10)
    assert {r.doc_id for r in one.collect()} == {i for i, (n, c) in classes.items() if c == i}
    clean = common.written(cp.without_benchmark(spark, one, sf_dir), "t")
    bad = {i for i, _ in brute.contaminated([(r.doc_id, r.text) for r in one.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    mix = common.written(cp.mixed(spark, clean, sf_dir), "t")
    assert mix.columns == docs.columns
    out = cp.tokens(spark, mix, sf_dir)
    assert out.count() == mix.count()


def test_edges(spark, sf_dir):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [
        (1, long, "en", "a", 5, 1), (2, long + "more", None, None, None, 2), (3, None, "en", "a", 0, 3), (4, "", None, "a", 0, 4), (5, "123 !?", "de", "b", 6, 5),
        (None, "ein kurzer satz und noch ein wort", "de", "b", 9, 6), (6, "x " * 60_000, "en", "c", 1, 7), (7, "zwei gleiche zeilen hier", "de", "b", 1, 8), (7, "zwei gleiche zeilen hier", "de", "b", 1, 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred long")
    kept = common.written(cp.by_language(spark, docs, sf_dir), "t")
    assert kept.columns == cp.COLUMNS and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "7", "7", "None"]
    one = common.written(cp.one_of_each(spark, docs, sf_dir), "t")
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "4", "5", "6", "7", "7", "None"]
    assert cp.without_benchmark(spark, docs, sf_dir).count() == len(rows)
    assert cp.mixed(spark, docs, sf_dir).columns == cp.COLUMNS
    assert cp.tokens(spark, docs, sf_dir).count() == len(rows)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
