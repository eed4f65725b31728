import brute
import pyarrow as pa
import pytest

from matchlens.llm import common, langid


@pytest.mark.parametrize("entries", [None, 2000])
def test_equals_a_plain_scorer(spark, sf_dir, entries):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = docs.withColumn("held_out", langid.held_out()).collect()
    train = [(r.lang, r.text) for r in rows if not r.held_out and r.text is not None]
    model = langid.learn(docs.where(~langid.held_out()), entries=entries)
    some = rows if entries is None else rows[::5]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, ["doc_id"]).collect()}
    each = max(100, entries // (len(model.langs) * (langid.MAX_N + 1))) if entries else None
    for r, (lang, score) in zip(some, brute.languages(train, [r.text for r in some], each)):
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-6, r.doc_id


def test_number_signs_are_no_letters(spark):
    rows = [(i, "the cat ½ and ² the dog" if i % 2 else "der hund ² und die katze", "en" if i % 2 else "de") for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "½ ② ²"), (2, "Ⅷ ٣ _ 12"), (3, "½cat and²"), (4, "hund"), (5, "ª")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en" and got[4][0] == "de" and got[5][0] != "und"


def test_words_seen_once_are_learnt(spark):
    """The table holds every word of the sample, and a second model takes the place of a worker's first."""
    rows = [(1, "einmalig gesehen", "de"), (2, "singular vision", "en")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    other = langid.learn(spark.createDataFrame([(i, t, {"de": "en", "en": "de"}[lang]) for i, t, lang in rows], "doc_id long, text string, lang string"))
    assert {"einmalig", "gesehen", "singular", "vision"} <= set(pa.ipc.open_stream(model.terms).read_all()["term"].to_pylist())
    asked = spark.createDataFrame([(1, "einmalig"), (2, "vision")], "doc_id long, text string")
    named = lambda m: [r.lang_pred for r in langid.predict(asked, m, ["doc_id"]).orderBy("doc_id").collect()]
    assert named(model) == ["de", "en"] and named(other) == ["en", "de"]
