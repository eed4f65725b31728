import time

import brute

from matchlens.llm import common, pii


def test_query_equals_a_plain_version(spark, sf_dir):
    got = {r.doc_id: r for r in pii.op3_pii(spark, sf_dir).collect()}
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        base = brute.pii(r.text)
        joined = [":".join(map(str, x)) for x in base]
        mine = got[r.doc_id]
        assert [mine[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert mine.base_sha256 == brute.sha(",".join(joined).encode())
        assert set(joined) <= set(filter(None, mine.spans.split(",")))


def test_added_spans(spark):
    """What the base patterns swallow or don't know is added at its own place; number signs without a sign of a kind are not."""
    rows = [(i, f"contact me: joe{i}@example.com or call +1 (555) 555-{1000 + i} now, from host 10.0.0.{i % 200}, card 4111 1111 1111 1111") for i in range(300)]
    rows += [(1000 + i, f"number 98079157{i:08d} in a row, version 1.2.3.{400 + i}") for i in range(100)]
    rows += [
        (2001, "é call +1 (826) 555-4081 190.137.223.204 du"), (2002, "write to mary [at] example [dot] org please"), (2003, "visa card 4111 1111 1111 1111 2222 2222"),
        (2004, "nothing 7536784127813050 4845168114407329 here"),
    ]
    got = {r.doc_id: [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in r.spans] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    named = lambda i: {(k, text[i][a:b]) for k, a, b in got[i]}
    assert named(2001) == {("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")}
    assert named(2002) == {("email", "mary [at] example [dot] org")}
    assert named(2003) == {("card", "4111 1111 1111 1111")}
    assert named(2004) == set()
    assert all(got[1000 + i] == brute.pii(text[1000 + i]) for i in range(100))


def test_many_hits_in_one_text(spark):
    text = "a@b.c, " * 100_000
    began = time.time()
    found = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(found.base) == 100_000 and found.base[99_999]["end"] == len(text) - 2
    assert time.time() - began < 60
