from matchlens.llm import jaccard_join


def test_only_copies_without_an_id_go(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [
        (1, words("a"), "s"), (2, words("a") + " z", "s"), (3, words("c"), "s"), (3, words("c"), "s"),
        (None, words("a") + " y", "s"),  # a near copy of 1
        (None, words("b"), "s"),  # like nothing
        (None, words("d"), "s"), (None, words("d"), "t"), (None, words("d") + " x", "s"),  # of each other
        (None, "", "s"), (None, None, "s"), (None, " ", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    rule = jaccard_join.Rule(words=5, num=8, den=10)
    kept = [tuple(r) for r in jaccard_join.one_of_each(docs, rule).collect()]
    third = [r for r in kept if r[0] is None and r[1] and "d0" in r[1]]
    assert len(third) == 1 and third[0] in rows
    rest = sorted(map(str, (r for r in kept if r != third[0])))
    assert rest == sorted(map(str, [(1, words("a"), "s"), (3, words("c"), "s"), (3, words("c"), "s"), (None, words("b"), "s"), (None, "", "s"), (None, None, "s"), (None, " ", "s")]))
