import random
import zlib

import brute
import numpy as np
import pytest

from matchlens.llm import chat, common, decontaminate, langid, mixing, pii, simhash, token_store
from pyspark.sql import functions as F


def test_decontamination_equals_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([5, 8, 9, 10, 11, 12, 13, 20, 40])] + [(90, None), (91, "")]
    docs = []
    for i in range(120):
        item = (items[i % 9][1]).split()
        edited = [rnd.choice(words) if rnd.random() < 0.15 else w for w in item]
        docs.append((i, " ".join([rnd.choice(words) for _ in range(rnd.randint(0, 9))] + edited + ["End,", "x"])))
    docs += [(900, None), (901, ""), (None, items[8][1]), (902, items[8][1].upper().replace(" ", ", "))]
    d = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, item_id int, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == brute.contaminated(docs, items)
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, sf_dir, monkeypatch):
    want = {tuple(r) for r in decontaminate.op1_decontaminate(spark, sf_dir).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontaminate.op1_decontaminate(spark, sf_dir).collect()} == want


def test_token_store_round_trip(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(5)
    alphabet = list("ab cdé' \n\t\r\x0b\x1c\x85\xa0.,!'sllre²ßŐ_10") + ["<|endoftext|>", "漢", "😀", " 's", "  ", "᠎", "　"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 5000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "again"), (6, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 9, "f") for r in rows], "doc_id long, text string, copy int, file string").repartition(3)
    entries, index = token_store.store(docs, path)
    got = token_store.digests(entries, index).orderBy("start").collect()
    at = 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for r, (i, t) in zip(got, want):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    unknown = spark.range(10_000, 10_200).select(F.col("id").alias("doc_id"), F.lit(0).alias("copy"))
    assert token_store.lookup(unknown, index).count() == 0
    empty, none = token_store.store(docs.limit(0), path)
    assert token_store.digests(empty, none).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 17, 500, 2500])
def test_perfect_hash(m):
    h = np.random.default_rng(m).integers(0, 1 << 63, m).astype(np.uint64)
    shift, place = token_store.build_hash(h)
    assert sorted(place) == list(range(m))
    assert (token_store.places(h, shift, m) == place).all()


def test_perfect_hash_with_equal_hashes():
    h, h2 = np.array([7, 7, 3, 7], np.uint64), np.array([1, 2, 2, 9], np.uint64)
    shift, place = token_store.build_hash(h, h2)
    assert sorted(place) == [0, 1, 2, 3] and (token_store.places(h, shift, 4, h2) == place).all()
    with pytest.raises(ValueError):
        token_store.build_hash(h, np.array([1, 1, 2, 9], np.uint64))


def test_pii_base_spans(spark):
    rnd = random.Random(3)
    parts = ["1", "22", "256", "4", "+1", " ", "-", ".", "@", "a.b", "_", "x", "(", ")", "é", "😀", "4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4", "a@b.c", "  ", "+49 (30) 1234567", "\n", ""]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(600)]
    rows += [(9001, None), (9002, ""), (9003, "a" * 50_000), (9004, "1" * 50_000), (9005, "1 " * 30_000), (9006, "1.2 " * 3_000), (9007, "a@" + "b." * 30_000), (9008, "+1" * 9_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, email string, kind int").repartition(4)
    found = {r.doc_id: r for r in pii.spans(docs).collect()}
    for i, t in rows:
        base = [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in found[i]["base"]]
        assert base == brute.pii(t), t[:200]
        assert set(map(tuple, found[i]["base"])) <= set(map(tuple, found[i]["spans"]))
    assert pii.spans(docs.limit(0)).count() == 0


def test_pii_reliabilities(spark):
    """Expectation-maximisation finds the labelers' accuracies that made the votes."""
    rnd, truth = random.Random(2), [0.95, 0.9, 0.6, 0.8, 0.7, 0.75]
    rows = []
    for _ in range(4000):
        real = rnd.random() < 0.4
        rows.append((0, [0 if rnd.random() < 0.2 else (1 if (rnd.random() < a) == real else -1) for a in truth], "base|1|edge", 1.0))
    votes = spark.createDataFrame(rows, "kind int, votes array<int>, form string, c double").groupBy("kind", "votes", "form").agg(F.sum("c").alias("c"))
    prior, accuracy = pii.reliabilities(votes)[0]
    assert abs(prior - 0.4) < 0.05 and all(abs(a - b) < 0.06 for a, b in zip(accuracy, truth))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>", "<|block|>user<|says|>", "\\", "\\\\<|next|>", "<\\|end|>", "plain\n", "", None, "<|learn|>x<|/learn|>", "[/INST", "<<SYS>> </SYS>", "é😀"]
    rnd = random.Random(1)
    rows = [(c, k, rnd.choice(["user", "assistant", "system", None, "a<|says|>b"]), rnd.choice(texts)) for c in range(80) for k in range(rnd.randint(1, 9))]
    rows += [(900, 1, "user", "tie b"), (900, 1, "user", "tie a"), (900, 1, "user", "tie a"), (None, 0, "assistant", "nobody")]
    out = chat.format_conversations(spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, blocks int"))
    back = {r.conv_id: r for r in out.select("conv_id", "loss_runs", "formatted", "n_blocks", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted")).alias("loss")).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        r = back[c]
        assert [tuple(t) for t in r.turns] == [t[1:] for t in turns]
        assert r.loss == "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.n_blocks == sum(i == 0 or turns[i][1] != turns[i - 1][1] for i in range(len(turns)))
        assert sum(r.loss_runs) == len(r.formatted)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 80))), rnd.choice(["a", "a", "a", "b", "c", None, "Z"])) for i in range(3000)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "x", "only"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, times int, s int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(brute.words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= over
    taken = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 160 for s in order)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.repeats for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_simhash_edits_and_likeness(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 200)))) for i in range(60)] + [(100, None), (101, ""), (102, "one"), (103, "é" * 9)]
    texts, keys = simhash.edited(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, a int, head string"))
    order = sorted(rows, reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        want[i] = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
    assert {r.doc_id: r.edited for r in texts.join(keys, ["a", "b"]).collect()} == want
    fps = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    fp = {r.doc_id: r.fp for r in fps.collect()}
    # against a direct count of the votes
    for i in (0, 1, 102, 100):
        w = (dict(rows)[i] or "").split()
        terms = [" ".join(p) for p in zip(w, w[1:])] if len(w) != 1 else w
        hashes = spark.createDataFrame([(t,) for t in terms], "t string").select(*[F.xxhash64(F.lit(k), "t") for k in range(2)]).collect() if terms else []
        for k in range(2):
            bits = sum(1 << b for b in range(64) if 2 * sum((h[k] >> b) & 1 for h in hashes) > len(hashes))
            assert fp[i][k] & (2**64 - 1) == bits


def test_simhash_search_equals_all_pairs(spark):
    rnd = random.Random(2)
    fp = [tuple(rnd.getrandbits(63) for _ in range(2)) for _ in range(40)]
    fp += [(a ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 4))), b ^ (1 << rnd.randrange(60))) for a, b in fp for _ in range(3)]
    f = spark.createDataFrame([(list(x),) for x in fp], "fp array<long>")
    got = {(tuple(r.query_fp), tuple(r.fp)) for r in simhash.within_radius(f, f, 4).collect()}
    assert got == {(x, y) for x in set(fp) for y in set(fp) if sum(bin(p ^ q).count("1") for p, q in zip(x, y)) <= 4}


def test_language_held_out_accuracy(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = langid.op8_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    train = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, lang string, n int, score string")
    model = langid.learn(train)
    texts = [(1, None), (2, ""), (3, "123 ... !"), (4, "und der hunde"), (5, "cats and the"), (6, "x " * 100_000), (None, "the dog")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "de", "en", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.learn(train.limit(0))
    assert {r.lang_pred for r in langid.predict(train, nothing, ["doc_id"]).collect()} == {"und"}
