"""Personal data by weak supervision.

Candidates. Per kind the base pattern and looser ones give spans (code points, end exclusive). A base match that passes its
check (octets, Luhn sum, digit count) is always reported; base matches that fail it and loose matches are open
candidates: addresses in words, number groups of the usual form that a longer base match has swallowed.

Labelers. Each candidate gets votes of +1, 0 (abstains) or -1 from: the strict pattern with its check, a shape test, a
gazetteer (top-level domains, card issuers' prefixes, calling codes), words for and words against the kind around it, and a
test for placeholders.

Aggregation. Votes are counted by pattern in one aggregation; expectation-maximisation on that table (its size is bounded by
the number of vote patterns, not by the data) estimates each labeler's accuracy and each kind's share of real spans.
The posteriors are the training labels of the final span classifier, a naive Bayes model over votes and form features, again
from one aggregation. Open candidates that it gives at least `ACCEPT` are added to the base spans.

Patterns use no nested repetition over unbounded text, so they stay linear and need no deep stack on very long runs:
what could only begin inside a run of its own characters is ruled out by look-behind (`\\G` allows it right after a match),
and the separators of card numbers that stand between digits are told from others beforehand.

Edge cases: a null or empty text has no spans; repeated rows are reported each; equal spans of one kind are reported once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.95
ROUNDS = 15
#: Weight of the prior in the classifier, in spans.
PRIOR = 4.0
LABELERS = ("strict", "shape", "gazetteer", "for", "against", "placeholder")

# Patterns. `base`: the contract's patterns, rewritten without nested repetition.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9 -]{2,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A dot that no domain goes on after, and what stands for it in EMAIL; a card number's separator not between digits.
LONE_DOT, DOT_MARK = r"\.(?![A-Za-z0-9-])", "\uE000"
LONE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({](?:dot|DOT)[\])}]|\.) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}(?![0-9-])|(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
}
#: Cheap tests of a whole text, so that most texts are never split.
QUICK = {
    "email": r"@", "ip": r"[0-9]\.[0-9]++\.", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "loose email": r"[\[({](?:at|AT)[\])}]", "loose ip": r"(?:[0-9A-Fa-f]{1,4}:){7}", "loose phone": r"[0-9]{3}[ .-][0-9]{4}",
    "loose card": r"[0-9](?:[\x20-]?[0-9]){19}",
}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)[.\])}] ?(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|eu|uk|ch|at|us|ca|au|jp|cn|in|br)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]{0,2}\.|(?i:fe80|fd|2[0-9a-f]{3}):?)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35)",
    "phone": r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
FOR = {
    "email": r"(?:e-?mail|mail|contact|write|courriel|correo|kontakt|reach)",
    "ip": r"(?:\bip\b|address|host|server|login|adresse|direcci)",
    "card": r"(?:card|visa|master|credit|debit|payment|carte|karte|tarjeta|pan\b)",
    "phone": r"(?:phone|tel\b|tel\.|call|mobile|fax|t[ée]l[ée]|anruf|llam|whatsapp|\bsms)",
}
AGAINST = r"(?:version|release|\bisbn|\bissn|order|invoice|serial|\bsku|\bref\b|part no|\bbuild|total|ticket)"


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(OCTETS)
    n = F.length(_digits(text))
    # the sum is only taken of short strings
    return F.when(n.between(13, 19), _luhn(F.substring(_digits(text), 1, 19))).otherwise(F.lit(False)) if kind == "card" else n.between(9, 15)


def _split(text: Column, pattern: str, quick: str) -> Column:
    """struct (gap, hit) of arrays: what lies between a pattern's matches, and the matches."""
    some, none = text.rlike(quick), F.array().cast("array<string>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(F.when(some, gaps).otherwise(none).alias("gap"), F.when(some, hits).otherwise(none).alias("hit"))


def _before(x: Column) -> Column:
    """The sum of all entries before each entry of an array column. Appending copies an array, so the sums are built in blocks of about
    the root of their number, the blocks' own sums first."""
    n = F.size(x)
    step = F.greatest(F.lit(1), F.sqrt(n).cast("int"))
    blocks = F.transform(F.when(n > 0, F.sequence(F.lit(1), n, step)).otherwise(F.array().cast("array<int>")), lambda at: F.slice(x, at, step))

    def running(block, start):
        first = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(block, first, add, lambda acc: acc["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))


def _matches(parts: Column, before: Column) -> Column:
    """array of (start, end, hit, before, after) of a pattern's matches, from _split and what is before each part."""
    gaps, hits = parts["gap"], parts["hit"]
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(hits)).alias("next"), F.slice(before, 1, F.size(hits)).alias("at"))

    def one(x):
        start = x["at"] + F.length(x["gap"])
        return F.struct(
            start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(48)).alias("before"), F.left(x["next"], F.lit(24)).alias("after")
        )

    return F.transform(zipped, one)


def _candidates(kind: str, k: int, found: Column, loose: bool) -> Column:
    """Matches -> candidate structs: kind, start, end, base, votes, form."""

    def one(m):
        hit = m["hit"]
        near = F.lower(F.concat(m["before"], F.lit(" ... "), F.coalesce(m["after"], F.lit(""))))
        good = F.lit(False) if loose and kind in ("email", "ip") else _passes(kind, hit)
        digits = _digits(hit)
        vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)
        shape = {
            "email": F.length(hit).between(6, 80), "ip": F.length(hit).between(7, 39),
            "card": F.length(digits).between(13, 19), "phone": F.length(digits).between(10, 15),
        }[kind]
        votes = [
            # the strict pattern has no opinion on another spelling
            F.lit(0) if loose and kind in ("email", "ip") else vote(good), vote(shape), vote((digits if kind in ("card", "phone") else hit).rlike(GAZETTEER[kind])),
            vote(near.rlike(FOR[kind]), F.lit(False)), F.when(near.rlike(AGAINST), -1).otherwise(0),
            F.when((F.length(digits) > 6) & digits.rlike(r"^(\d)\1+$|^0?123456789|^(?:0+\.){3}0+$"), -1).otherwise(0),
        ]
        form = F.concat_ws(
            "|", F.lit("loose" if loose else "base"), F.least(F.floor(F.length(hit) / 6), F.lit(6)).cast("string"),
            F.when(m["before"].rlike(r"[\s(:,]$") | (m["before"] == ""), "edge").otherwise("inside"),
            F.when(hit.rlike(r"^\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}$"), "coded").otherwise("plain"),
        )
        return F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (F.lit(False) if loose else good).alias("base"),
            F.array(*[v.cast("int") for v in votes]).alias("votes"), form.alias("form"),
        )

    # a card-like run of other than 13 to 19 digits is a number, no candidate
    kept = F.filter(found, lambda m: F.length(_digits(m["hit"])).between(13, 19)) if kind == "card" else found
    return F.transform(kept, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, cands: one row a document, candidates of all kinds."""
    text = F.col("text")
    plain = docs.select("doc_id", common.text_of().alias("text"))
    card_text = F.when(text.rlike(QUICK["card"]), F.regexp_replace(text, LONE_SEPARATOR, "\u0001")).otherwise(F.lit(""))
    mail_text = F.when(text.rlike(QUICK["email"]), F.regexp_replace(F.translate(text, DOT_MARK, " "), LONE_DOT, DOT_MARK)).otherwise(F.lit(""))
    split = plain.select(
        "doc_id",
        _split(mail_text, EMAIL, QUICK["email"]).alias("email"), _split(text, IP, QUICK["ip"]).alias("ip"),
        _split(card_text, CARD, QUICK["card"]).alias("card"), _split(text, PHONE, QUICK["phone"]).alias("phone"),
        *[_split(text, LOOSE[kind], QUICK[f"loose {kind}"]).alias(f"loose_{kind}") for kind in LOOSE],
    )
    names = [*KINDS, *[f"loose_{kind}" for kind in LOOSE]]
    lengths = split.withColumns({f"{c}_n": F.zip_with(f"{c}.gap", f"{c}.hit", lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))) for c in names})
    placed = lengths.withColumns({f"{c}_at": _before(F.col(f"{c}_n")) for c in names})
    found = placed.select("doc_id", *[_matches(F.col(c), F.col(f"{c}_at")).alias(c) for c in names])
    parts = [_candidates(kind, k, F.col(kind), False) for k, kind in enumerate(KINDS)]
    parts += [_candidates(kind, KINDS.index(kind), F.col(f"loose_{kind}"), True) for kind in LOOSE]
    return found.select("doc_id", F.concat(*parts).alias("cands"))


def vote_table(found: DataFrame) -> DataFrame:
    """kind, votes, form, c: how often each pattern of votes and form occurs."""
    return found.select(F.explode("cands").alias("x")).groupBy("x.kind", "x.votes", "x.form").agg(F.count("*").cast("double").alias("c"))


def _posterior(params: dict) -> Column:
    """P(real | votes) of a row of the vote table."""
    out = F.lit(0.0)
    for k, (prior, accuracy) in params.items():
        odds = F.lit(math.log(prior / (1 - prior)))
        for j, a in enumerate(accuracy):
            odds = odds + F.element_at("votes", j + 1) * F.lit(math.log(a / (1 - a)))
        out = F.when(F.col("kind") == k, 1 / (1 + F.exp(-odds))).otherwise(out)
    return out


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation: kind -> (share of real spans, each labeler's accuracy when it votes)."""
    params = {k: (0.5, [0.8] * len(LABELERS)) for k in range(len(KINDS))}
    for _ in range(rounds):
        p = votes.withColumn("p", _posterior(params))
        right = [F.sum(F.when(F.element_at("votes", j + 1) == 1, F.col("p") * F.col("c")).when(F.element_at("votes", j + 1) == -1, (1 - F.col("p")) * F.col("c")).otherwise(0.0)) for j in range(len(LABELERS))]
        cast = [F.sum(F.abs(F.element_at("votes", j + 1)) * F.col("c")) for j in range(len(LABELERS))]
        rows = p.groupBy("kind").agg(F.sum("c").alias("n"), F.sum(F.col("p") * F.col("c")).alias("real"), F.array(*right).alias("right"), F.array(*cast).alias("cast")).collect()
        # smoothed by 4 right of 5, so that no labeler is ever taken for infallible
        params |= {r["kind"]: ((r["real"] + 1) / (r["n"] + 2), [min(0.99, max(0.05, (a + 4) / (b + 5))) for a, b in zip(r["right"], r["cast"])]) for r in rows}
    return params


def span_classifier(votes: DataFrame, params: dict) -> dict[str, float]:
    """Naive Bayes over votes and form, trained on the posteriors: 'kind/feature/value' -> log odds ('kind' alone: the prior)."""
    p = votes.withColumn("p", _posterior(params))
    names = F.array(
        *[F.concat(F.lit(f"{name}/"), F.element_at("votes", j + 1).cast("string")) for j, name in enumerate(LABELERS)],
        *[F.concat(F.lit(f"form{i}/"), F.element_at(F.split("form", r"\|"), i + 1)) for i in range(4)],
    )
    real, not_real = F.sum(F.col("p") * F.col("c")), F.sum((1 - F.col("p")) * F.col("c"))
    per = p.select("kind", "p", "c", F.explode(names).alias("feature")).groupBy("kind", "feature").agg(real.alias("r"), not_real.alias("n"))
    all_of = {r["kind"]: (r["r"], r["n"]) for r in p.groupBy("kind").agg(real.alias("r"), not_real.alias("n")).collect()}
    model = {f"{k}": math.log((r + 1) / (n + 1)) for k, (r, n) in all_of.items()}
    for x in per.collect():
        r, n = all_of[x["kind"]]
        share = PRIOR * (x["r"] + x["n"] + 1e-9) / (r + n + 1e-9)  # smoothed towards the feature's share in all, so that rare features say little
        model[f"{x['kind']}/{x['feature']}"] = math.log((x["r"] + share) / (r + PRIOR)) - math.log((x["n"] + share) / (n + PRIOR))
    return model


def probability(x: Column, model: dict[str, float]) -> Column:
    """The classifier's probability of a candidate; it needs its kind's shape, and if made of digits a word for its kind nearby or a calling code's form."""
    if not model:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(v) for kv in sorted(model.items()) for v in kv])
    kind = x["kind"].cast("string")
    of = lambda name: F.coalesce(F.try_element_at(table, name), F.lit(0.0))
    odds = of(kind)
    for j, name in enumerate(LABELERS):
        odds = odds + of(F.concat(kind, F.lit(f"/{name}/"), F.element_at(x["votes"], j + 1).cast("string")))
    for i in range(4):
        odds = odds + of(F.concat(kind, F.lit(f"/form{i}/"), F.element_at(F.split(x["form"], r"\|"), i + 1)))
    coded = (x["kind"] == KINDS.index("phone")) & x["form"].endswith("coded")
    named = (x["kind"] == KINDS.index("email")) | coded | (F.element_at(x["votes"], LABELERS.index("for") + 1) == 1)
    shaped = F.element_at(x["votes"], LABELERS.index("shape") + 1) == 1
    return F.when(named & shaped, 1 / (1 + F.exp(-odds))).otherwise(F.lit(0.0))


def spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end), sorted; base holds the base spans alone."""
    found = common.written(candidates(docs), "pii-candidates")
    votes = common.written(vote_table(found), "pii-votes")
    model = span_classifier(votes, reliabilities(votes))
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.filter("cands", lambda x: x["base"])
    added = F.filter("cands", lambda x: ~x["base"] & (probability(x, model) >= accept))
    out = found.select("doc_id", F.array_sort(F.transform(base, place)).alias("base"), F.transform(added, place).alias("added"))
    clear = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["kind"] == b["kind"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.array_distinct(clear))).alias("spans"))


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
