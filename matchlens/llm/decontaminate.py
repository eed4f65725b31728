"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive tokens that ignores some positions: `(0, 1, 2, 4, 5)` hashes the first, second, third,
fifth and sixth token from a position and lets the fourth be anything. Masked hashes of all documents are
joined with those of all benchmark items; every hit names a diagonal (document position minus item position), and
around it the tokens are compared one by one. A document is contaminated by an item if, on some diagonal, `WINDOW` item
tokens in a row agree with the document in at least `AGREE` of the positions (items with fewer tokens, down to
`MIN_ITEM`: all of the item's tokens in a row). The masks are complete for this: any window of twelve with up to two
substitutions, and any window of 8 to 11 with up to floor(n * 0.2), contains a masked run without a substitution for at least one of them, so
the joined hits lose nothing against comparing all pairs (tests do that).

Tokens are maximal runs of letters and digits, lower-cased; five of them in a mask and an agreement of 0.8.

Edge cases: null and empty texts and items have no tokens and match nothing; so do items shorter than `MIN_ITEM` tokens; a
null doc_id is kept as it is; rows with one id but different texts are judged apart and reported once; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, AGREE, MIN_ITEM = 12, 0.8, 8
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
#: Needed besides, for items of MIN_ITEM to WINDOW - 1 tokens.
SHORT_MASKS = ((0, 1, 3, 6, 7),)
#: Rows up to which the benchmark's seeds, and the documents that were hit, are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seeds(hashes: Column, masks) -> Column:
    """array<long> of token hashes -> array of (mask, pos, seed) for every mask and position where it fits."""

    def of(k, mask):
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - mask[-1], F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(F.lit(k), h, *[F.get(hashes, i + o) for o in mask[1:]]))

    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def seed_rows(hashed: DataFrame, keys: list[str], masks) -> DataFrame:
    """One row a seed: the keys, pos, seed. Only the seeds themselves are exploded, not the token arrays."""
    n = F.size("hashes")
    out = hashed.select(*keys, n.alias("n_tok"), F.posexplode(seeds(F.col("hashes"), masks)).alias("at", "seed"))
    before, pos = F.lit(0), None
    for mask in masks:
        fits = F.greatest(F.col("n_tok") - mask[-1], F.lit(0))
        own = F.col("at") - before
        pos = F.when(own < fits, own) if pos is None else pos.when(own < fits, own)
        before = before + fits
    return out.select(*keys, pos.alias("pos"), "seed")


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """doc_id, item_id, matched (most agreeing tokens in a window), window: one row a contaminated pair."""
    hashed_items = common.written(
        items.select("item_id", token_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") >= MIN_ITEM), "decon-items"
    )
    short = hashed_items.where(F.size("hashes") < window).limit(1).count() > 0
    masks = MASKS + SHORT_MASKS if short else MASKS
    item_seeds = seed_rows(hashed_items.withColumn("n_item", F.size("hashes")), ["item_id", "n_item"], masks).withColumnRenamed("pos", "item_pos")
    n_seeds = item_seeds.count()

    base = docs.select("doc_id", F.xxhash64(common.text_of()).alias("th"), "text")
    doc_seeds = seed_rows(base.select("doc_id", "th", token_hashes(F.col("text")).alias("hashes")), ["doc_id", "th"], masks)
    hits = common.written(
        doc_seeds.join(sized_broadcast(item_seeds, n_seeds), "seed")
        .select("doc_id", "th", "item_id", "n_item", (F.col("pos") - F.col("item_pos")).alias("diag")).distinct()
        .groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "n_item", "diag")).alias("hits")), "decon-hits",
    )
    joined = base.join(
        sized_broadcast(hits.withColumnsRenamed({"doc_id": "d", "th": "t"}), hits.count()), F.expr("doc_id <=> d and th = t")
    ).select("doc_id", "hits", token_hashes(F.col("text")).alias("hashes"))
    # a text is cut to the item's length at each diagonal before it goes anywhere, so rows are as long as items
    part = lambda h: F.slice("hashes", F.greatest(h.diag, F.lit(0)) + 1, h.n_item)
    cut = joined.select("doc_id", F.explode(F.transform("hits", lambda h: F.struct(h.item_id.alias("item_id"), F.least(h.diag, F.lit(0)).alias("shift"), part(h).alias("part")))).alias("hit"))
    laid = cut.select("doc_id", "hit.*").join(sized_broadcast(hashed_items.withColumnsRenamed({"item_id": "i", "hashes": "item"}), n_seeds), F.expr("item_id <=> i"))
    at = lambda j: j + F.col("shift")
    same = F.transform("item", lambda h, j: F.coalesce((F.get("part", F.when(at(j) >= 0, at(j))) == h).cast("int"), F.lit(0)))
    w = F.least(F.lit(window), F.size("same"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - w + 1), lambda s: F.aggregate(F.slice("same", s, w), F.lit(0), lambda a, x: a + x))
    scored = laid.select("doc_id", "item_id", same.alias("same")).select("doc_id", "item_id", w.alias("window"), F.array_max(sums).alias("matched"))
    return (
        scored.where(F.col("matched") >= F.ceil(F.col("window") * F.lit(agree)))
        .groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones (documents without an id are judged as one)."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, F.expr("doc_id <=> __bad_id"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


assert math.ceil(WINDOW * AGREE) == WINDOW - 2

ORACLE = r"""
with d as (select doc_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from documents),
b as (select item_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] as w from benchmark),
dt as (select doc_id, unnest(w) as tok, generate_subscripts(w, 1) as pos from d),
bt as (select item_id, len(w) as n, unnest(w) as tok, generate_subscripts(w, 1) as pos from b where len(w) >= 8),
m as (select doc_id, item_id, n, dt.pos - bt.pos as diag, bt.pos as ipos from dt join bt using (tok)),
g as (select doc_id, item_id, n, diag, list(ipos) as hit, least(n, 12) as win from m group by all
      having count(*) >= ceil(least(n, 12) * 0.8)),
s as (select doc_id, item_id, win, len([p for p in hit if p >= s0 and p < s0 + win]) as matched
      from (select *, unnest(generate_series(1, n - win + 1)) as s0 from g))
select doc_id, item_id, max(matched) as matched, max(win) as "window" from s
where matched >= ceil(win * 0.8) group by doc_id, item_id
"""
