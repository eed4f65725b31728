"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word target. A document's place in its source is a hash of 60 bits (of the MD5 of its id and text), so "the documents whose hash lies
under a threshold" is a uniform choice that every run repeats. The threshold is found without sorting: sum sizes
by (source, leading hash bits), find the bucket in which the budget falls, then histogram only that bucket by its next
bits, and so on down to one hash value. Per pass one row per (source, bucket) leaves each task.

Targets beyond a source's size repeat it: `floor(target / size)` whole passes for every document, and one more pass for
the documents under the threshold for what is left.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, ordered last; repeated
rows (same id and text) share one hash and so one fate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEAT = 2.0
#: Hash bits looked at in each pass; their sum is the width of the hash.
LEVELS = (10, 10, 10, 10, 10, 10)
BITS = sum(LEVELS)
#: Sources up to which their table is broadcast; beyond, it is joined as any other.
BROADCAST_SOURCES = 100_000


def place(doc_id: Column, text: Column) -> Column:
    """A document's hash in [0, 2**BITS)."""
    named = F.concat_ws("|", doc_id.cast("string"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the document's place."""
    return docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("h"))


def targets(per_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds `target` to (source, source_size), one row a source.

    Sources in code point order (null last) get the weights in turn and share `budget` times all sizes; none exceeds
    `max_repeat` times its size, and what it would have had beyond goes to the others by weight until none is above.
    That fixed point is min(weight * level, cap) at the level where the targets add up, and the capped sources are
    exactly those with the smallest cap/weight: a running sum over that order finds the level in one pass.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = per_source.withColumn("w", turn).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
    )
    # the level if exactly the sources before this one are capped; the first that it doesn't cap tells the true level
    s = s.withColumn("level", F.try_divide(F.col("total") - F.col("cap_before"), F.col("w_left")))
    holds = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min(F.when(holds, F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)["level"]
    return s.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level"))).alias("target")
    )


def _near(df: DataFrame, sources: int) -> DataFrame:
    """A table of one row a source, to be joined; broadcast while the sources are few."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def thresholds(sized: DataFrame, goals: DataFrame, sources: int, levels=LEVELS) -> DataFrame:
    """Adds `passes` (whole passes of all documents) and `threshold` (one more pass for hashes below it) to the goals.

    In each level the histogram of the open bucket is summed up in bucket order; the bucket in which the running sum
    crosses what is still wanted stays open, everything before it is taken.
    """
    state = goals.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("passes"),
    ).withColumn("want", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    bits = BITS
    for level in levels:
        bits -= level
        bucket = F.shiftright(F.col("h"), bits)
        hist = (
            sized.join(_near(state.select(F.col("source").alias("s"), F.col("prefix").alias("p")), sources), F.expr("source <=> s"))
            .where(F.shiftright("h", bits + level) == F.col("p"))
            .groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        )
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run)).select(F.col("source").alias("s"), "bucket", "n", "upto")
        at = state.select("source", "want").join(hist, F.expr("source <=> s"), "left")
        # the bucket in which the running sum reaches what is wanted, and what the buckets before it give
        found = at.groupBy("source").agg(
            F.min(F.when(F.col("upto") >= F.col("want"), F.struct(F.col("bucket"), (F.col("upto") - F.col("n")).alias("before")))).alias("hit"),
            F.max("bucket").alias("last"), F.coalesce(F.max("upto"), F.lit(0)).alias("all"),
        ).withColumnRenamed("source", "s")
        state = (
            state.join(_near(found, sources), F.expr("source <=> s"))
            # short of the goal even with the whole bucket: open the place after it, where no document is
            .withColumn("prefix", F.coalesce(F.col("hit.bucket"), F.col("last") + 1, F.shiftleft(F.col("prefix"), level)))
            .withColumn("want", F.col("want") - F.coalesce(F.col("hit.before"), F.col("all")))
            .drop("s", "hit", "last", "all")
        )
        state = common.written(state, "mix-state")
    # the boundary is one hash value now: its rows are taken if that comes nearer to the goal
    edge = (
        sized.join(_near(state.select(F.col("source").alias("s"), F.col("prefix").alias("p")), sources), F.expr("source <=> s"))
        .where(F.col("h") == F.col("p")).groupBy("source").agg(F.sum("size").alias("n")).withColumnRenamed("source", "s")
    )
    more = F.when((F.col("want") > 0) & (F.coalesce(F.col("n"), F.lit(0)) <= 2 * F.col("want")), 1).otherwise(0)
    return state.join(_near(edge, sources), F.expr("source <=> s"), "left").select(
        "source", "source_size", "target", "passes", (F.col("prefix") + more).alias("threshold")
    )


def taken(passes: Column, threshold: Column, size: Column, h: Column) -> Column:
    return size * (passes + (h < threshold).cast("long"))


def _plan(docs: DataFrame, weights, budget: float, max_repeat: float) -> tuple[DataFrame, DataFrame, int]:
    """(sizes and places, the sources' thresholds, number of sources)."""
    sized = common.written(sizes(docs), "mix-sizes")
    per_source = common.written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    sources = per_source.count()
    return sized, thresholds(sized, targets(per_source, weights, budget, max_repeat), sources), sources


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats: how many words of each document the mixture takes."""
    sized, cut, sources = _plan(docs, weights, budget, max_repeat)
    return sized.join(_near(cut.withColumnRenamed("source", "s"), sources), F.expr("source <=> s")).select(
        "doc_id", "size", "source_size", "target",
        taken(F.col("passes"), F.col("threshold"), F.col("size"), F.col("h")).alias("taken"),
        (F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")).alias("repeats"), "source",
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """docs themselves, each row as many times as the mixture takes it. Only the table of sources is joined."""
    _, cut, sources = _plan(docs, weights, budget, max_repeat)
    cut = cut.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), F.col("threshold").alias("__threshold"))
    rows = docs.join(_near(cut, sources), F.expr("source <=> __source"))
    times = F.col("__passes") + (place(F.col("doc_id"), F.col("text")) < F.col("__threshold")).cast("long")
    copies = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(copies).alias("__copy")).drop("__copy")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5(concat_ws('|', doc_id, coalesce(text, ''))), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as cap from s),
c as (select a.source, any_value(a.cap / a.w) as ratio, ((select 1.5::double * sum(source_size) from s) - coalesce(sum(b.cap) filter (b.cap / b.w < a.cap / a.w), 0)) / sum(b.w) filter (b.cap / b.w >= a.cap / a.w) as level
  from r a, r b group by a.source),
g as (select source, source_size, coalesce(least(cap, w * (select arg_min(level, ratio) from c where level <= ratio)), cap) as target from r),
t as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from g),
k as (select d.source, h, sum(size) as n from d group by all),
u as (select source, h, n, sum(n) over (partition by source order by h) as upto from k),
x as (select u.source, h, upto - n < target - passes * source_size and (upto < target - passes * source_size or n <= 2 * (target - passes * source_size - (upto - n))) as more
  from u join t on u.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target, (size * (passes + more::int))::bigint as taken
from d join t on d.source is not distinct from t.source join x on d.source is not distinct from x.source and d.h = x.h
"""
