"""Document fingerprints by SimHash, and search within a Hamming radius by permuted block tables.

A term is a pair of neighbouring words; its weight is the number of times it occurs. Each term's hash bits vote with that weight, and
a fingerprint bit is set where the votes for one exceed those for zero. `BITS` bits are made of `BITS // 64` hashes.

Votes are counted without Python: hash words are spread over lanes, so that one sum counts three bits of a term at once.

Search. Fingerprints are cut into `radius + spare` blocks; whatever lies within the radius agrees in at least `spare` blocks. For each
choice of `spare` blocks there is a table keyed by these blocks, i.e. the bits permuted so that they lead; a query looks
in all tables and measures what it finds. Equal fingerprints are one entry.

Edge cases: a null or empty text has no term and the fingerprint of zeros, so has a text without words; a single word is a term of its own;
equal texts have equal fingerprints; the document after the last is the first, for an only document itself; documents of
one id are ordered by a hash of the text; null ids come last in descending order; repeated rows (same id and text) count as one document,
and each of them is returned with its values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 128
LANES, SHIFTS = 3, 21
LANE = sum(1 << (LANES_AT * SHIFTS) for LANES_AT in range(LANES))


def terms(text: Column) -> Column:
    """Pairs of neighbouring words; of a single word itself."""
    w = common.words_of(text)
    return F.when(F.size(w) == 1, w).otherwise(
        F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    )


def _votes(bits: int) -> list[Column]:
    """Sums that count the set bits: column k * 21 + s counts bits s, s + 21 and s + 42 of hash k in lanes of 21 bits.

    Bit 63 is counted apart. A lane holds up to 2**21 - 1 terms; `_fold` keeps groups below that.
    """
    out = []
    for k in range(bits // 64):
        h = F.col(f"h{k}")
        out += [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(LANE))).alias(f"v{k}_{s}") for s in range(SHIFTS)]
        out.append(F.sum(F.shiftrightunsigned(h, 63)).alias(f"v{k}_63"))
    return out


def _counts(k: int) -> list[Column]:
    """The number of terms with each of the 64 bits of hash k set, from the lane sums."""
    lane = [F.shiftrightunsigned(F.col(f"v{k}_{b % SHIFTS}"), SHIFTS * (b // SHIFTS)).bitwiseAND(F.lit((1 << SHIFTS) - 1)) for b in range(63)]
    return [*lane, F.col(f"v{k}_63")]


CHUNK = 1 << 20


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """keys (which tell rows apart) and fp, an array of bits // 64 longs. Rows that are spread by the keys are not shuffled again."""
    exploded = docs.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("at", "term"))
    hashed = exploded.select(*keys, F.floor(F.col("at") / CHUNK).alias("part"), "term", *[F.xxhash64(F.lit(k), "term").alias(f"h{k}") for k in range(bits // 64)])
    some = hashed.withColumns({f"h{k}": F.when(F.col("term").isNotNull(), F.col(f"h{k}")).otherwise(F.lit(0).cast("long")) for k in range(bits // 64)})
    per = some.groupBy(*keys, "part").agg(F.count("term").alias("n"), *_votes(bits))
    counts = per.select(*keys, "n", F.array(*[c for k in range(bits // 64) for c in _counts(k)]).alias("c"))
    # texts of more than CHUNK terms are summed up chunk by chunk; all others have one chunk
    add = F.aggregate("all", F.array_repeat(F.lit(0).cast("long"), bits), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("c").alias("all")).select(*keys, "n", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(add).alias("c"))
    word = lambda k: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(F.when(F.get("c", b + 64 * k) * 2 > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )
    return total.select(*keys, F.array(*[word(k) for k in range(bits // 64)]).alias("fp"))


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, bits // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    return 1 - distance(a, b, bits) / F.lit(float(bits))


def as_text(fp: Column, bits: int = BITS) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(fp, k)), 16, "0")) for k in range(bits // 64)])


def _block_keys(fp: Column, radius: int, spare: int, bits: int) -> Column:
    """A key for each choice of `spare` of the radius + spare blocks: the chosen blocks' bits, led by the choice's number."""
    n = radius + spare
    cuts = [bits * i // n for i in range(n + 1)]

    def block(a: int, b: int) -> Column:
        """Bits a to b; they stand in one word or in two."""
        parts = []
        for k in range(a // 64, (b - 1) // 64 + 1):
            lo, hi = max(a, 64 * k) - 64 * k, min(b, 64 * k + 64) - 64 * k
            parts.append(F.shiftleft(F.shiftrightunsigned(F.get(fp, k), lo), 64 - (hi - lo)))
        return F.xxhash64(*parts)

    blocks = [block(a, b) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(c), *[blocks[i] for i in chosen]) for c, chosen in enumerate(combinations(range(n), spare))])


def within_radius(queries: DataFrame, everything: DataFrame, radius: int, spare: int = 2, bits: int = BITS) -> DataFrame:
    """All (query fp, found fp, distance) with distance <= radius; both inputs have a column fp. Each pair once."""
    table = lambda d: d.select("fp").distinct().select("fp", F.explode(_block_keys(F.col("fp"), radius, spare, bits)).alias("key"))
    pairs = table(queries).withColumnRenamed("fp", "query_fp").join(table(everything), "key")
    near = pairs.withColumn("distance", distance(F.col("query_fp"), F.col("fp"), bits)).where(F.col("distance") <= radius)
    return near.select("query_fp", "fp", "distance").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a row's key: two hashes of id and text."""
    text = common.text_of()
    return docs.select(
        F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    )


def with_next(base: DataFrame) -> DataFrame:
    """a, b, doc_id, copies, next_a, next_b of every document of keyed(), repeated rows once: the next in descending order of doc_id, after the last the first.

    Ids are range-partitioned; inside a partition a window finds the next one, and the partitions' ends meet in a table of
    one row a partition.
    """
    spark = base.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.desc("a"), F.desc("b")]
    ids = base.groupBy("doc_id", "a", "b").agg(F.count("*").cast("int").alias("copies")).repartitionByRange(common.shuffle_partitions(spark), "doc_id", "a")
    placed = common.written(ids.withColumn("p", F.spark_partition_id()), "simhash-order")
    inside = placed.withColumn("next", F.lead(F.struct("a", "b")).over(Window.partitionBy("p").orderBy(*order)))
    rank = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "a", "b")
    tops = placed.groupBy("p").agg(F.max(rank).alias("top"))
    everything = Window.partitionBy(F.lit(0)).orderBy(F.desc("p"))
    tops = tops.select("p", F.coalesce(F.lead("top").over(everything), F.first("top").over(everything)).alias("after"))
    return inside.join(tops, "p").select("a", "b", "doc_id", "copies", F.coalesce("next.a", "after.a").alias("next_a"), F.coalesce("next.b", "after.b").alias("next_b"))


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, text, edited) and (a, b, doc_id, copies, next_a, next_b), one row a document: the last third of the code points replaced by the next text's first as many.

    Texts are dealt out once, by key (all uses read the same columns, so Spark reuses that exchange); what moves besides is keys,
    lengths and the heads that are put in.
    """
    base = keyed(docs)
    order = common.written(with_next(base), "simhash-order-next")
    if not order.where("copies > 1").isEmpty():
        base = base.dropDuplicates(["a", "b"])
    wants = base.select("a", "b", F.floor(F.length("text") / 3).cast("int").alias("k"))
    need = common.written(order.join(wants, ["a", "b"]), "simhash-next")
    moved = need.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), "k")
    texts = base.select("a", "b", "text")
    heads = texts.join(moved, ["a", "b"]).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), F.expr("substring(text, 1, k)").alias("head"))
    kept = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))")
    return texts.join(heads, ["a", "b"]).select("a", "b", "text", F.concat(kept, "head").alias("edited")), need.drop("k")


#: Of the query's search: documents whose id `QUERY_EVERY` divides, against all.
RADIUS, SPARE, QUERY_EVERY = 3, 1, 100


def neighbours(own: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """own (doc_id, fp) with n_within: for the query documents the number of other fingerprints within the radius, for others null."""
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    near = within_radius(own.where(asks), own, radius, spare).groupBy("query_fp").agg(F.count_if(F.col("distance") > 0).alias("n_within"))
    asked = own.where(asks).join(near, F.col("fp") == F.col("query_fp"), "left").drop("query_fp")
    return asked.unionByName(own.where(~asks).withColumn("n_within", F.lit(None).cast("long")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, order = edited(common.table(spark, sf_dir, "documents"))
    body = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
    fps = fingerprints(docs.select("a", "b", F.explode(body).alias("x")).select("a", "b", "x.which", "x.body"), ["a", "b", "which"], "body")
    fp = lambda which: F.max(F.when(F.col("which") == which, F.col("fp")))
    pairs = fps.groupBy("a", "b").agg(fp(0).alias("fp"), fp(1).alias("edited_fp"))
    facts = docs.select("a", "b", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    own = common.written(pairs.join(facts, ["a", "b"]).join(order, ["a", "b"]), "simhash-fps")
    after = own.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("fp").alias("next_fp"))
    rows = neighbours(own).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return rows.join(after, ["next_a", "next_b"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
