"""Merkle manifest of a dataset: a hash tree whose nodes keep SHA-256 midstates.

Rows are leaves; a language's leaves, by id, are folded `arity` at a time to the language's subroot, and the subroots to the root. A parent row
keeps its children's digests and, for each child slot, the hash state just before that child (`sha_state`). When a leaf
changes, its parent's state of that slot is resumed with the new digest and the right siblings only, and so on to the root: no
left sibling is hashed again.

The tree is built in blocks of at most `BLOCK` leaves, so a task holds a block however large a language is; the block roots are the
next layer's leaves. Places in the order come from a range partitioning (`operators.prefix`), not from a window. To fold, a block of leaves meets its own
parents and the one parent a level on the way from the block to the root.

Edge cases: a null field is hashed as `-`; rows without a language are a tree of their own, which comes first; rows without an id come first in
their tree and are never tampered with; rows that repeat an id are ordered by their digest, equal rows are leaves of their own; empty and very
long texts are hashed whole; a lone leaf is its tree's subroot, a lone subroot the root, with nothing in the proof; an empty table has no tree and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import positions
from . import common
from . import sha_state as S
from .spelling import CRC_STEPS, crc_sql

#: Leaves a block at most; a block is a power of the arity.
BLOCK = 2048
#: Key of the tree over the subroots.
TOP = -1
PARENTS = "tree long, level int, pos long, children array<binary>, states array<binary>, digest binary"


@dataclass
class Manifest:
    """leaves: tree, pos, and the columns of the rows; trees: tree, lang, size, height, subroot; parents: a row a node (PARENTS)."""

    leaves: DataFrame
    trees: DataFrame
    parents: DataFrame
    root: str | None
    arity: int

    @property
    def levels(self) -> int:
        return block_levels(self.arity)


def block_levels(arity: int) -> int:
    n = 1
    while arity ** (n + 1) <= BLOCK:
        n += 1
    return n


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _height(size: Column, arity: int) -> Column:
    """Levels until one node is left."""
    h = F.lit(0)
    reach = 1
    while reach < 1 << 50:
        h = h + (size > reach).cast("int")
        reach *= arity
    return h


def _children(digests: list[bytes], arity: int) -> tuple[np.ndarray, list[list[bytes]], list[list[bytes]]]:
    """One level up: the parents' digests as words, their children and their states before each child."""
    words = S.from_bytes(b"".join(digests))
    n = len(digests)
    parents = -(-n // arity)
    state, states = S.start(parents), []
    counts = np.minimum(arity, n - arity * np.arange(parents))
    for j in range(arity):
        has = np.flatnonzero(counts > j)
        states.append(S.to_bytes(state))
        state[:, has] = S.absorb(state[:, has], S.block_of(S.hex_text(words[:, has * arity + j])))
    kids = [digests[p * arity : p * arity + arity] for p in range(parents)]
    return S.closed(state, counts), kids, [[states[j][p] for j in range(c)] for p, c in enumerate(counts)]


def _layer(nodes: DataFrame, base: int, arity: int) -> DataFrame:
    """nodes: tree, size, pos (at level base), digest. The parents of `block_levels` levels above, fewer where one node is left."""
    m = block_levels(arity)
    block = arity**m

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        size, first = int(pdf["size"].iat[0]), int(pdf["pos"].iat[0])
        left, digests = -(-size // arity**base), list(pdf["digest"])
        out, level = [], base
        while left > 1 and level < base + m:
            words, kids, states = _children(digests, arity)
            digests, left, level, first = S.to_bytes(words), -(-left // arity), level + 1, first // arity
            out += [(pdf["tree"].iat[0], level, first + i, k, s, d) for i, (k, s, d) in enumerate(zip(kids, states, digests))]
        return pd.DataFrame(out, columns=["tree", "level", "pos", "children", "states", "digest"])

    # dealt out by number: few bytes, but much to compute, so partitions aren't to be put together again
    dealt = nodes.withColumn("block", F.expr(f"pos div {block}")).repartition(common.shuffle_partitions(nodes.sparkSession), "tree", "block")
    return dealt.groupBy("tree", "block").applyInPandas(build, PARENTS)


def _grow(nodes: DataFrame, largest: int, arity: int, name: str) -> DataFrame:
    """All parents over nodes (tree, size, pos, digest), layer by layer; largest: leaves of the largest tree."""
    m, base, out = block_levels(arity), 0, None
    sizes = nodes.select("tree", "size").distinct()
    while out is None or arity**base < largest:
        layer = common.written(_layer(nodes, base, arity), name)
        out, base = (layer if out is None else out.unionByName(layer)), base + m
        nodes = layer.where(F.col("level") == base).join(sizes, "tree").where(F.col("size") > arity**base).select("tree", "size", "pos", "digest")
    return out


def build(rows: DataFrame, arity: int = 2, key: str = "doc_id", tree: str = "lang", leaf: str = "leaf") -> Manifest:
    """rows: key, tree, leaf (hex digest) and others. The manifest's tables are in the shared folder."""
    placed = positions(common.written(rows, "merkle-rows"), [tree], [key, leaf])
    sizes = common.written(placed.groupBy(tree).agg(F.count("*").alias("size")), "merkle-sizes")
    trees = common.written(positions(sizes, [], [tree], "tree").withColumn("height", _height(F.col("size"), arity)), "merkle-trees")
    named = trees.withColumnRenamed(tree, "__tree")
    leaves = common.written(placed.join(named, placed[tree].eqNullSafe(named["__tree"])).drop("__tree", "height"), "merkle-leaves")
    largest, n_trees = trees.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    digests = leaves.select("tree", "size", "pos", F.unhex(leaf).alias("digest"))
    parents = _grow(digests, largest, arity, "merkle-parents")

    lone = digests.where("size = 1").select("tree", "digest")
    tops = parents.join(trees.select("tree", "height"), "tree").where("level = height").select("tree", "digest")
    trees = common.written(trees.join(lone.unionByName(tops), "tree").withColumnRenamed("digest", "subroot"), "merkle-subroots")
    subroots = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).alias("size"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    over = _grow(subroots, n_trees, arity, "merkle-top")
    last = over.orderBy(F.desc("level")) if n_trees > 1 else subroots
    found = last.select(F.hex("digest")).first()
    return Manifest(leaves, trees, parents.unionByName(over), found[0].lower() if found else None, arity)


def _ways(m: Manifest) -> DataFrame:
    """tree, block, step, slot, pos, children, states: what a block of leaves needs on its way to the root.

    Inside the block: all parents (slot null: by leaf). Above it and above the subroot: one parent a level, with the slot that the way comes from.
    """
    k, levels = m.arity, m.levels
    power = lambda c: F.pow(F.lit(k), c).cast("long")
    inner = m.parents.where((F.col("tree") != TOP) & (F.col("level") <= levels)).select(
        "tree", F.expr(f"pos div cast(pow({k}, {levels} - level) as long)").alias("block"), F.col("level").alias("step"), F.lit(None).cast("int").alias("slot"), "pos", "children", "states"
    )
    blocks = m.trees.select("tree", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {k**levels}"))).alias("block"))
    n_trees = m.trees.count()
    top = 0
    while k**top < n_trees:
        top += 1
    none = F.array().cast("array<int>")
    above = blocks.withColumn("l", F.explode(F.when(F.col("height") > levels, F.sequence(F.lit(levels + 1), F.col("height"))).otherwise(none))).select(
        "tree", "block", F.col("l").alias("step"), F.col("tree").alias("p_tree"), F.col("l").alias("p_level"), F.col("block").alias("at"), (F.col("l") - levels).alias("up")
    )
    over = blocks.withColumn("l", F.explode(F.sequence(F.lit(1), F.lit(top)) if top else none)).select(
        "tree", "block", (F.col("height") + F.col("l")).alias("step"), F.lit(TOP).cast("long").alias("p_tree"), F.col("l").alias("p_level"), F.col("tree").alias("at"), F.col("l").alias("up")
    )
    climbs = above.unionByName(over).withColumns({"p_pos": F.floor(F.col("at") / power(F.col("up"))), "slot": F.pmod(F.floor(F.col("at") / power(F.col("up") - 1)), F.lit(k)).cast("int")})
    nodes = m.parents.select(F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("pos").alias("p_pos"), "children", "states")
    climbed = climbs.join(nodes, ["p_tree", "p_level", "p_pos"]).select("tree", "block", "step", "slot", F.col("p_pos").alias("pos"), "children", "states")
    return inner.unionByName(climbed)


def _climb(pos: np.ndarray, digests: np.ndarray, steps: pd.DataFrame, arity: int) -> tuple[np.ndarray, list[str]]:
    """The root over each leaf, given its place and its new digest, and each leaf's siblings from below, as hex text."""
    n, seen, has = len(pos), [], []
    for _, level in steps.groupby("step", sort=True):
        level = level.sort_values("pos")
        counts = np.array([len(c) for c in level["children"]])
        if level["slot"].isna().iat[0]:
            slot, row = pos % arity, pos // arity - int(level["pos"].iat[0])
            pos = pos // arity
        else:
            slot, row = np.full(n, int(level["slot"].iat[0])), np.zeros(n, np.int64)
        # one entry a (parent, slot)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        kids = S.hex_text(S.from_bytes(b"".join(b for c in level["children"] for b in c)))
        states = S.from_bytes(b"".join(b for c in level["states"] for b in c))
        state = S.absorb(states[:, first[row] + slot], S.block_of(S.hex_text(digests)))
        for j in range(arity):
            there = j < counts[row]
            right = np.flatnonzero(there & (j > slot))
            if len(right):
                state[:, right] = S.absorb(state[:, right], S.block_of(kids[first[row[right]] + j]))
            beside = np.zeros((n, 64), np.uint8)
            other = there & (j != slot)
            beside[other] = kids[first[row[other]] + j]
            seen.append(beside)
            has.append(other)
        digests = S.closed(state, counts[row])
    if not seen:
        return digests, [""] * n
    text, keep = np.stack(seen, axis=1), np.stack(has, axis=1)
    return digests, [text[i][keep[i]].tobytes().decode() for i in range(n)]


def fold(m: Manifest, leaves: DataFrame, new: str, columns: list[str]) -> DataFrame:
    """leaves: of the manifest's, with a column `new` (hex digest). The columns, folded_root and proof (siblings' digests, level by level)."""
    arity, block = m.arity, m.arity**m.levels
    kept = leaves.select("tree", F.expr(f"pos div {block}").alias("block"), "pos", F.col(new).alias("__new"), *[c for c in columns if c not in ("tree", "pos")])
    schema = ", ".join(f"{c} {t}" for c, t in leaves.select(*columns).dtypes) + ", folded_root string, proof string"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[columns].copy()
        words = S.from_bytes(bytes.fromhex("".join(left["__new"])))
        roots, proofs = _climb(left["pos"].to_numpy(np.int64), words, right, arity)
        out["folded_root"] = [b.hex() for b in S.to_bytes(roots)]
        out["proof"] = proofs
        return out

    n = common.shuffle_partitions(leaves.sparkSession)
    both = [df.repartition(n, "tree", "block").groupBy("tree", "block") for df in (kept, _ways(m))]
    return both[0].cogroup(both[1]).applyInPandas(lambda a, b: run(a, b) if len(a) else pd.DataFrame({c: [] for c in [*columns, "folded_root", "proof"]}), schema)


#: Rows whose crc32 this divides are tampered with.
TAMPER = 7


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(c["doc_id"].cast("string")) % TAMPER == 0
    rows = docs.select("doc_id", "lang", leaf_digest(**c).alias("leaf"), F.when(hit, leaf_digest(**c | {"n_chars": F.col("n_chars") + 1})).alias("changed"))
    m = build(rows)
    folded = fold(m, m.leaves.withColumn("new", F.coalesce("changed", "leaf")), "new", ["doc_id", "tree", "leaf"])
    subroots = m.trees.select("tree", F.lower(F.hex("subroot")).alias("subroot"))
    return folded.join(subroots, "tree").select(
        "doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(m.root)).alias("verified")
    )


_FIELD = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
_LEAF = lambda n: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", n, "text"))) + ")"
ORACLE = f"""
with recursive {CRC_STEPS},
d as (select doc_id, lang, {_LEAF("n_chars")} as leaf, case when {crc_sql("doc_id::varchar")} % {TAMPER} = 0 then {_LEAF("(n_chars + 1)")} end as changed from documents, crc),
l as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from d),
t as (select tree, 0 as level, pos, n, leaf as digest from l
  union all select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from t where n > 1 group by tree, level, pos // 2, n),
s as (select tree, level as height, digest as subroot from t where n = 1),
u as (select 0 as level, tree as pos, (select count(*) from s) as n, subroot as digest from s
  union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from u where n > 1 group by level, pos // 2, n),
f as (select doc_id, leaf, tree, pos as own, height, 0 as level, pos, coalesce(changed, leaf) as x, '' as proof from l join s using (tree)
  union all select doc_id, leaf, f.tree, own, height, f.level + 1, f.pos // 2, sha256(case when f.pos % 2 = 0 then x || coalesce(t.digest, '') else coalesce(t.digest, '') || x end), proof || coalesce(t.digest, '')
  from f left join t on t.tree = f.tree and t.level = f.level and t.pos = xor(f.pos, 1) where f.level < height),
g as (select doc_id, leaf, tree, own, 0 as level, tree as pos, x, proof from f where level = height
  union all select doc_id, leaf, g.tree, own, g.level + 1, g.pos // 2, sha256(case when g.pos % 2 = 0 then x || coalesce(u.digest, '') else coalesce(u.digest, '') || x end), proof || coalesce(u.digest, '')
  from g left join u on u.level = g.level and u.pos = xor(g.pos, 1) where g.level < (select max(level) from u))
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, x as folded_root, x = root as verified
from g join s using (tree), (select digest as root from u where n = 1) where level = (select max(level) from u)
"""
