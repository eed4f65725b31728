"""N-gram Jaccard join by signature trees.

A document's set is its distinct word shingles, as 64-bit hashes; documents with equal sets are one node from the start.

Top of the tree: size ranges and parts. Sizes are cut into ranges such that linked sets lie in one range or two neighbouring ones, and a
pair of neighbouring ranges fixes the largest possible symmetric difference D of a linked pair. The hash space is cut
into D + u parts: a linked pair agrees exactly in at least u of them. Each set hands out keys of its parts, leaving
out its u - 1 smallest ones (equal sizes by a hash of the contents, the same for all sets), so a linked pair always shares a key.

Sets that share a key are a group, and groups of the same sets are one. Many sets share a key by a common passage only, and over chains of
such groups nearly all sets would hang together. So each group is sifted by itself: leaves are sets with token bitmaps; inner nodes
hold the OR of their bitmaps, their size range and their least bit count, and a dual traversal from the roots keeps a pair of nodes only
while the largest overlap that bitmaps and sizes allow reaches what the threshold asks of their sizes. This takes 128 bytes a set. Sets
that hang together by pairs that are left form one tree; all others are pruned without being compared.

Inside a tree the traversal is made again, and surviving leaf pairs that aren't in one class yet are compared exactly. A group or tree
larger than a block (`BLOCK_SETS` sets or `BLOCK_ITEMS` shingles) is cut by size, and each pair of blocks whose sizes can link is a
task's work of its own. What leaves a task is at most one edge a set (of small groups: their pairs). A key that over `HOT` sets of a batch
share isn't sifted: its sets are of one tree.

Edge cases: a document with fewer words than a shingle has its whole word sequence as its only one; without words (null, empty,
white space) the set is empty, linked with nothing; repeated rows and copies share a node; null ids are kept (a class's
id is its smallest id that isn't null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, repeats, vectors
from .components import components

BITS = 1024
FAN = 16
BLOCK_SETS, BLOCK_ITEMS = 2048, 1_500_000
#: Parts beyond D, as a share of D.
SPARE = 0.5
BROADCAST_ROWS = 500_000
#: Bits of a key that are shuffled, the others are 0: sets that share them by chance are sifted apart.
KEY_BITS = 40
#: A key that more sets of a batch share leaves the batch as one row.
HOT = 64
#: Groups of up to so many sets are sifted many at a time.
SMALL = 32
MAX_SIZE = 1 << 40
#: Tells rows of one id apart.
MARK = "xxhash64(text) as mark"


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; two sets link when den * intersection >= num * union."""

    words: int = 5
    num: int = 8
    den: int = 10

    def need(self, total):
        """The least intersection of a linked pair whose sizes add up to total."""
        return -(-total * self.num // (self.num + self.den))

    def ranges(self) -> np.ndarray:
        """Lower ends of the size ranges."""
        out = [1]
        while out[-1] < MAX_SIZE:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out)


def sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' shingle sets: hashes, sorted and distinct in each row, and where each row's begin."""
    data = vectors.lower_ascii(data)
    starts, ends, first = vectors.words(data, off)
    h = vectors.word_hashes(data, starts, ends, 11)
    n = np.diff(first)
    row, grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) >= k:
        grams = vectors.chain(h, k, 12)
        row = np.repeat(np.arange(len(n)), n)
        fits = row[: len(grams)] == row[k - 1 :]
        grams, row = grams[fits], row[: len(grams)][fits]
    for m in range(1, k):
        some = np.flatnonzero(n == m)
        if len(some):
            at = first[some]
            whole = np.zeros(len(some), np.uint64)
            for i in range(m):
                whole = vectors.mix(whole * np.uint64(31) + h[at + i], 100 + m)
            grams, row = np.concatenate([grams, whole]), np.concatenate([row, some])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(n) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        return total[first[1:]] - total[first[:-1]]


def nodes(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number a set: equal sets, equal number."""
    return vectors.mix(_sums(vectors.mix(grams, 21), first) + np.diff(first).astype(np.uint64), 22).view(np.int64)


def keys(items: np.ndarray, lows: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys that a set hands out, in its own pair of size ranges and the one below."""
    n = len(items)
    own = int(np.searchsorted(lows, n, "right")) - 1
    out = []
    for c in (own - 1, own):
        if c < 0:
            continue
        high = int(lows[c + 1]) - 1
        reach = high * rule.den // rule.num
        if n > reach:
            continue
        total = high + reach
        totals = np.arange(max(2 * int(lows[c]), total - rule.num - rule.den + 1), total + 1)  # rounding up repeats with this period
        d = int((totals - 2 * rule.need(totals)).max())
        if not d:  # only equal sets link, and these are one node
            continue
        spare = max(1, int(SPARE * d))
        k = d + spare
        part = (vectors.mix(items, 31) % np.uint64(k)).astype(np.int64)
        count = np.bincount(part, minlength=k)
        order = np.argsort(part, kind="stable")
        content = _sums(vectors.mix(items[order], 32), np.concatenate([[0], np.cumsum(count)]))
        key = vectors.mix(vectors.mix(content, 33) + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64), 34 + c)
        rank = (count.astype(np.uint64) << np.uint64(40)) + (key >> np.uint64(24))
        out.append(key[rank >= np.partition(rank, spare - 1)[spare - 1]])  # of `spare` parts that agree, the largest by rank is in both sets' lists
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, mark (a hash of the text), node, n, bits (the token bitmap) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in vectors.pieces(batch, "text"):
                grams, first = sets(data, off, rule.words)
                bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(first) - 1, [None, pa.py_buffer(_bitmaps(grams, first))])
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["mark"], pa.array(nodes(grams, first)), pa.array(np.diff(first)), bits.cast(pa.binary())], names=["doc_id", "mark", "node", "n", "bits"]
                )

    columns = docs.select("doc_id").schema.add("mark", "long").add("node", "long").add("n", "long").add("bits", "binary")
    return docs.selectExpr("doc_id", "text", MARK).mapInArrow(run, columns)


def near_by(flat: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key rows (key, node) of a batch with each key once: of the nodes that share a key here, the smallest goes on under the key,
    and the others meet it under a key of that node's own. So a key that all documents share leaves a batch as one row."""
    order = np.lexsort((own, flat))
    flat, own = flat[order], own[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    low = own[new][np.cumsum(new) - 1] if len(own) else own
    linked = np.stack([low[low != own], own[low != own]])
    linked = np.unique(linked, axis=1) if linked.size else linked
    centres = np.unique(linked[0])
    return (
        np.concatenate([flat[new], vectors.mix(centres.view(np.uint64), 23), vectors.mix(linked[0].view(np.uint64), 23)]),
        np.concatenate([own[new], centres, linked[1]]),
    )


def _key_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, node: nodes that share a key may link; a key with a row without a node is hot: other nodes stand behind some of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = rule.ranges()
        for batch in batches:
            for _, data, off in vectors.pieces(batch, "text"):
                grams, first = sets(data, off, rule.words)
                ids, at = np.unique(nodes(grams, first), return_index=True)
                got = [keys(grams[a:b], lows, rule) if b > a else np.zeros(0, np.uint64) for a, b in zip(first[at].tolist(), first[at + 1].tolist())]
                flat = np.concatenate(got) if got else np.zeros(0, np.uint64)
                flat, own = flat >> np.uint64(64 - KEY_BITS) << np.uint64(64 - KEY_BITS), np.repeat(ids, [len(g) for g in got])
                _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
                hot = many[at] > HOT
                few, low = near_by(flat[hot], own[hot])
                marks = np.unique(few)
                none = np.repeat([False, True], [(~hot).sum() + len(few), len(marks)])
                flat, own = np.concatenate([flat[~hot], few, marks]), np.concatenate([own[~hot], low, np.zeros(len(marks), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(own, mask=none)], names=["key", "node"])

    return docs.select("text").mapInArrow(run, "key long, node long")


def _groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """tree, node, low: the nodes of each key that several share, keys of the same nodes under one number; low, the least node, where the key is hot."""
    same_key = Window.partitionBy("key")
    of_key = {"low": F.min("node"), "high": F.max("node"), "hot": F.max(F.isnull("node")), "tree": F.sum(F.shiftright(F.xxhash64("node"), 24))}
    rows = _key_rows(docs, rule).select("node", *[how.over(same_key).alias(name) for name, how in of_key.items()]).where("low < high and node is not null")
    return rows.select("tree", "node", F.expr("if(hot, low, null)").alias("low")).distinct()


def _members(docs: DataFrame, chosen: DataFrame, n_chosen: int, rule: Rule) -> DataFrame:
    """tree, block, node, items: the sets of the chosen nodes, made again from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in vectors.pieces(batch, "text"):
                grams, first = sets(data, off, rule.words)
                good = pa.array(nodes(grams, first) == rows["node"].to_numpy())  # not another text of the same id and hash
                items = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows["tree"], rows["block"], rows["node"], items], names=["tree", "block", "node", "items"]).filter(good)

    picked = F.broadcast(chosen) if n_chosen <= BROADCAST_ROWS else chosen
    texts = docs.selectExpr("doc_id", "text", MARK).join(picked, F.expr("doc_id <=> rep and mark = rep_mark")).select("tree", "block", "node", "text")
    return texts.mapInArrow(run, "tree long, block int, node long, items array<long>")


def _blocks(reps: DataFrame) -> DataFrame:
    """reps (tree, node, n, ...) with the block of each node in its tree: by size, then by hash. Counted by size, so that no
    task holds a whole tree; a size with more sets than a block holds is dealt over several."""
    share = F.lit(1 / BLOCK_SETS) + F.col("n") / F.lit(BLOCK_ITEMS)
    sizes = reps.groupBy("tree", "n").agg(F.count("*").alias("some")).withColumn("weight", F.col("some") * share)
    before = Window.partitionBy("tree").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = common.written(sizes.select("tree", "n", "weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("before")), "join-sizes")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(1 << 20)
    return reps.join(placed, ["tree", "n"]).withColumn("block", F.floor(F.col("before") + F.col("weight") * spread).cast("int")).drop("weight", "before")


def _bitmaps(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    m = len(first) - 1
    out = np.zeros((m, BITS), bool)
    out[vectors.rows_of(first, len(items)), (items & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _levels(bitmaps: np.ndarray, n: np.ndarray) -> list[dict]:
    """The tree over sets in order of size: leaves first, then nodes of FAN each, up to one root."""
    levels = [{"bits": bitmaps, "lo": n, "hi": n, "pop": np.bitwise_count(bitmaps).sum(1).astype(np.int64)}]
    while len(levels[-1]["lo"]) > 1:
        low = levels[-1]
        at = np.arange(0, len(low["lo"]), FAN)
        levels.append({
            "bits": np.bitwise_or.reduceat(low["bits"], at, axis=0), "lo": np.minimum.reduceat(low["lo"], at),
            "hi": np.maximum.reduceat(low["hi"], at), "pop": np.minimum.reduceat(low["pop"], at),
        })
    return levels


def possible(x: dict, y: dict, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Can any set below node x[i] link with any below y[j]? A bit of a set outside the other node's OR costs it a member."""
    sizes = (x["lo"][i] * rule.num <= y["hi"][j] * rule.den) & (y["lo"][j] * rule.num <= x["hi"][i] * rule.den)
    need = rule.need(x["lo"][i] + y["lo"][j])
    common_bits = np.bitwise_count(x["bits"][i] & y["bits"][j]).sum(1).astype(np.int64)
    mine = x["hi"][i] - np.maximum(0, x["pop"][i] - common_bits)
    yours = y["hi"][j] - np.maximum(0, y["pop"][j] - common_bits)
    return sizes & (mine >= need) & (yours >= need)


def _pairs(x: list[dict], y: list[dict], same: bool, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal of two trees: the leaf pairs that survive."""
    top = max(len(x), len(y)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        a, b = x[min(level, len(x) - 1)], y[min(level, len(y) - 1)]
        keep = []
        for s in range(0, len(i), 200_000):  # in slices, for bounded memory
            keep.append(possible(a, b, i[s:s + 200_000], j[s:s + 200_000], rule))
        keep = np.concatenate(keep)
        if same:
            keep &= i <= j
        i, j = i[keep], j[keep]
        if level == 0 or not len(i):
            break
        step = np.arange(FAN)
        if level < len(x):
            i, j, ni = (i[:, None] * FAN + step).ravel(), np.repeat(j, FAN), len(x[level - 1]["lo"])
            i, j = i[i < ni], j[i < ni]
        if level < len(y):
            i, j, nj = np.repeat(i, FAN), (j[:, None] * FAN + step).ravel(), len(y[level - 1]["lo"])
            i, j = i[j < nj], j[j < nj]
    return (i[i < j], j[i < j]) if same else (i, j)


def _spanning(i: np.ndarray, j: np.ndarray, n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of n nodes by those pairs (i, j) that are linked: `linked` gets a node and some of its partners and chooses."""
    label = np.arange(n)
    out: list[tuple[int, int]] = []
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
        p = int(i[s])
        others = j[s:e]
        others = others[label[others] != label[p]]
        for o in linked(p, others).tolist() if len(others) else []:
            if label[o] != label[p]:
                out.append((p, o))
                label[label == label[o]] = label[p]
    return out


def sifted(n: np.ndarray, bits: np.ndarray, na: int | None, rule: Rule) -> list[tuple[int, int]]:
    """Spanning pairs that sizes and bitmaps allow, among all sets (na None), or between the first na and the others."""
    order_a = np.argsort(n[:na], kind="stable")
    x = _levels(bits[order_a], n[order_a])
    if na is None:
        i, j = _pairs(x, x, True, rule)
        return _spanning(order_a[i], order_a[j], len(n), lambda p, others: others)
    order_b = na + np.argsort(n[na:], kind="stable")
    i, j = _pairs(x, _levels(bits[order_b], n[order_b]), False, rule)
    return _spanning(order_a[i], order_b[j], len(n), lambda p, others: others)


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, rule: Rule) -> list[tuple[int, int]]:
    """Spanning links among sets_a (sets_b None), or between sets_a and sets_b; b's are numbered after a's."""
    everything = sets_a + (sets_b or [])
    na = len(sets_a)

    def tree(group: list[np.ndarray]):
        n = np.array([len(s) for s in group], np.int64)
        order = np.argsort(n, kind="stable")
        first = np.concatenate([[0], np.cumsum(n[order])])
        return order, _levels(_bitmaps(np.concatenate([group[o] for o in order]), first), n[order])

    order_a, x = tree(sets_a)
    order_b, y = (order_a, x) if sets_b is None else tree(sets_b)
    i, j = _pairs(x, y, sets_b is None, rule)

    def linked(p: int, others: np.ndarray) -> np.ndarray:
        mine = everything[p]
        sizes = np.array([len(everything[o]) for o in others])
        flat = np.concatenate([everything[o] for o in others])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        inside = np.concatenate([[0], np.cumsum(mine[at] == flat)])
        ends = np.cumsum(sizes)
        shared = inside[ends] - inside[ends - sizes]
        return others[shared * rule.den >= rule.num * (len(mine) + sizes - shared)]

    return _spanning(order_a[i], order_b[j] + (0 if sets_b is None else na), len(everything), linked)


def _sift(placed: DataFrame, rule: Rule) -> DataFrame:
    """placed: tree, i, j, side, node, n, bits, sorted by (tree, i, j, side). u, v: pairs of each pair of blocks that sizes and bitmaps allow,
    of small groups all, else spanning ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, side, node, n, bits) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            size = np.diff(np.append(start, len(key)))
            small = np.repeat((size <= SMALL) & (key[start, 1] == key[start, 2]), size)
            leaf = {"bits": bits, "lo": n, "hi": n, "pop": np.bitwise_count(bits).sum(1).astype(np.int64)}
            run_of, u, v = np.repeat(np.arange(len(start)), size), [], []
            for apart in range(1, SMALL):
                a = np.flatnonzero(small[:-apart] & (run_of[apart:] == run_of[:-apart]))
                if not len(a):
                    break
                a = a[possible(leaf, leaf, a, a + apart, rule)]
                u.append(node[a])
                v.append(node[a + apart])
            for s, e in zip(start[~small[start]].tolist(), (start + size)[~small[start]].tolist()):
                na = None if key[s, 1] == key[s, 2] else int((side[s:e] == 0).sum())
                if na is None or 0 < na < e - s:
                    found = np.array(sifted(n[s:e], bits[s:e], na, rule), np.int64).reshape(-1, 2)
                    u.append(node[s:e][found[:, 0]])
                    v.append(node[s:e][found[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (u, v)], names=["u", "v"])

        left = None
        for batch in batches:
            key, side, node, n = np.stack([batch[c].to_numpy() for c in ("tree", "i", "j")], 1), batch["side"].to_numpy(), batch["node"].to_numpy(), batch["n"].to_numpy()
            bits = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            rows = (key, side, node, n, bits) if left is None else tuple(np.concatenate(x) for x in zip(left, (key, side, node, n, bits)))
            if not len(rows[0]):
                continue
            cut = int(np.flatnonzero((rows[0] != rows[0][-1]).any(1)).max(initial=-1)) + 1  # the last group may go on
            if cut:
                yield pairs(*[x[:cut] for x in rows])
            left = tuple(x[cut:] for x in rows)
        if left is not None:
            yield pairs(*left)

    return placed.mapInArrow(run, "u long, v long")


def _tasks(placed: DataFrame, rule: Rule, name: str) -> DataFrame:
    """placed: tree, block, n. Both sides (tree, block, i, j, side) of each pair of blocks whose sizes can link."""
    blocks = placed.groupBy("tree", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = blocks.select("tree", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tasks = common.written(
        blocks.withColumnRenamed("block", "i").join(other, "tree").where((F.col("i") <= F.col("j")) & (F.col("lo2") * rule.num <= F.col("hi") * rule.den) & (F.col("lo") * rule.num <= F.col("hi2") * rule.den))
        .select("tree", "i", "j"), name,
    )
    return tasks.select("tree", F.col("i").alias("block"), "i", "j", F.lit(0).alias("side")).unionByName(
        tasks.where("i != j").select("tree", F.col("j").alias("block"), "i", "j", F.lit(1).alias("side"))
    )


def _dealt(placed: DataFrame) -> DataFrame:
    """Each pair of blocks in one task, the first side first."""
    return placed.repartition(common.shuffle_partitions(placed.sparkSession), "tree", "i", "j").sortWithinPartitions("tree", "i", "j", "side")


def _trees(docs: DataFrame, by_node: DataFrame, rule: Rule) -> DataFrame:
    """node, comp: the trees of sets that may link."""
    groups = common.written(_groups(docs, rule), "join-groups")
    sized = groups.where("low is null").join(by_node.select("node", "n"), "node").select("tree", "node", "n")
    chosen = common.written(_blocks(sized).select("tree", "node", "n", "block"), "join-group-blocks")
    sides = _tasks(chosen, rule, "join-group-tasks")
    placed = chosen.join(sides, ["tree", "block"]).select("tree", "i", "j", "side", "node", "n").join(by_node.select("node", "bits"), "node")
    left = _sift(_dealt(placed), rule)
    return components(left.unionByName(groups.where("low is not null").select(F.col("node").alias("u"), F.col("low").alias("v"))))


def _compare(placed: DataFrame, rule: Rule) -> DataFrame:
    """placed: tree, i, j, side, node, items, sorted by (tree, i, j, side). u, v: spanning links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, group = None, ([], []), ([], [])

        def done():
            a, b = (group[0], group[1] or None) if key[1] != key[2] else (group[0], None)
            if key is None or not a or len(a) + len(b or []) < 2 or (key[1] != key[2] and not b):
                return []
            names = ids[0] + ids[1]
            return [(names[p], names[o]) for p, o in links(a, b, rule)]

        for batch in batches:
            found = []
            items = batch["items"]
            flat, off = items.values.to_numpy(zero_copy_only=False).view(np.uint64), items.offsets.to_numpy()
            for r, (tree, i, j, side, node) in enumerate(zip(*(batch[c].to_pylist() for c in ("tree", "i", "j", "side", "node")))):
                if (tree, i, j) != key:
                    if key is not None:
                        found += done()
                    key, ids, group = (tree, i, j), ([], []), ([], [])
                ids[side].append(node)
                group[side].append(flat[off[r]:off[r + 1]].copy())
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if key is not None and (found := done()):
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return placed.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    summary = common.written(_summaries(docs, rule), "join-sets")
    one = F.coalesce(F.min_by("mark", "doc_id"), F.min("mark"))
    by_node = common.written(
        summary.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), one.alias("rep_mark"), F.min("n").alias("n"), F.first("bits").alias("bits")), "join-nodes"
    )
    trees = common.written(_trees(docs, by_node, rule), "join-trees")
    reps = common.written(by_node.drop("bits").join(trees, "node").withColumnRenamed("comp", "tree"), "join-reps")
    chosen = common.written(_blocks(reps).select("tree", "node", "rep", "rep_mark", "n", "block"), "join-members")
    sides = _tasks(chosen, rule, "join-tasks")
    members = common.written(_members(docs, chosen.drop("n"), chosen.count(), rule).dropDuplicates(["node"]), "join-member-sets")
    placed = members.join(sides, ["tree", "block"]).select("tree", "i", "j", "side", "node", "items")
    found = components(_compare(_dealt(placed), rule))
    # first documents of classes of nodes, then of nodes: what meets on a large class or node is a table, whose join adaptive execution splits
    grouped = common.written(by_node.join(found, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("class")), "join-classes")
    first = common.written(grouped.groupBy("class").agg(F.min("rep").alias("first_id")), "join-firsts")
    of_node = common.written(grouped.join(first, "class").select("node", "first_id"), "join-first-of-node")
    return summary.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs without all but the first document of each class. Documents without an id come after all others and are told apart by
    their text; of equal ones a single row stays, unless the text has no word."""
    last = repeats.last_id(docs)
    keyed = docs.withColumn("__id", repeats.id_of(last))
    found = classes(keyed.select(F.col("__id").alias("doc_id"), "text"), rule)
    drop = found.where("doc_id != component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    left = keyed.join(drop, F.expr("__id = __dropped"), "left_anti")
    if last == repeats.LAST:
        return left.drop("__id")
    copies = F.col("doc_id").isNull() & (common.n_words(F.col("text")) > 0)
    once = left.where(copies).groupBy("__id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.where(~copies).drop("__id").unionByName(once)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"), Rule(words=3, num=90, den=100))


ORACLE = r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] end) as g from d),
c as materialized (select doc_id, len(g) as n, md5(array_to_string(list_sort(g), chr(10))) as k from s),
u as materialized (select min(doc_id) as doc_id, k, any_value(n) as n from c where n > 0 group by k),
e as materialized (select u.doc_id, n, unnest(g) as x from u join s on s.doc_id = u.doc_id),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as m from e a join e b on a.x = b.x and a.doc_id < b.doc_id and a.n * 100 >= 90 * b.n and b.n * 100 >= 90 * a.n group by 1, 2),
l as materialized (select a, b from p where 100 * m >= 90 * (an + bn - m)),
sym as materialized (select a, b from l union all select b, a from l),
reach(a, b) as (select doc_id, doc_id from u union select reach.a, sym.b from reach join sym on sym.a = reach.b),
m as (select a, min(b) as first from reach group by a)
select c.doc_id, c.n::bigint as n_shingles, case when c.n = 0 then c.doc_id else m.first end as component_id
from c left join u on c.k = u.k and c.n > 0 left join m on m.a = u.doc_id
"""
