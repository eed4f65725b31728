"""Shared groundwork of the two repeat removers: which fixed-length windows of a text occur elsewhere before.

Rows for every window would be as many as there are tokens, so windows travel in runs. A window's anchor is its `gram` tokens with
the least hash; equal windows have equal anchors at equal distance, wherever they stand. Consecutive windows of one anchor form a
run, about one for every eight words or fourteen bytes.

1. Runs are dealt out by their anchor's hash, as packed columns, and sorted by it. Runs with the same tokens are repeats as a whole: all
   but the first are decided. What a task finds repeated among its own runs is decided before the shuffle, so of a text that
   stands in very many documents each task hands on one run only.
2. Where one anchor has runs with different tokens, their first ones stay open: some windows may be shared, others not. Only
   the halves of such a run stay open whose next ranks (the anchor with half the rest before or after it) another one shares.
3. Each open window is a row: the rank of its first half, the rank at the offset of its second half, its place. What a task finds
   equal among its own rows is decided before the shuffle, so a passage of very many documents sends one row a task and gather;
   Spark sorts the rank pairs of all others, and one pass over them finds the windows that stand elsewhere before.
4. Decided windows go back to their documents as intervals, each with a check sum of its tokens.

Every step deals out by hash over all tasks; what a task holds at once is a bucket of runs or one gather of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors

#: Runs that a task gathers before it hands them on in packed form.
GATHER = 150_000
#: Buckets of anchors a shuffle partition.
BUCKETS_EACH = 8
#: Documents without an id count as the last ones.
LAST = int(np.iinfo(np.int64).max)

#: Open windows that a task gathers, to decide equal ones before the shuffle.
WINDOWS_GATHERED = 200_000
#: Marks packed rows of runs that were decided before the shuffle; rows of at most so many.
LOCAL, LOCAL_ROWS = -2, 20_000

RUNS = "bucket int, run int, key32 binary, key16 binary, content binary, doc binary, lo binary, len binary, context binary"
#: key: null of decided windows; of open ones which halves are open (bits 0 and 1) and how far after the first window its anchor is.
FOUND = "doc_id long, lo int, hi int, check int, key long"
#: b: half the bits of a rank, and the check sum.
WINDOWS = "known boolean, a long, b long, doc_id long, lo int, body binary"


@dataclass(frozen=True)
class Windows:
    """width, gram: in tokens. Tokens are bytes or words. same_document: repeats within a document count.

    last: the greatest id; what is beyond names documents without one, which are no earlier documents to each other.
    """

    width: int
    gram: int
    words: bool
    same_document: bool
    last: int = LAST

    @property
    def half(self) -> int:
        """Windows whose anchor is at least so far in have at least so much before it, the others at least as much after it."""
        return (self.width - self.gram) // 2


def last_id(docs: DataFrame) -> int:
    """The greatest id (0 at least), if there are documents without one; else LAST."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    most, none = ids.agg(F.max("i"), F.count_if(F.col("i").isNull())).first()
    return min(max(most or 0, 0), LAST - 1) if none else LAST


def id_of(last: int) -> Column:
    """A document's id. Without one: LAST, or, if `last` leaves room, a number beyond it that only equal texts share."""
    own = F.lit(last + 1) + F.pmod(F.xxhash64("text"), F.lit(LAST - last)) if last < LAST else F.lit(LAST)
    return F.coalesce(F.col("doc_id").cast("long"), own)


def later(new: np.ndarray, doc: np.ndarray, lo: np.ndarray, w: Windows) -> np.ndarray:
    """Of equal entries (groups begin where new holds, sorted by document and place within): those that an earlier document or place
    has too. The same place of the same document isn't earlier: rows may be repeated."""
    first = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = (first < doc) & (first <= w.last)
    if w.same_document:
        own = new.copy()
        own[1:] |= doc[1:] != doc[:-1]
        out |= lo > lo[np.flatnonzero(own)[np.cumsum(own) - 1]]
    return out


def _tokens(data: np.ndarray, off: np.ndarray, w: Windows):
    """(where each row's tokens begin, anchor hashes from each token on, hash of token spans, bytes of a token span)."""
    if w.words:
        starts, ends, first = vectors.words(data, off)
        # anchors and contents are made from two hashes of a word: words that one takes for equal the other still tells apart
        grams = vectors.chain(vectors.word_hashes(data, starts, ends, 41), w.gram, 42)
        h = vectors.word_hashes(data, starts, ends, 51)
        raw = data.tobytes()
        spans = lambda a, b: vectors.token_span_hashes(h, a, b, 43)
        text = lambda a, b: b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())])
    else:
        first, grams, raw = off, vectors.window_hashes(data, w.gram, 42), data.tobytes()
        spans = lambda a, b: vectors.span_hashes(data, a, b, 43)
        text = lambda a, b: raw[a:b]
    total = int(first[-1])
    grams = np.concatenate([grams, np.zeros(max(0, total - len(grams)), np.uint64)])[:total]
    return first, grams, spans, text


def contexts(spans, lo: np.ndarray, at: np.ndarray, total: int, w: Windows) -> np.ndarray:
    """Of each run 5 bits for half the rest before its anchor, 5 for that after it, and the anchor's distance. Few bits
    only leave a few more halves open."""
    before = spans(np.maximum(at - w.half, 0), at) & np.uint64(31)
    after = spans(np.minimum(at + w.gram, total), np.minimum(at + w.gram + w.half, total)) & np.uint64(31)
    return before | (after << np.uint64(5)) | ((at - lo).astype(np.uint64) << np.uint64(10))


def decided_among(key: np.ndarray, content: np.ndarray, doc: np.ndarray, lo: np.ndarray, w: Windows) -> np.ndarray:
    """Runs whose tokens stand in an earlier one of these runs."""
    order = np.lexsort((lo, doc, content, key))
    k, c = key[order], content[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    out = np.zeros(len(key), bool)
    out[order] = later(new, doc[order], lo[order], w)
    return out


def run_rows(docs: DataFrame, w: Windows, buckets: int) -> DataFrame:
    """All runs of docs (doc_id, text), packed by bucket; those decided here in rows of their own (run = LOCAL), in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, spread = [], 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal spread
            key, content, doc, lo, n, context = (np.concatenate(x) for x in zip(*parts))
            known = decided_among(key, content, doc, lo, w)
            at = np.flatnonzero(known)
            at = at[np.lexsort((lo[at], doc[at]))]
            local = (doc[at], lo[at].astype(np.int32), n[at].astype(np.int32), (content[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            key, content, doc, lo, n, context = (x[~known] for x in (key, content, doc, lo, n, context))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((lo, doc, bucket))
            key, content, doc, lo, n, context, bucket = (x[order] for x in (key, content, doc, lo, n, context, bucket))
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            cols: list[list] = [[] for _ in range(9)]
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
                k = key[a:b]
                row = (int(bucket[a]), -1, vectors.pack((k >> np.uint64(32)).astype(np.uint32)), vectors.pack((k >> np.uint64(16)).astype(np.uint16)),
                       vectors.pack(content[a:b]), vectors.pack(doc[a:b], True), vectors.pack(lo[a:b].astype(np.int32)), vectors.pack(n[a:b].astype(np.int32)), vectors.pack(context[a:b]))
                for c, x in zip(cols, row):
                    c.append(x)
            for a in range(0, len(at), LOCAL_ROWS):
                d, first, length, check = (x[a : a + LOCAL_ROWS] for x in local)
                spread += 1
                row = (spread * 7919 % buckets, LOCAL, b"", b"", vectors.pack(check), vectors.pack(d, True), vectors.pack(first), vectors.pack(length), b"")
                for c, x in zip(cols, row):
                    c.append(x)
            return packed_batch(cols)

        for batch in batches:
            for rows, data, off in vectors.pieces(batch, "text"):
                first, grams, spans, _ = _tokens(data, off, w)
                row, lo, hi, at = vectors.anchored_runs(grams, first, w.width, w.gram)
                if not len(row):
                    continue
                ids = rows["doc_id"].to_numpy()
                parts.append((grams[at], spans(lo, hi + w.width), ids[row], lo - first[row], hi - lo + 1, contexts(spans, lo, at, int(first[-1]), w)))
                held += len(row)
                if held >= GATHER:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    common.small_batches(docs.sparkSession)
    return docs.select(id_of(w.last).alias("doc_id"), "text").mapInArrow(run, RUNS)


def packed_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "run", "key32", "key16", "content", "doc", "lo", "len", "context"])


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """key (48 bits and the bucket tell anchors apart), content, doc, lo, len, context of a packed row."""
    key = (vectors.unpack(row["key32"], np.uint32).astype(np.uint64) << np.uint64(16)) | vectors.unpack(row["key16"], np.uint16)
    return key, vectors.unpack(row["content"], np.uint64), vectors.unpack(row["doc"], np.int64, True), vectors.unpack(row["lo"], np.int32), vectors.unpack(row["len"], np.int32), vectors.unpack(row["context"], np.uint64)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packed rows of each bucket, from batches sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if held:
                    yield bucket, held
                bucket, held = row["bucket"], []
            held.append(row)
    if held:
        yield bucket, held


@dataclass
class Sorted:
    """The runs of a bucket in order of (key, content, document, place), with group marks. table: which table of an index has a run, -1 for new ones."""

    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    len: np.ndarray
    context: np.ndarray
    table: np.ndarray
    new_content: np.ndarray
    key_no: np.ndarray

    @property
    def old(self) -> np.ndarray:
        return self.table >= 0


def sort_runs(rows: list[dict]) -> Sorted:
    rows = [r for r in rows if r["run"] != LOCAL]
    parts = [(*unpacked(r), np.full(len(r["key32"]) // 4, r["run"], np.int16)) for r in rows]
    parts = parts or [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint64, np.int16))]
    key, content, doc, lo, n, context, table = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, doc, content, key))
    key, content, doc, lo, n, context, table = (x[order] for x in (key, content, doc, lo, n, context, table))
    new_key, new_content = np.ones(len(key), bool), np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_content[1:] = new_key[1:] | (content[1:] != content[:-1])
    return Sorted(key, content, doc, lo, n, context, table, new_content, np.cumsum(new_key) - 1)


def decide(s: Sorted, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(decided, open) runs of a bucket; open: 0 or its open halves and distance (see FOUND). Runs that an index already holds (old)
    are open again if a new one joins their anchor."""
    if not len(s.key):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    first = np.flatnonzero(s.new_content)
    decided = later(s.new_content, s.doc, s.lo, w)
    undecided = ~decided
    contents = np.bincount(s.key_no, s.new_content)
    several = contents[s.key_no] > 1
    if not w.same_document:
        low = np.full(len(contents), LAST)
        high = np.zeros(len(contents), np.int64)
        np.minimum.at(low, s.key_no[first], s.doc[first])
        np.maximum.at(high, s.key_no[first], s.doc[first])
        several &= (high > low)[s.key_no]
    fresh = np.bincount(s.key_no, ~s.old)
    return decided & ~s.old, _halves(s, undecided & several & (fresh > 0)[s.key_no], w)


def _halves(s: Sorted, candidates: np.ndarray, w: Windows) -> np.ndarray:
    """Which halves of the candidates stay open: windows with the anchor late share all of `half` bytes before it with whatever they
    equal, the others as many after it. A half whose rank no other document (or place, if these count) shares drops out."""
    far = (s.context >> np.uint64(10)).astype(np.int64)
    near = far - s.len + 1
    out = np.zeros(len(far), np.int64)
    for bit, has, shift in ((1, far >= w.half, 0), (2, near < w.half, 5)):
        at = np.flatnonzero(candidates & has)
        if len(at):
            _, group = np.unique((s.key_no[at] << 5) | ((s.context[at] >> np.uint64(shift)) & np.uint64(31)).astype(np.int64), return_inverse=True)
            low, high = np.full(group.max() + 1, LAST), np.zeros(group.max() + 1, np.int64)
            np.minimum.at(low, group, s.doc[at])
            np.maximum.at(high, group, s.doc[at])
            shared = np.bincount(group) > 1 if w.same_document else high > low
            out[at] |= np.where(shared[group], bit, 0)
    return np.where(out > 0, out | (far << 2), 0)


def found_batch(s: Sorted, decided: np.ndarray, still_open: np.ndarray, rows: list[dict]) -> pa.RecordBatch:
    """FOUND rows of a bucket: its decided and open runs, and those that were decided before the shuffle."""
    local = [r for r in rows if r["run"] == LOCAL]
    at = np.concatenate([np.flatnonzero(decided), np.flatnonzero(still_open)])
    nd = int(decided.sum())
    key = still_open[at]
    check = (s.content[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    more = lambda name, kind, delta=False: [vectors.unpack(r[name], kind, delta) for r in local]
    lo, length = more("lo", np.int32), more("len", np.int32)
    n = len(at) + sum(map(len, lo))
    doc_id = np.concatenate([s.doc[at], *more("doc", np.int64, True)])
    first = np.concatenate([s.lo[at], *lo])
    last = first + np.concatenate([s.len[at], *length]) - 1
    check = np.concatenate([check, *[c.view(np.int32) for c in more("content", np.uint32)]])
    key = np.concatenate([key, np.zeros(n - len(at), np.int64)])
    unnamed = (np.arange(n) < nd) | (np.arange(n) >= len(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(check), pa.array(key, mask=unnamed)],
        names=["doc_id", "lo", "hi", "check", "key"],
    )


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(common.shuffle_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def buckets_for(spark) -> int:
    return BUCKETS_EACH * common.shuffle_partitions(spark)


def find_runs(docs: DataFrame, w: Windows) -> DataFrame:
    """FOUND rows: decided runs (key null) and open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            s = sort_runs(rows)
            yield found_batch(s, *decide(s, w), rows)

    return dealt(run_rows(docs, w, buckets_for(docs.sparkSession))).mapInArrow(run, FOUND)


def _texts(docs: DataFrame, w: Windows) -> DataFrame:
    return docs.select(id_of(w.last).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")


def _per_document(found: DataFrame) -> DataFrame:
    """A document's intervals in one array: no longer than the document."""
    return found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("lo", "hi", "check", "key")).alias("found"))


def _lists(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row (counted from a) and fields of the intervals of rows a to b."""
    lists = batch["found"].slice(a, b - a)
    n = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    get = lambda name: flat.field(name).fill_null(0).to_numpy()
    return np.repeat(np.arange(b - a), n), {k: get(k) for k in ("lo", "hi", "check", "key")}


def _checked(batch: pa.RecordBatch, w: Windows):
    """Pieces of a joined batch: rows, data, offsets, tokens, and the intervals whose check sum holds, by row and absolute place."""
    at = 0
    for rows, data, off in vectors.pieces(batch, "text"):
        first, _, spans, text = tokens = _tokens(data, off, w)
        row, f = _lists(batch, at, at + rows.num_rows)
        at += rows.num_rows
        lo, hi = first[row] + f["lo"], first[row] + f["hi"]
        fits = hi + w.width <= first[1:][row]  # else it stems from another text of this id
        row, lo, hi, check, key = (x[fits] for x in (row, lo, hi, f["check"], f["key"]))
        good = (spans(lo, hi + w.width) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) == check
        yield rows, data, off, tokens, row[good], lo[good], hi[good], key[good]


def open_windows(docs: DataFrame, open_runs: DataFrame, w: Windows) -> DataFrame:
    """WINDOWS rows of the open runs' windows: a, b are the ranks (hashes) of its first half and of its second, at the offset of half its
    width (b holds the check sum of the whole besides); body its words. known: decided among the rows that a task gathers."""
    step = w.width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bodies, held = [], [], 0

        def out() -> pa.RecordBatch:
            a, b, doc, lo = (np.concatenate(x) for x in zip(*parts))
            body = pa.array([x for part in bodies for x in part], pa.binary()) if w.words else pa.nulls(len(a), pa.binary())
            # of words the words themselves are compared
            name = body.dictionary_encode().indices.to_numpy().astype(np.uint64) if w.words else a
            known = decided_among(name, name if w.words else b, doc, lo, w)
            a = np.where(known, vectors.mix(doc.astype(np.uint64), 81) + lo.astype(np.uint64), a)  # known rows only pass by, in any task
            return pa.RecordBatch.from_arrays(
                [pa.array(known), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array(lo), pc.if_else(pa.array(known), pa.scalar(None, pa.binary()), body)],
                names=["known", "a", "b", "doc_id", "lo", "body"],
            )

        for batch in batches:
            for rows, _, _, (first, _, spans, text), row, lo, hi, key in _checked(batch, w):
                n = hi - lo + 1
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                row, key, far = np.repeat(row, n), np.repeat(key & 3, n), np.repeat((key >> 2) + lo, n) - at
                mine = (np.where(far >= w.half, 1, 2) & key) > 0
                at, row = at[mine], row[mine]
                if not len(at):
                    continue
                low = np.uint64(0xFFFFFFFF)
                b = (spans(at + w.width - step, at + w.width) & ~low) | (spans(at, at + w.width) & low)
                parts.append((spans(at, at + step), b, rows["doc_id"].to_numpy()[row], (at - first[row]).astype(np.int32)))
                if w.words:
                    bodies.append([text(x, x + w.width) for x in at.tolist()])
                held += len(at)
                if held >= WINDOWS_GATHERED:
                    yield out()
                    parts, bodies, held = [], [], 0
        if parts:
            yield out()

    joined = _texts(docs, w).join(_per_document(open_runs), F.expr("doc_id = d")).select("doc_id", "no_id", "text", "found")
    return joined.mapInArrow(run, WINDOWS)


def ranked(windows: DataFrame, w: Windows) -> DataFrame:
    """FOUND rows of the windows that stand elsewhere before. Spark sorts the rank pairs; equal ones follow each other, the earliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # of the pair that the last batch ended with: its first row, and the first of its last document
        for batch in batches:
            known = batch["known"].to_numpy(zero_copy_only=False)
            t = pa.Table.from_batches([batch.filter(pa.array(~known))])
            lead = 0
            if carried is not None:
                t, lead = pa.concat_tables([carried, t]).combine_chunks(), len(carried)
            hit = np.zeros(0, bool)
            if len(t):
                a, b, doc, lo = (t[c].to_numpy() for c in ("a", "b", "doc_id", "lo"))
                new = np.ones(len(t), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                hit = later(new, doc, lo, w)
                if w.words:
                    first = np.flatnonzero(new)[np.cumsum(new) - 1]
                    hit &= pc.equal(t["body"].combine_chunks(), t["body"].take(pa.array(first)).combine_chunks()).to_numpy(zero_copy_only=False)
                hit[:lead] = False
                start = int(np.flatnonzero(new)[-1])
                own = start + int(np.flatnonzero(doc[start:] == doc[-1])[0])
                carried = t.take(pa.array(sorted({start, own})))
            found = pa.concat_tables([pa.Table.from_batches([batch.filter(pa.array(known))]), t.filter(pa.array(hit))]) if len(t) else pa.Table.from_batches([batch.filter(pa.array(known))])
            for x in found.combine_chunks().to_batches():
                check = pa.array(x["b"].to_numpy().astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([x["doc_id"], x["lo"], x["lo"], check, pa.nulls(len(x), pa.int64())], names=["doc_id", "lo", "hi", "check", "key"])

    spread = windows.repartition(common.shuffle_partitions(windows.sparkSession), "a").sortWithinPartitions("a", "b", "doc_id", "lo")
    return spread.mapInArrow(run, FOUND)


def removed(docs: DataFrame, found: DataFrame, w: Windows) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept (text without the removed tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off, (first, _, _, text), _, lo, hi, _ in _checked(batch, w):
                total = int(first[-1])
                mark = np.bincount(lo, minlength=total + 1) - np.bincount(hi + w.width, minlength=total + 1)[: total + 1]
                gone = np.cumsum(mark[:total]) > 0
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[first[:-1][first[:-1] < total]] |= gone[first[:-1][first[:-1] < total]]
                n_begin = np.concatenate([[0], np.cumsum(begin)])
                kept = []
                if w.words:
                    starts, ends, _ = vectors.words(data, off)
                    raw = data.tobytes()
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                        k = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[k].tolist(), ends[k].tolist())]))
                else:
                    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["no_id"], pa.array(np.diff(first)), pa.array(np.diff(n_gone[first])), pa.array(np.diff(n_begin[first])), pa.array(kept, pa.binary())],
                    names=["doc_id", "no_id", "n_tokens", "n_removed", "n_spans", "kept"],
                )

    joined = _texts(docs, w).join(_per_document(found), F.expr("doc_id = d"), "left").select("doc_id", "no_id", "text", "found")
    out = joined.mapInArrow(run, "doc_id long, no_id boolean, n_tokens long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
