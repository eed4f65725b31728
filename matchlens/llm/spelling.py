"""Spelling variants by composing finite-state machines: acceptor, one-edit transducer, acceptor.

Pairs of words at one edit are the paths of A o T o A, where A is the minimised acceptor of the vocabulary and T the transducer that copies but for one
inserted, deleted or replaced code point. The composition is enumerated per partition of initial states: T copies a shared part first (or last),
so every accepted pair of words of n and n (or n + 1) code points starts in the state that the first `SHARED` code points lead to or, if the edit is among
these, ends in the last n - `SHARED`. Words are dealt out by that part, each partition builds the minimal acceptor of what is left of its words and composes it. A
partition of more than `CROWD` words is cut again by halves of what is left, where each pair has one place again, until one code point is left: then its words
are no more than the alphabet allows. No pair leaves a task: a word's count of near words and its best one do.

Words are runs of letters, lower-cased in A-Z; see the contract of `vocabulary` for the deleted code points.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty string in the hash; a word of any length is compared whole; ties in n go to the
first word by code point; repeated rows count again; an empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN = r"[A-Za-zÀ-ÿ]+"
#: Of occurrences, about one in DROP_EVERY loses a code point.
DROP_EVERY = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Code points that a partition's pairs share; at most half of MIN_LENGTH.
SHARED = 3
#: Words of a partition; a larger one is cut again.
CROWD = 4000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(word: Column) -> Column:
    """A-Z alone in lower case. Words in ASCII, known by their number of bytes, take the faster way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: distinct words with their occurrences over all texts.

    Where `DROP_EVERY` divides the crc32 of `<doc_id>:<word>`, the occurrence loses the code point at that crc32 modulo its length.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(common.text_of(), F.lit(f"({RUN})"))).alias("w"))
    hashed = runs.select(lowered(F.col("w")).alias("w"), "id").withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w")))
    at = F.pmod("h", F.char_length("w")).cast("int")
    word = F.when(F.col("h") % DROP_EVERY == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))).otherwise(F.col("w"))
    counted = hashed.select(word.alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_LENGTH))


# A partition row: word, n, size (code points of the shorter words), lo, hi (what is left is [lo, hi) of these), and the shared parts before and after.
_PART = ["size", "lo", "hi", "head", "tail"]


def _middle(word: Column, long: Column) -> Column:
    return F.substring(word, F.col("lo") + 1, F.col("hi") - F.col("lo") + long)


def _cut(rows: DataFrame, at: Column) -> DataFrame:
    """Each row twice: in the partition that shares [lo, at) as well, and in the one that shares [at, hi) as well, where the edit is before `at`."""
    size = F.char_length("word")
    long = size - F.col("size")
    left = F.struct(at.alias("lo"), F.col("hi").alias("hi"), F.substring("word", F.lit(1), at).alias("head"), F.col("tail").alias("tail"))
    right = F.struct(F.col("lo").alias("lo"), at.alias("hi"), F.col("head").alias("head"), F.substring("word", at + 1 + long, size).alias("tail"))
    return rows.select("word", "n", "size", F.explode(F.array(left, right)).alias("part")).select("word", "n", "size", "part.*")


def partitions(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, _PART: each word in the partitions where it may have a near word; partitions of one word are left out."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where(F.col("size") >= MIN_LENGTH)
    rows = _cut(rows.withColumns({"lo": F.lit(0), "hi": F.col("size"), "head": F.lit(""), "tail": F.lit("")}), F.lit(SHARED))
    done = None
    while True:
        rows = common.written(rows, "spelling-parts")
        counts = common.written(rows.groupBy(*_PART).agg(F.count("*").alias("words")).where("words > 1"), "spelling-counts")
        large = (F.col("words") > crowd) & (F.col("hi") - F.col("lo") > 1)
        kept = rows.join(counts, _PART)
        fine = kept.where(~large).select("word", "n", *_PART)
        done = fine if done is None else done.unionByName(fine)
        if counts.where(large).isEmpty():
            return done
        rows = _cut(kept.where(large).select("word", "n", *_PART), F.expr("lo + (hi - lo) div 2"))


class Acceptor:
    """Minimal acyclic acceptors of sets of words of one length each, in one set of states; a state without arcs accepts."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.known: dict[tuple, int] = {}
        self.both: dict[tuple[int, int], list[str]] = {}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return at

    def add(self, words: list[str]) -> int:
        """The initial state for sorted, distinct words of one length: the path of the last word is open, states off it are minimal."""
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            k = 0
            while k < len(last) and last[k] == word[k]:
                k += 1
            self._close(path, last, k)
            path += [{} for _ in word[k:]]
            last = word
        self._close(path, last, 0)
        return self._state(path[0])

    def _close(self, path: list[dict[str, int]], word: str, to: int) -> None:
        for i in range(len(word) - 1, to - 1, -1):
            path[i][word[i]] = self._state(path.pop())

    def copied(self, p: int, q: int) -> list[str]:
        """What T may copy from here on: the words that both states accept."""
        if (p, q) not in self.both:
            a, b = self.arcs[p], self.arcs[q]
            if not a or not b:
                self.both[p, q] = [""] if not a and not b else []
            else:
                self.both[p, q] = [c + s for c in a if c in b for s in self.copied(a[c], b[c])]
        return self.both[p, q]

    def replaced(self, root: int) -> Iterator[tuple[str, str]]:
        """(x, y), both accepted from root, one code point replaced. Each pair once, both ways round."""
        todo = [("", root)]
        while todo:
            done, s = todo.pop()
            arcs = self.arcs[s]
            for c, p in arcs.items():
                todo.append((done + c, p))
                for d, q in arcs.items():
                    if c != d:
                        for rest in self.copied(p, q):
                            yield done + c + rest, done + d + rest

    def inserted(self, short: int, long: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """(x, y): y is x, accepted from short, with one code point inserted, as late as it can be; at_end: after the last one, too."""
        todo = [("", short, long)]
        while todo:
            done, p, q = todo.pop()
            mine = self.arcs[p]
            for d, after in self.arcs[q].items():
                if d in mine:
                    todo.append((done + d, mine[d], after))
                for rest in self.copied(p, after):
                    if rest[:1] != d and (rest or at_end):
                        yield done + rest, done + d + rest


def near_words(words: list[tuple[str, int]], size: int, lo: int, hi: int) -> list[tuple[str, int, int, str]]:
    """One partition's (word, n) -> (word, near words, the largest n among them, the first word with it); words without near ones are left out."""
    short = {w[lo:hi]: (w, n) for w, n in words if len(w) == size}
    long = {w[lo : hi + 1]: (w, n) for w, n in words if len(w) == size + 1}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), hi - lo + 2000))
    machine = Acceptor()
    roots = machine.add(sorted(short)), machine.add(sorted(long))
    found: dict[str, list] = {}

    def take(of: tuple[str, int], near: tuple[str, int]) -> None:
        best = found.setdefault(of[0], [0, 0, ""])
        best[0] += 1
        if near[1] > best[1] or (near[1] == best[1] and near[0] < best[2]):
            best[1:] = near[1], near[0]

    if short:
        for x, y in machine.replaced(roots[0]):
            take(short[x], short[y])
    if short and long:
        for x, y in machine.inserted(*roots, at_end=hi == size):
            take(short[x], long[y])
            take(long[y], short[x])
    return [(w, *b) for w, b in found.items()]


NEAR = "word string, n_near long, best_n long, best string"


def near(parts: DataFrame) -> DataFrame:
    """parts -> NEAR rows of each word and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["word", "n_near", "best_n", "best"], (pa.string(), pa.int64(), pa.int64(), pa.string())
        key, words, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)] or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for word, n, *part in zip(*[batch.column(c).to_pylist() for c in ("word", "n", *_PART)]):
                if part != key:
                    if len(words) > 1:
                        out += near_words(words, *key[:3])
                    key, words = part, []
                words.append((word, n))
            if out:
                yield flush()
        if len(words) > 1:
            out += near_words(words, *key[:3])
        yield flush()

    n = common.shuffle_partitions(parts.sparkSession)
    return parts.repartition(n, *_PART).sortWithinPartitions(*_PART).mapInArrow(run, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the last word on the way over forms. n grows RATIO-fold a step, so ways are short; each round doubles what is covered."""
    links = common.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("__from"), F.col("root").alias("__to"))
        joined = common.written(links.join(onward, links["root"] == onward["__from"], "left").select("word", F.coalesce("__to", "root").alias("root"), F.col("__to").isNotNull().alias("moved")), "spelling-roots")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return links


def variants(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """words: word, n (distinct words). Returns word, form, root, n, n_near, form_n."""
    found = near(partitions(words, crowd))
    # largest n first, then code-point order
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("w"), (-F.col("b.m")).alias("m"))
    joined = words.join(best, "word", "left")
    formed = F.col("m") >= F.lit(RATIO) * F.col("n")
    table = common.written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("w")).alias("form"), F.when(formed, F.col("m")).cast("long").alias("form_n")), "spelling-forms"
    )
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.written(vocabulary(common.table(spark, sf_dir, "documents")), "spelling-words"))


#: The 256 steps of crc32 for one byte, and the crc32 of a string column `s` by them, as DuckDB expressions.
CRC_STEPS = "crc as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::ubigint, [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) r(i)))"


def crc_sql(s: str) -> str:
    """crc32 of a string expression, beside the table crc."""
    hexed = f"hex(encode({s}))"
    byte = f"((instr('0123456789ABCDEF', {hexed}[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', {hexed}[2 * i + 2]) - 1)::ubigint"
    steps = f"list_prepend(4294967295::ubigint, list_transform(range(strlen({s})), lambda i: {byte}))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255::ubigint)::bigint + 1])), 4294967295::ubigint)"


ORACLE = f"""
with recursive {CRC_STEPS},
r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')) as w from documents),
d as (select id, translate(w, '{UPPER}', '{UPPER.lower()}') as w, count(*) as c from r group by all),
h as (select w, c, {crc_sql("(id || ':' || w)")}::bigint as h from d, crc),
v as (select case when h % {DROP_EVERY} = 0 then left(w, h % length(w)) || substring(w, h % length(w) + 2) else w end as word, sum(c)::bigint as n from h group by all),
words as (select word, n from v where n >= {MIN_COUNT} and length(word) >= {MIN_LENGTH}),
x as (select word, n, i, left(word, i - 1) || substring(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
ins as (select distinct x.word as a, u.word as b from x join words u on u.word = x.rest),
pairs as (select a, b from ins union all select b, a from ins union all select x.word, y.word from x join x y on x.rest = y.rest and x.i = y.i and x.word <> y.word),
nearby as (select a as word, count(*) as n_near, max(n) as m, min(b) filter (n = top) as best from (select pairs.*, n, max(n) over (partition by a) as top from pairs join words on word = b) group by a),
form as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * n then best end as form, case when m >= {RATIO} * n then m end as form_n from words left join nearby using (word)),
way as (select word, word as stop, form as next from form union all select way.word, form.word, form.form from way join form on form.word = way.next)
select word, form, stop as root, n, n_near, form_n from form join (select word, stop from way where next is null) using (word)
"""
