"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character 4-grams, if any of
them is known, else to its 3-grams, and so on down to single characters; the n-grams of the length that is used are averaged, so that
a word weighs as one word however it is scored. A text's language is the one with the largest sum.

Learning is bounded by its sample: at most about `SAMPLE_DOCS` labelled documents a language, chosen by hash. All words and n-grams
of the sample are learnt, those seen once too; Spark counts them. The table of them has the size of the sample's vocabulary, whatever the
corpus's; it passes the driver as Arrow bytes and is broadcast, and a worker makes the scores of it once, for all of its tasks. `entries`
cuts the table to the most frequent terms where a smaller one is wanted. A word is a run of letters (Unicode category L) in learning
and in prediction.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learnt; ties
go to the first language in code point order; rows with a null lang teach nothing; a null doc_id is not held out; repeated
rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
SAMPLE_DOCS = 4000
MAX_N = 4
SMOOTHING = 0.5
#: Words of which a worker keeps the score at hand; emptied when full.
CACHE = 100_000
#: Runs of letters and of number signs, which `\w` takes besides decimal digits and the underscore.
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    words = LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text of about per_language documents of each language, the same ones in every run."""
    rows = labelled.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # one row a language
    return rows.join(F.broadcast(counts), "lang").where(share < F.lit(float(per_language)) / F.col("n")).select("lang", "text")


def count_terms(texts: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """lang, n, term, c: words (n = 0) and character n-grams of the words, counted over the sample."""
    words = (
        texts.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term != ''")
        .groupBy("lang", "term").agg(F.count("*").alias("c"))
    )
    marked = F.concat(F.lit(" "), F.col("term"), F.lit(" "))

    def grams_of(n: int) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
        # a word of one letter has no 4-gram
        return words.where(F.length("term") >= n - 2).select("lang", F.lit(n).alias("n"), "c", F.explode(parts).alias("term")).where(F.trim("term") != "")

    out = words.select("lang", F.lit(0).alias("n"), "c", "term")
    for n in range(1, max_n + 1):
        out = out.unionByName(grams_of(n))
    return out.groupBy("lang", "n", "term").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    """languages; per n (0: words) and language the number of terms and of kinds of terms; the table n, term, lang, c as compressed Arrow bytes; its name."""

    langs: list[str]
    sizes: np.ndarray
    terms: bytes
    name: str


def learn(labelled: DataFrame, per_language: int = SAMPLE_DOCS, entries: int | None = None, max_n: int = MAX_N) -> Model:
    """The model of a sample of about per_language documents a language. entries: of so many terms over all languages and lengths only
    (100 of each at least), the most frequent ones; None: of all."""
    terms = common.written(count_terms(sample(labelled, per_language), max_n), "lang-terms")
    totals = terms.groupBy("lang", "n").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).collect()
    langs = sorted({r["lang"] for r in totals})
    sizes = np.zeros((max_n + 1, len(langs), 2))
    for r in totals:
        sizes[r["n"], langs.index(r["lang"])] = r["total"], r["kinds"]
    if entries is not None:
        each = max(100, entries // (max(1, len(langs)) * (max_n + 1)))
        best = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "term")
        terms = terms.withColumn("r", F.row_number().over(best)).where(F.col("r") <= each)
    table = terms.select("n", "term", "lang", "c").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return Model(langs, sizes, sink.getvalue().to_pybytes(), uuid.uuid4().hex)


class Terms:
    """Rows of terms, counted from `first`, in arrays: a dict of strings takes six times as much in each worker. Found by hash, then compared."""

    def __init__(self, terms: pa.StringArray, first: int):
        hashes = np.fromiter((hash(t.as_py()) for t in terms), np.int64, len(terms))
        order = np.argsort(hashes, kind="stable")
        ends = np.cumsum(pc.binary_length(terms).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.first, self.hashes, self.rows, self.at, self.data = first, array("q"), array("i"), array("q", [0]), b""
        self.hashes.frombytes(hashes[order].tobytes())
        self.rows.frombytes(order.astype(np.int32).tobytes())
        self.at.frombytes(ends.tobytes())
        if len(terms):
            start = np.frombuffer(terms.buffers()[1], np.int32, 1, 4 * terms.offset)[0]
            self.data = terms.buffers()[2][int(start):int(start + ends[-1])].to_pybytes()

    def __len__(self) -> int:
        return len(self.rows)

    def get(self, term: str) -> int | None:
        h = hash(term)
        i = bisect_left(self.hashes, h)
        while i < len(self.hashes) and self.hashes[i] == h:
            k = self.rows[i]
            if self.data[self.at[k]:self.at[k + 1]] == term.encode():
                return self.first + k
            i += 1
        return None


class Scorer:
    """tables: per n (0: words) the row of each term in scores, its log frequency in each language."""

    def __init__(self, model: Model):
        self.langs, self.tables, scores = model.langs, [], [np.zeros((0, len(model.langs)))]
        table, langs, rows = pa.ipc.open_stream(model.terms).read_all(), pa.array(model.langs, pa.string()), 0
        for n, size in enumerate(model.sizes):
            part = table.filter(pc.equal(table["n"], n))
            term = part["term"].cast(pa.string()).combine_chunks().dictionary_encode()
            c = np.zeros((len(term.dictionary), len(self.langs)))
            c[term.indices.to_numpy(), pc.index_in(part["lang"], langs).to_numpy()] = part["c"].to_numpy()
            c += SMOOTHING
            c /= size[:, 0] + SMOOTHING * (size[:, 1] + 1)
            scores.append(np.log(c, out=c))
            self.tables.append(Terms(term.dictionary, rows))
            rows += len(c)
            del part, term, c
        del table
        self.scores = np.concatenate(scores)
        del scores
        # what the table took goes back before texts are scored
        pa.default_memory_pool().release_unused()
        self.rows = np.zeros((CACHE, max(1, len(self.langs))))
        self.at: dict[str, int] = {}

    def known(self, w: str) -> list[int]:
        """Rows of scores whose mean is the word's: its own, or those of its longest known n-grams."""
        if (k := self.tables[0].get(w)) is not None:
            return [k]
        marked = f" {w} "
        for n in range(len(self.tables) - 1, 0, -1):
            get = self.tables[n].get
            if found := [k for i in range(len(marked) - n + 1) if (k := get(marked[i:i + n])) is not None]:
                return found
        return []

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        counts = Counter(words)
        total = np.zeros(len(self.langs))
        items = list(counts.items())
        for a in range(0, len(items), CACHE // 2):
            part = items[a:a + CACHE // 2]
            if len(self.at) + len(part) > CACHE:
                self.at.clear()
            at, rows, where, new, flat, sizes = self.at, self.rows, [], [], [], []
            for w, _ in part:
                k = at.get(w)
                if k is None:
                    k = at[w] = len(at)
                    found = self.known(w)
                    new.append(k)
                    flat += found
                    sizes.append(len(found))
                where.append(k)
            if new:
                n = np.array(sizes)
                sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(self.scores[flat], axis=0)])
                rows[new] = (sums[np.cumsum(n)] - sums[np.cumsum(n) - n]) / np.maximum(n, 1)[:, None]
            total += np.fromiter((c for _, c in part), float, len(part)) @ rows[where]
        p = np.exp((total - total.max()) / math.sqrt(len(words)))
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


#: The scorer of a worker's last model, by the model's name.
_LAST: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    if model.name not in _LAST:
        _LAST.clear()
        _LAST[model.name] = Scorer(model)
    return _LAST[model.name]


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns `keep` plus lang_pred and score. Only the text is an input of the prediction."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch["__text"]]
            cols = [batch[c] for c in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = learn(docs.where(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
