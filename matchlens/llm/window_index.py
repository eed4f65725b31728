"""Removal of words covered by a 20-word window that also starts earlier, over a log-structured fingerprint index.

The index holds what history has shown: for each run of windows (see repeats.py) its anchor, its tokens' fingerprint and the place
where it first stood. It is a folder with a manifest and tables, each of which is written once from one batch of documents,
bucketed by anchor and sorted by (anchor, fingerprint) within. A new batch is dealt out and laid out the same way and merged bucket by
bucket with the tables; the history is read where it lies, without a shuffle of its own. Equal entries decide windows at once; where
an anchor has several fingerprints the windows are decided on the words themselves. The batch's new entries become the next
table. Tables have levels: where the last `MAX_TABLES` are of one level, the merge, which has all of them in hand, writes one table of the next
level in their place, and so on up the levels. An entry is thus written once a level, and n batches make about log3(n) levels, whatever their sizes.
Another session opens the index by its folder and goes on; the catalog keeps no table of it.

Batches are taken in order of doc_id, so everything in the index is earlier than the batch.

Edge cases: null has no words; fewer than 20 words lose nothing; rows of one id are one document, and windows at the same place
of it aren't earlier than each other, so a repeated row loses nothing by its copy; documents without an id come after all
others and are no repeats of each other (2**63 - 1 counts as no id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats, vectors

WIDTH, GRAM = 20, 6
BATCHES = 3
#: Tables of one level.
MAX_TABLES = 2

COLUMNS = [c.split()[0] for c in repeats.RUNS.split(", ")]
MANIFEST = "version int, parts int, buckets int, tables array<string>, levels array<int>"


def kept_tables(levels: list[int]) -> tuple[int, int]:
    """(how many of the tables, oldest first, stay as they are, the level of the next one)."""
    keep, level = len(levels), 0
    while keep >= MAX_TABLES and levels[keep - MAX_TABLES : keep] == [level] * MAX_TABLES:
        keep, level = keep - MAX_TABLES, level + 1
    return keep, level


class Index:
    """An index in a folder: its tables, oldest first, all dealt into the same buckets. A folder with a manifest is opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.scratch(spark, "window-index")
        self.version, self.parts, self.buckets, self.files, self.levels = 0, common.shuffle_partitions(spark), repeats.buckets_for(spark), [], []
        self.tables: list[DataFrame] = []
        if path:
            try:
                last = spark.read.schema(MANIFEST).json(f"{path}/manifest-*").orderBy(F.desc("version")).first()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                last = None
            if last:
                self.version, self.parts, self.buckets, self.files = last.version, last.parts, last.buckets, list(last.tables)
                self.levels = list(last.levels)
                self.tables = [self._opened(f) for f in self.files]

    def _opened(self, file: str) -> DataFrame:
        name = f"window_index_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({MERGED.replace(': ', ' ')}) using parquet clustered by (bucket) into {self.parts} buckets location '{file}'")
        return self._taken(name)

    def _taken(self, name: str) -> DataFrame:
        """A bucketed table that is known by its files from here on; its name leaves the catalog, the files stay."""
        table = self.spark.table(name)
        self.spark.sql(f"drop table {name}")
        return table

    def add(self, merged: DataFrame) -> DataFrame:
        """Writes a merge's result as a table, which comes after those that stay; the manifest names what counts."""
        keep, level = kept_tables(self.levels)
        file = f"{self.path}/table-{uuid.uuid4().hex}"
        name = f"window_index_{uuid.uuid4().hex}"
        with common.shuffles_freed(self.spark):
            merged.write.format("parquet").bucketBy(self.parts, "bucket").option("path", file).saveAsTable(name)
        table = self._taken(name)
        self.files, self.tables, self.levels = [*self.files[:keep], file], [*self.tables[:keep], table], [*self.levels[:keep], level]
        self.version += 1
        row = (self.version, self.parts, self.buckets, self.files, self.levels)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{self.path}/manifest-{self.version:06d}")
        return table


def _entries(s: repeats.Sorted, bucket: int, pick: np.ndarray, table: int) -> pa.RecordBatch:
    k = s.key[pick]
    row = (bucket, table, vectors.pack((k >> np.uint64(16)).astype(np.uint32)), vectors.pack((k & np.uint64(0xFFFF)).astype(np.uint16)),
           vectors.pack(s.content[pick]), vectors.pack(s.doc[pick], True), vectors.pack(s.lo[pick]), vectors.pack(s.len[pick]), vectors.pack(s.context[pick]))
    return repeats.packed_batch([[x] for x in row])


MERGED = f"{repeats.RUNS}, found array<struct<doc_id:long,lo:int,hi:int,check:int,key:long>>"


def add_batch(index: Index, docs: DataFrame, w: repeats.Windows) -> DataFrame:
    """Decides the batch's runs against the index, adds its new entries, and returns FOUND rows (open runs may be history's)."""
    keep, _ = kept_tables(index.levels)
    rows = repeats.run_rows(docs, w, index.buckets).repartition(index.parts, "bucket")
    for table in index.tables:
        rows = rows.unionByName(table.select(*COLUMNS))

    def merge(group: pa.Table) -> pa.Table:
        packed = group.to_pylist()
        s = repeats.sort_runs(packed)
        new = _entries(s, packed[0]["bucket"], s.new_content & ((s.table < 0) | (s.table >= keep)), keep)
        found = repeats.found_batch(s, *repeats.decide(s, w), packed)
        structs = pa.StructArray.from_arrays([found[c] for c in found.schema.names], names=found.schema.names)
        lists = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
        return pa.Table.from_arrays([*new.columns, lists], names=[*new.schema.names, "found"])

    # tables are bucketed as the batch is dealt out: only the batch is shuffled
    table = index.add(rows.groupBy("bucket").applyInArrow(merge, MERGED))
    return table.select(F.explode("found").alias("f")).select("f.*")


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs cut into n ranges of ids of about equal size, in order; documents without an id come last."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    out = []
    for i in range(len(cuts) + 1):
        low = F.col("doc_id") > cuts[i - 1] if i else F.lit(True)
        high = F.col("doc_id") <= cuts[i] if i < len(cuts) else F.lit(True)
        out.append(docs.where((low & high) | F.col("doc_id").isNull() if i == len(cuts) else low & high & F.col("doc_id").isNotNull()))
    return out


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_tokens (words), n_removed, n_spans, kept (the remaining words, one space between) of every document."""
    w = repeats.Windows(width, gram, words=True, same_document=True, last=repeats.last_id(docs))
    index, found = Index(docs.sparkSession), None
    for batch in batches_of(docs, batches):
        one = add_batch(index, batch, w)
        found = one if found is None else found.unionByName(one)
    windows = common.written(repeats.ranked(repeats.open_windows(docs, found.where("key is not null").distinct(), w), w), "index-windows")
    return repeats.removed(docs, found.where("key is null").unionByName(windows), w)


def op9_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, len(w) as n, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20)),
f as (select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 as again from s),
t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
g as (select t.doc_id, t.i, word, coalesce(max(f.again::int) over (partition by t.doc_id order by t.i rows between 19 preceding and current row), 0) as gone
      from t left join f on t.doc_id = f.doc_id and t.i = f.i)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from g group by doc_id) x using (doc_id)
"""
