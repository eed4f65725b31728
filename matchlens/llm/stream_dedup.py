"""Exact deduplication as a stateful stream: keyed state on disk that never expires.

Documents arrive in micro-batches. State (RocksDB, checkpointed in the shared folder, without a timer or watermark) holds an entry a distinct text: its digest,
the largest id so far as the stable identifier, the number of rows, and where its bytes lie in a content store (file, offset, length).
A text whose digest is known is compared with the stored bytes in full; texts that differ under one digest are classes of their own. What the state says last of a class is the result,
and a later call on the same folder goes on where the state stands.

Before the shuffle each task merges equal texts (compared in full, over a bounded cache), so a group of copies of any size sends a text a task and some ids. State
is keyed by (bucket, digest): an entry is a RocksDB row of its own; buckets only deal out work.

Edge cases: a null text is an empty one, and empty texts are copies of each other; rows without an id have copies like others and stay (keep_id null) only
where none of the copies has an id; of rows that repeat an id and a text one is kept; very long texts are hashed, kept and compared whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import common

#: Groups that state is dealt out by; fixed for the life of a folder.
BUCKETS = 4096
#: A task's cache of texts to merge copies with, and of a bucket's contents read back: bytes. Ids sent with a text at most.
CACHE_BYTES, SENT_IDS = 16 << 20, 10_000
#: Contents are written in files of about this size.
FILE_BYTES = 32 << 20
#: Micro-batches that the query deals the table's files to.
BATCHES = 3
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # else each state partition reserves megabytes of disk ahead of its few entries
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
MERGED = "bucket long, digest binary, text binary, ids array<long>"
ASSIGNED = "digest binary, no int, ids array<long>, keep long, size long, raised boolean"
KEY, ENTRY = "digest binary, no int", "keep long, size long, file string, off long, len long"


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def merge_copies(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> MERGED: equal texts of a task are one row as long as they are in the cache."""
    cache: OrderedDict[bytes, list] = OrderedDict()
    held, out = 0, []

    def send(text: bytes, ids: list) -> None:
        d = digest(text)
        out.append((int.from_bytes(hashlib.blake2b(d, digest_size=6).digest()) % BUCKETS, d, text, ids))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["bucket", "digest", "text", "ids"]
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = (text or "").encode()
            ids = cache.get(text)
            if ids is None:
                cache[text] = [doc_id]
                held += len(text) + 200
            else:
                ids.append(doc_id)
                cache.move_to_end(text)
                if len(ids) >= SENT_IDS:
                    send(text, cache.pop(text))
                    held -= len(text) + 200
            while held > CACHE_BYTES:
                old, ids = cache.popitem(last=False)
                held -= len(old) + 200
                send(old, ids)
        if out:
            yield flushed()
    while cache:
        send(*cache.popitem(last=False))
        if len(out) >= 1000 or not cache:
            yield flushed()


class Contents:
    """Bytes of texts in files of the shared folder. Files of attempts that failed stay behind unread, since no state names them."""

    def __init__(self, where: str):
        self.where, self.codec = where, pa.Codec("zstd", 1)
        self._new()

    def _new(self) -> None:
        self.name, self.size = f"{uuid.uuid4().hex}.texts", 0
        self.own: dict[int, bytes] = {}

    def put(self, text: bytes) -> tuple[str, int, int]:
        packed = self.codec.compress(text, asbytes=True) if text else b""
        # length first, for the readers
        packed = len(packed).to_bytes(8, "little") + packed
        if self.size and self.size + len(packed) > FILE_BYTES:
            self.flush()
        at = self.size
        self.own[at] = packed
        self.size += len(packed)
        return self.name, at, len(text)

    def flush(self) -> None:
        if self.own:
            fs, path = pyarrow.fs.FileSystem.from_uri(f"{self.where}/{self.name}")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                for packed in self.own.values():
                    f.write(packed)
        self._new()

    def get(self, name: str, at: int, size: int) -> bytes:
        if name == self.name:
            packed = self.own[at][8:]
        else:
            fs, path = pyarrow.fs.FileSystem.from_uri(f"{self.where}/{name}")
            with fs.open_input_file(path) as f:
                f.seek(at)
                packed = f.read(int.from_bytes(f.read(8), "little"))
        return self.codec.decompress(packed, decompressed_size=size, asbytes=True) if size else b""


class KnownTexts(StatefulProcessor):
    """One bucket's entries. handleInputRows gives an ASSIGNED row a merged row: its class, and what the state says of it from then on."""

    def __init__(self, contents: str):
        self.where = contents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", KEY, ENTRY)
        self.contents = Contents(self.where)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        read: OrderedDict[tuple, bytes] = OrderedDict()
        for pdf in rows:
            out = []
            for d, text, ids in zip(pdf["digest"], pdf["text"], pdf["ids"]):
                ids = [None if i is None or i != i else int(i) for i in ids]
                no, entry = self._find(bytes(d), bytes(text), read)
                known = [i for i in ids if i is not None]
                top = max(known, default=None)
                raised = entry is None or (top is not None and (entry[0] is None or top > entry[0]))
                keep = top if raised else entry[0]
                at = entry[2:] if entry else self.contents.put(bytes(text))
                size = len(ids) + (entry[1] if entry else 0)
                self.entries.updateValue((bytes(d), no), (keep, size, *at))
                out.append((bytes(d), no, ids, keep, size, raised))
            result = pd.DataFrame(out, columns=["digest", "no", "ids", "keep", "size", "raised"])
            yield result.astype({"keep": "Int64"})

    def _find(self, digest: bytes, text: bytes, read: OrderedDict) -> tuple[int, tuple | None]:
        """The text's class under its digest and that class's entry (None: a new class)."""
        no = 0
        while (entry := self.entries.getValue((digest, no))) is not None:
            at = tuple(entry[2:])
            if at[2] == len(text):
                if at not in read:
                    read[at] = self.contents.get(*at)
                    while len(read) > 1 and sum(map(len, read.values())) > CACHE_BYTES:
                        read.popitem(last=False)
                if read[at] == text:
                    return no, tuple(entry)
            no += 1
        return no, None

    def close(self) -> None:
        self.contents.flush()


@contextlib.contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def advance(arrivals: DataFrame, where: str, digest: Callable[[bytes], bytes] = sha256) -> None:
    """Takes in what has arrived (a streaming frame with doc_id, text) since the last call on this folder, and returns when it is done."""
    spark = arrivals.sparkSession
    common.small_batches(spark)
    merged = arrivals.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: merge_copies(batches, digest), MERGED)
    classed = merged.groupBy("bucket").transformWithStateInPandas(KnownTexts(f"{where}/contents"), ASSIGNED, "append", "None")
    with settings(spark):
        query = classed.writeStream.format("parquet").option("path", f"{where}/assigned").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def result(spark: SparkSession, where: str) -> DataFrame:
    """A row a document that has arrived: doc_id, keep_id, group_size, kept, digest."""
    assigned = spark.read.schema(ASSIGNED).parquet(f"{where}/assigned")
    # ids and sizes only grow, so the last is the largest
    last = assigned.groupBy("digest", "no").agg(F.max("keep").alias("keep_id"), F.max("size").alias("group_size"))
    rows = assigned.join(last, ["digest", "no"]).withColumn("best", F.col("raised") & F.col("keep").eqNullSafe(F.col("keep_id")))
    first = F.array_position(F.transform("ids", lambda i: i.eqNullSafe(F.col("keep_id"))), True) - 1
    return rows.select("digest", "keep_id", "group_size", F.when(F.col("best"), first).alias("at"), F.posexplode("ids").alias("i", "doc_id")).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("i") == F.col("at"), F.lit(False)).alias("kept"), "digest"
    )


def arrivals_of(spark: SparkSession, folder: str, name: str, batches: int = BATCHES) -> DataFrame:
    """A table's rows as a stream that deals its files to about `batches` micro-batches; a table of one file is found through its folder."""
    static = spark.read.parquet(f"{folder}/{name}").select("doc_id", "text")
    files = static.inputFiles()
    source = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    alone = len(files) == 1 and files[0].endswith(f"/{name}")
    return source.option("pathGlobFilter", name).parquet(folder) if alone else source.parquet(f"{folder}/{name}")


def op12_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = common.scratch(spark, "stream-dedup")
    advance(arrivals_of(spark, sf_dir, "documents.parquet"), where)
    return result(spark, where).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
