"""Token-id output: raw id payloads in shard files, and a minimal perfect hash index over the document keys.

Writing. Documents are range-partitioned and sorted by id; each task encodes its partition and streams the ids into one
shard file: an 16-byte header (magic, bytes an id, version) and then nothing but ids, little-endian, 2 bytes each while
the vocabulary allows it, else 4. A shard's name carries its attempt's own random part, so retried or speculative tasks never
write the same file; the entry table (key, shard, file, offset, length), committed by Spark, names the files that count.

Index. Keys are dealt to buckets of about `BUCKET_KEYS` by hash. Each bucket gets a minimal perfect hash (hash and
displace: groups of about four keys, largest first, each with the first displacement that puts its keys on free
places; what is left over, single keys, is given the free places directly). A bucket's row holds the displacements
and, per place, a 32-bit fingerprint, shard, offset and length. A lookup is: bucket, group, displacement, place,
compare the fingerprint; an unknown key is turned away but for 1 in 2**32.

Edge cases: a null text is an empty document (only the end id); rows with one id are told apart by `copy` (0, 1, ... in
order of text); null ids come first; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TOKS"
HEADER = "<4sII4x"
END_ID = 2
BUCKET_KEYS = 2000
GROUP_KEYS = 4
#: Entries of a worker's caches of chunks and of pieces; a cache is emptied when full.
CHUNKS, PIECE_CACHE = 200_000, 1_000_000
#: Texts with other characters, whose classes depend on the Unicode version, go to the library whole.
RARE = regex.compile(r"[^\u0000-ɏ]")
#: Without white space next to white space every single space or line break is a boundary of the tokenizer's own split.
WIDE = regex.compile(r"\s\s")
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0"
#: The byte-level pre-tokenizer's split (fixed by the tokenizer file's format).
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_alphabet() -> dict[int, str]:
    """The characters that a byte-level model writes bytes as: visible Latin-1 as itself, the rest in order from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The tokenizer with caches: text -> ids as raw bytes. Same ids as the library's for the whole text, so the string of an added
    token is that token. A text with one goes to the library whole, as do those with rare characters. Any other text is cut into chunks at spaces and line breaks, a chunk that isn't known into pieces as the tokenizer itself cuts it, and a
    piece that isn't known goes to the library's merges.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added) or RARE.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if WIDE.search(text):
            return self._from_pieces(text)
        # a chunk starts with a line break, or else stands for itself with a space before it
        first, *chunks = text.replace("\n", " \n").split(" ")
        known = self.chunks
        out = [self._from_pieces(first)]
        for c in chunks:
            got = known.get(c)
            if got is None:
                if len(known) >= CHUNKS:
                    known.clear()
                got = known[c] = self._from_pieces(c if c[:1] == "\n" else " " + c)
            out.append(got)
        return b"".join(out)

    def _from_pieces(self, text: str) -> bytes:
        known, out = self.pieces, []
        for p in PIECES.findall(text):
            got = known.get(p)
            if got is None:
                if len(known) >= PIECE_CACHE:
                    known.clear()
                spelt = p.encode().decode("latin-1").translate(self.alphabet)
                got = known[p] = np.asarray([t.id for t in self.model.tokenize(spelt)], self.dtype).tobytes()
            out.append(got)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's own encoder: Spark reuses workers, and so do tasks what earlier ones have encoded."""
    return Encoder(path)


ENTRY = "doc_id long, copy int, shard int, file string, width int, off long, n long"


def write_shards(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the shard files under out_dir (a URI that every executor reaches) and returns the committed entry table."""
    shards = shards or common.shuffle_partitions(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        width, shard = encoder.dtype.itemsize, TaskContext.get().partitionId()
        end = np.asarray([end_id], encoder.dtype).tobytes()
        name = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        off, last, copy, out = 0, object(), 0, None
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    if out is None:
                        fs, path = pa.fs.FileSystem.from_uri(name)
                        fs.create_dir(os.path.dirname(path), recursive=True)
                        out = fs.open_output_stream(path)
                        out.write(struct.pack(HEADER, MAGIC, width, 1))
                    ids, rows = part["doc_id"].to_pylist(), []
                    for doc_id, text in zip(ids, part["text"]):
                        data = encoder.encode(text.as_py() or "") + end
                        out.write(data)
                        copy = copy + 1 if doc_id == last else 0
                        last, n = doc_id, len(data) // width
                        rows.append((copy, off, n))
                        off += n
                    k = len(rows)
                    c, o, n = (np.array(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(c, pa.int32()), pa.array(np.full(k, shard), pa.int32()), pa.array([name] * k),
                         pa.array(np.full(k, width), pa.int32()), pa.array(o, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "copy", "shard", "file", "width", "off", "n"],
                    )
        finally:
            if out is not None:
                out.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(ordered.mapInArrow(encode, ENTRY), "token-entries")


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of a public mixing function) over h and a seed."""
    with np.errstate(over="ignore"):
        x = h + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _groups(m: int) -> int:
    return max(1, m // GROUP_KEYS)


def _spot(h: np.ndarray, h2: np.ndarray, shift, m: int) -> np.ndarray:
    """Where a displacement sends keys: by both of their hashes, so that keys with one equal hash part."""
    with np.errstate(over="ignore"):
        d = np.asarray(shift).astype(np.uint64)
        return (_mix(h + h2 * (np.uint64(2) * d + np.uint64(1)), d + np.uint64(1)) % np.uint64(m)).astype(np.int64)


def build_hash(h: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key (one may be shared by keys, both may not) -> (displacement of each group, place of each key); the places
    are 0..m-1, each once.

    A displacement d >= 0 sends a key to its spot; -1 - p puts a group's only key at place p.
    """
    m, h2 = len(h), h if h2 is None else h2
    if len(np.unique(h)) < m and len(np.unique(np.stack([h, h2], 1), axis=0)) < m:
        raise ValueError("two keys with the same two hashes")
    group = (_mix(h, 0) % np.uint64(_groups(m))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=_groups(m))
    starts = np.concatenate([[0], np.cumsum(counts)])
    shift, place, free = np.zeros(_groups(m), np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    alone = []
    for g in np.argsort(-counts, kind="stable"):
        k = counts[g]
        if k == 0:
            break
        keys = order[starts[g]:starts[g + 1]]
        if k == 1:
            alone.append((g, keys[0]))
            continue
        d = 0
        while True:
            tries = np.arange(d, d + 64)
            at = _spot(h[keys][None, :], h2[keys][None, :], tries[:, None], m)
            good = free[at].all(1)
            s = np.sort(at, 1)
            good &= (s[:, 1:] != s[:, :-1]).all(1)
            hit = np.flatnonzero(good)
            if len(hit):
                shift[g], place[keys] = tries[hit[0]], at[hit[0]]
                free[at[hit[0]]] = False
                break
            d += 64
    for (g, key), p in zip(alone, np.flatnonzero(free)):
        shift[g], place[key] = -1 - p, p
    return shift, place


def places(h: np.ndarray, shift: np.ndarray, m: int, h2: np.ndarray | None = None) -> np.ndarray:
    """The place of each key, known or not."""
    d = shift[(_mix(h, 0) % np.uint64(_groups(m))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _spot(h, h if h2 is None else h2, np.maximum(d, 0), m))


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 0x51ED) >> np.uint64(32)).astype(np.int64)


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    keyed = df.withColumns({"h": F.xxhash64("doc_id", "copy"), "h2": F.xxhash64(F.lit(1), "copy", "doc_id")})
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))


def _hashes(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "h2"))


INDEX = "bucket long, buckets long, shift array<long>, fp array<long>, shard array<int>, off array<long>, n array<long>"


def build_index(entries: DataFrame) -> DataFrame:
    """One row a bucket: the bucket's minimal perfect hash, fingerprints and locations. Keys are (doc_id, copy)."""
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, h2 = _hashes(pdf)
        shift, place = build_hash(h, h2)
        by_place = np.argsort(place)
        col = lambda name: pdf[name].to_numpy()[by_place]
        return pd.DataFrame({
            "bucket": [pdf["bucket"].iat[0]], "buckets": [buckets], "shift": [shift], "fp": [fingerprints(h2)[by_place]],
            "shard": [col("shard")], "off": [col("off")], "n": [col("n")],
        })

    keyed = _keyed(entries.select("doc_id", "copy", "shard", "off", "n"), buckets)
    return common.written(keyed.groupBy("bucket").applyInPandas(build, INDEX), "token-index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, copy) -> shard, off, n of the keys that the index knows."""
    first = index.select("buckets").first()
    buckets = first[0] if first else 1

    def find(k: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        out = k[["doc_id", "copy"]].copy()
        if not len(i) or not len(k):
            return out.assign(shard=0, off=0, n=0).iloc[:0]
        row = i.iloc[0]
        h, h2 = _hashes(k)
        at = places(h, np.asarray(row["shift"]), len(row["fp"]), h2)
        known = np.asarray(row["fp"])[at] == fingerprints(h2)
        for c in ("shard", "off", "n"):
            out[c] = np.asarray(row[c])[at]
        return out[known]

    k = _keyed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("int").alias("copy")), buckets)
    return k.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "doc_id long, copy int, shard int, off long, n long")


def shard_table(entries: DataFrame) -> DataFrame:
    """shard, file, width, base: one row a shard; base counts the ids of all shards before it."""
    per = entries.groupBy("shard").agg(F.first("file").alias("file"), F.first("width").alias("width"), F.sum("n").alias("ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("shard", "file", "width", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_payloads(located: DataFrame, schema: str, digest) -> DataFrame:
    """located: doc_id, copy, file, width, off, n, start. Reads each payload by its offset; digest(ids) gives the rest of a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name = r["file"]
                    fs, path = pa.fs.FileSystem.from_uri(name)
                    source = fs.open_input_file(path)
                    magic, width, _ = struct.unpack(HEADER, source.read(struct.calcsize(HEADER)))
                    if magic != MAGIC or width != r["width"]:
                        raise ValueError(f"{name} is no token shard of this format")
                source.seek(struct.calcsize(HEADER) + r["off"] * r["width"])
                ids = np.frombuffer(source.read(r["n"] * r["width"]), f"<u{r['width']}")
                rows.append((r["doc_id"], r["copy"], r["start"], len(ids), *digest(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if source is not None:
            source.close()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    spread = located.repartition(common.shuffle_partitions(located.sparkSession), "shard").sortWithinPartitions("shard", "off")
    return spread.select("doc_id", "copy", "start", "file", "width", "off", "n").mapInArrow(read, schema)


def crc(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def store(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes shards and index for docs under the shared folder; returns (entries, index)."""
    entries = write_shards(docs, tokenizer, common.scratch(docs.sparkSession, "token-shards"), end_id)
    return entries, build_index(entries)


def digests(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Looks every document up in the index and reads its ids back: doc_id, copy, start, n_tokens, ids_crc32."""
    shards = common.written(shard_table(entries), "token-shard-table")
    located = lookup(entries.select("doc_id", "copy"), index).join(shards, "shard").withColumn("start", F.col("base") + F.col("off"))
    return read_payloads(located, "doc_id long, copy int, start long, n_tokens long, ids_crc32 long", crc)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    entries, index = store(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(entries, index).select("doc_id", "start", "n_tokens", "ids_crc32")
