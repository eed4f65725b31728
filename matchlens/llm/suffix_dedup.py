"""Removal of bytes covered by a 50-byte string that also starts in a document with a smaller id, by prefix doubling.

Suffixes only need to be told apart over `WIDTH` bytes, so doubling ends there, and positions drop out as soon as no other document shares
their rank (see repeats.py):

- `GRAM` bytes: the rank of each window's anchor. Spark deals runs of windows out by it and sorts them; runs that are equal as a whole are settled.
- half the rest more, before or after the anchor: what no other document shares drops out.
- `WIDTH` bytes: each position left is a row with its rank (of half the width) and the rank at that offset. Spark sorts these pairs;
  positions of one pair start the same string, which is past the threshold.

Edge cases: null is empty; documents under 50 bytes lose nothing; rows of one id are one document (no repeat of each other);
documents without an id come after all others and are no repeats of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

WIDTH, GRAM = 50, 24


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_tokens (bytes), n_removed, n_spans, kept (the remaining bytes) of every document."""
    w = repeats.Windows(width, gram, words=False, same_document=False, last=repeats.last_id(docs))
    found = common.written(repeats.find_runs(docs, w), "suffix-runs")
    windows = common.written(repeats.ranked(repeats.open_windows(docs, found.where("key is not null"), w), w), "suffix-windows")
    return repeats.removed(docs, found.where("key is null").unionByName(windows), w)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
