"""A corpus from raw documents to token shards: language, near copies, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents`; the last
one returns the token store's digest. `run` applies them to the documents table, each stage's result written and read again.

Edge cases, for every stage: a null or empty text has no language and goes in the first stage; the other stages keep it (its set is
like nothing, it holds no passage, the mixture takes its 0 words by the same hash rule as others, its tokens are the end id). Null
lang, source, doc_id and n_chars are kept as they are, and a null source is a source of its own; documents without an id come last in
their group of near copies, each on its own, so that one stays if all of a group are without; repeated rows of one id are one
document to the near-copy and passage stages, which keep or drop them together; other columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import common, decontaminate, jaccard_join, langid, mixing, token_store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: five words a shingle, a similarity of 0.8.
NEAR = jaccard_join.Rule(words=5, num=8, den=10)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (null, no letter) and sets lang to the language that is read from the text."""
    model = langid.learn(docs.where(~langid.held_out()))
    named = langid.predict(docs, model, [c for c in COLUMNS if c != "lang"])
    return named.where(F.col("lang_pred") != langid.UNKNOWN).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard_join.one_of_each(docs, NEAR).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, substitutions allowed for."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' mixture: each document as many times as the mixture repeats it (none: dropped)."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixture as token shards with their index; returns what is read back of each document."""
    import public_tokenizers

    entries, index = token_store.store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.digests(entries, index)


STAGES = [("language ID", by_language), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", without_benchmark), ("mixing sources", mixed), ("token output", tokens)]

#: Sampled language models, exact joins by signature and tokenizers have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
