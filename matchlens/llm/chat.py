"""Relational chat formatting: conversations to training strings with Spark expressions only.

Rows of one conversation are collected as structs, sorted by turn, adjacent rows of one role are merged into a block by
array functions, and the blocks are concatenated. The template:

    <|block|>role<|says|>text<|next|>text<|end|>

`<|next|>` keeps apart the texts that were merged, so that the rows can be read back; the text of an assistant block
stands between `<|learn|>` and `<|/learn|>`, the loss mask. `loss_runs` holds the same mask as run lengths, in code
points, alternately outside and inside.

Escaping: in texts and roles a backslash is doubled, and every control string, of this template or of a common other
one, gets a backslash after its first character (`<|end|>` -> `<\\|end|>`, `</s>` -> `<\\/s>`). Then no control string of
the output stems from a text, and dropping one backslash of each backslash pair restores the text.

Edge cases: null texts and roles count as empty; equal turn numbers are ordered by role, then text; repeated rows stay;
a null conv_id is a conversation; an empty table gives none; other columns are ignored. A conversation is one output
row, so it must fit in one (Spark's limit: 2 GB); it is gathered once, after columns are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, SAYS, NEXT, END = "<|block|>", "<|says|>", "<|next|>", "<|end|>"
LEARN, LEARNED = "<|learn|>", "<|/learn|>"
#: What follows the first character of a control string: any `<|`, and the markers of other chat templates.
CONTROL = r"(<)(?=\||/?s>|/?<SYS>|/?<?/?SYS>>|/?start_of_turn>|/?end_of_turn>)|(\[)(?=/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def blocks_of(turns: Column) -> Column:
    """Sorted turn structs -> array of (role, texts): adjacent turns of one role merged."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda x: F.struct(
            F.element_at(turns, x["a"])["role"].alias("role"),
            F.transform(F.slice(turns, x["a"], x["b"] - x["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def render(blocks: Column) -> Column:
    """Blocks -> array of pieces (text, learn), to be concatenated."""

    def block(b):
        body = F.array_join(F.transform(b["texts"], escape), NEXT)
        head = F.concat(F.lit(BLOCK), escape(b["role"]), F.lit(SAYS))
        learn = b["role"] == LOSS_ROLE
        return F.when(
            learn, F.array(F.concat(head, F.lit(LEARN)), body, F.lit(LEARNED + END))
        ).otherwise(F.array(F.concat(head, body, F.lit(END)), F.lit(""), F.lit("")))

    return F.flatten(F.transform(blocks, block))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs, n_blocks: one row a conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), common.text_of().alias("text"))
    return (
        rows.select("conv_id", turn.alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", blocks_of(F.col("turns")).alias("blocks"))
        .select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), render(F.col("blocks")).alias("pieces"))
        .select("conv_id", "n_blocks", F.array_join("pieces", "").alias("formatted"), F.transform("pieces", lambda p: F.length(p).cast("long")).alias("loss_runs"))
    )


def read_back(formatted: Column) -> Column:
    """formatted -> array of turn structs (role, text), merged rows apart again."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def turns(p):
        body = F.regexp_replace(F.substring_index(p, SAYS, -1), r"^<\|learn\|>|<\|/learn\|>$", "")
        role = unescape(F.replace(F.substring_index(p, SAYS, 1), F.lit(BLOCK), F.lit("")))
        return F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    learnt = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|learn\|>(.*?)<\|/learn\|>"), F.lit(1))
    return F.array_join(F.transform(learnt, lambda t: unescape(F.replace(t, F.lit(NEXT), F.lit("")))), "")


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts are made of another template's control strings."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_conversations(with_probe(spark, common.table(spark, sf_dir, "conversations")))
    back = out.select("conv_id", "formatted", "n_blocks", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(regexp_replace(replace(replace(text, '\', '\\'), '<|', '<\|'),
      '<(/?s>|/?<SYS>|/?<?/?SYS>>|/?start_of_turn>|/?end_of_turn>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as esc,
    coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as joined
  from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(esc) + case when joined then 8 else 24 + length(role) + case when role = 'assistant' then 19 else 0 end end)::bigint as formatted_chars,
  count(*) filter (where not joined) as n_blocks
from e group by conv_id
"""
