"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stash

OPEN, MID, END = "<s>[INST] ", " [/INST]", "</s>"
CONTROLLED = r"([<\[])(\\*/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(c: Column) -> Column:
    """One backslash more after the bracket of every control string (<s> </s> [INST] [/INST], with any backslashes it has already)."""
    return F.regexp_replace(c, CONTROLLED, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2")


def chat_examples(conv: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per training example: conv_id, example, turn_index, text, loss_start, loss_end.

    A turn is written `<s>[INST] role [/INST]text</s>`, with control strings inside role and text escaped reversibly. Every turn of the role
    `trainable` becomes an example of its own: all turns before it as context, then the turn; only its text, code points loss_start (from 0) up to loss_end of
    the example's text, is under the loss. A conversation that ends with other turns (or has no trainable one) gets one more example that
    ends with its last turn and has an empty loss span, so that no turn is lost.

    Turns lie by (turn, role, text); equal rows count each. Null role or text counts as empty; a null conv_id is a conversation like any other.
    Output size is the sum of all prefixes, which the method asks for. A conversation's turns are gathered into one row, since an example holds them all;
    examples of one conversation are built one at a time. An empty table gives an empty result. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conv.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
    g = g.withColumn("heads", F.transform("ts", head)).withColumn("bodies", F.transform("ts", lambda t: escape(t["text"])))
    g = g.withColumn("segs", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    n = F.size("ts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("ts", i)["role"] == trainable) | (i == n))
    e = g.select("conv_id", "segs", F.transform("heads", F.length).alias("hl"), F.transform("bodies", F.length).alias("bl"), F.transform("ts", lambda t: t["role"] == trainable).alias("own"), F.posexplode(ends).alias("example", "at"))
    whole = F.array_join(F.slice("segs", F.lit(1), F.col("at")), "")
    e = e.select("conv_id", F.col("example").cast("long"), F.col("at").cast("long").alias("turn_index"), whole.alias("text"), F.element_at("bl", F.col("at")).alias("body"), F.element_at("own", F.col("at")).alias("own"))
    stop = F.length("text") - len(END)
    return e.select("conv_id", "example", "turn_index", "text", F.when(F.col("own"), stop - F.col("body")).otherwise(F.length("text")).cast("long").alias("loss_start"), F.when(F.col("own"), stop).otherwise(F.length("text")).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """From the examples alone: conv_id, turns (array of role, text), loss_text (all text under the loss mask, in order), formatted_chars."""
    loss = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    small = examples.select("conv_id", "example", "turn_index", F.length("text").cast("long").alias("n"), loss.alias("loss"))
    g = small.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("ls"), F.sum("n").alias("formatted_chars"))
    g = g.select("conv_id", F.array_join(F.transform("ls", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
    last = examples.groupBy("conv_id").agg(F.max("turn_index").alias("turn_index"))
    full = examples.join(last.withColumnRenamed("conv_id", "c").withColumnRenamed("turn_index", "i"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn_index") == F.col("i")), "left_semi")
    parts = F.split("text", END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    mid = lambda p: F.instr(p, MID)
    turn = lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), mid(p) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(p, mid(p) + len(MID), F.length(p))).alias("text"),
    )
    full = full.select(F.col("conv_id").alias("c"), F.transform(parts, turn).alias("turns"))
    return g.join(full, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


PLANTED = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, formatted, written and read back. Null texts are empty. See chat_examples and read_back."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{PLANTED}'), (-1L, 1L, 'assistant', '{PLANTED}') as t(conv_id, turn, role, text)")
    back = read_back(stash(chat_examples(conv.unionByName(extra)), "chat"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l as (
  select *, 22 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
              + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) as n from c),
p as (
  select *, sum(n) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto,
         row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as last from l)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(upto) filter (role = 'assistant' or last)::bigint as formatted_chars
from p group by conv_id
"""
