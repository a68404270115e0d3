"""Preference formatting: a shared prompt and two masked completions for each pair.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns
(equal role and text) is rendered once as the prompt; what follows is rendered as the
two completions, each with the character spans that count for the loss: the contents of
assistant turns with their end mark. All expressions are Spark's own functions.

`preference_pairs` makes pairs of a table of conversations. Conversations that share
their first turn are paired in conv_id order, two by two; the one with more assistant
text is chosen (ties: the smaller conv_id). One left alone is paired with a spoiled
copy of itself: its last assistant turn is replaced by its first one or, where that is
the same text, by an empty reply. Places inside a group of equal first turns are counted
in ranges of conv_id with about equal rows, so a first turn that a third of all conversations share is no hot task.

Defined results: rows without conv_id belong to no conversation and are left out. A null
role is "user", a null text is empty. Turns are ordered by turn, role, text (null turn
first); repeated rows are repeated turns. A conversation alone without assistant turn
gives no pair. Equal conversations give a pair whose completions are empty and whose
`differs` is false. An empty table gives no rows. Extra columns are dropped. A
conversation is one training example and is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, ranked, table

END = "<|end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row for each conversation, its turns in order."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _said(turns: Column) -> Column:
    """Characters of assistant text."""
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected); rejected_id is null for a spoiled copy."""
    convs = conversations_of(turns).withColumn("first", F.sha2(F.concat_ws("\x1f", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256))
    placed = ranked(convs.select("first", "conv_id"), ["first"], ["conv_id"], "place", by="conv_id").select("conv_id", F.floor(F.col("place") / 2).alias("place"))
    placed = convs.join(placed, "conv_id")
    rank = F.struct((-_said(F.col("turns"))).alias("said"), "conv_id", "turns")
    two = placed.groupBy("first", "place").agg(F.sort_array(F.collect_list(rank)).alias("two"))
    a, b = F.col("two")[0], F.get("two", F.lit(1))

    def spoiled(turns: Column) -> Column:
        roles = F.transform(turns, lambda t: t["role"])
        last = F.size(turns) - F.array_position(F.reverse(roles), "assistant")  # from 0
        first_text = F.filter(turns, lambda t: t["role"] == "assistant")[0]["text"]
        reply = F.when(first_text == F.get(turns, last)["text"], "").otherwise(first_text)
        return F.transform(F.slice(turns, 1, last + 1), lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, reply).otherwise(t["text"]).alias("text")))

    answered = F.exists(a["turns"], lambda t: t["role"] == "assistant")
    return two.where((F.size("two") == 2) | answered).select(
        a["conv_id"].alias("chosen_id"), b["conv_id"].alias("rejected_id"), a["turns"].alias("chosen"),
        F.when(b.isNotNull(), b["turns"]).otherwise(F.when(answered, spoiled(a["turns"]))).alias("rejected"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    return let(F.array_position(same, False), lambda at: F.when(at == 0, F.size(a).cast("long")).otherwise(at - 1))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """(start, end) in characters of each assistant turn's text and end mark in the rendered turns."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + 5 + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        at = s["at"] + size(t)
        span = F.array(F.struct((s["at"] + F.length(t["role"]) + 5).alias("start"), at.alias("end")))
        return F.struct(at.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: chosen_id, rejected_id, chosen, rejected (arrays of role and text)."""
    n = common_prefix(F.col("chosen"), F.col("rejected"))
    rows = pairs.withColumn("n_prompt_turns", n)
    tail = lambda c: F.slice(F.col(c), F.col("n_prompt_turns").cast("int") + 1, F.size(c))
    rows = rows.withColumns({"prompt": render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns").cast("int"))), "c_tail": tail("chosen"), "r_tail": tail("rejected")})
    return rows.select(
        "chosen_id", "rejected_id", "n_prompt_turns", "prompt", render(F.col("c_tail")).alias("chosen"), loss_spans(F.col("c_tail")).alias("chosen_spans"),
        render(F.col("r_tail")).alias("rejected"), loss_spans(F.col("r_tail")).alias("rejected_spans"), ((F.size("c_tail") > 0) | (F.size("r_tail") > 0)).alias("differs"),
    )


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_preferences(preference_pairs(table(spark, sf_dir, "conversations")))
    crc = lambda c: F.crc32(F.col(c).cast("binary"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return rows.select(
        "chosen_id", "rejected_id", "n_prompt_turns", F.length("prompt").cast("long").alias("prompt_chars"), crc("prompt").alias("prompt_crc32"),
        crc("chosen").alias("chosen_crc32"), crc("rejected").alias("rejected_crc32"), spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"), "differs",
    )
