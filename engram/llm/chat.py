"""Chat formatting with Spark expressions only: sorted turn structs, merged roles, reversible escapes, a loss mask.

Template: ``<s>role[INST]text[/INST]text</s>``; adjacent turns of one role share a block, ``[/INST]`` between them.
Inside roles and texts a control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets one backslash after its first
character, and one that has backslashes there already gets one more; removing one gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, HEAD, NEXT = "<s>", "</s>", "[INST]", "[/INST]"
_ESCAPE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id and ``formatted`` of each conversation (columns conv_id, turn, role, text; others are ignored).

    Turns are ordered by turn, nulls first, ties by role and text; repeated rows are repeated turns. A null role or text
    is empty. Rows with a null conv_id form one conversation. The result of a conversation is one string, so a
    conversation must fit in a row.
    """
    turns = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blank = F.expr("CAST(array() AS array<struct<role:string,texts:array<string>>>)")

    def merge(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"])
        grown = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))))
        return F.when(same, grown).otherwise(F.concat(blocks, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))))

    merged = grouped.select("conv_id", F.aggregate("turns", blank, merge).alias("blocks"))
    shown = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(CLOSE))
    return merged.select("conv_id", F.array_join(F.transform("blocks", shown), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``turns`` (array of role and text) read back from ``formatted``, and ``loss`` (the assistant texts under the mask)."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split("formatted", quoted(CLOSE), -1), lambda b: b != "")
    cut = formatted.withColumn("blocks", F.transform(blocks, lambda b: F.split(F.substring(b, len(OPEN) + 1, 1 << 30), quoted(HEAD), 2)))

    def turns(b: Column) -> Column:
        return F.transform(F.split(b[1], quoted(NEXT), -1), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")))

    read = cut.withColumn("turns", F.flatten(F.transform("blocks", turns))).drop("blocks")
    spoken = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return read.withColumn("loss", F.array_join(spoken, ""))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: n_turns, digests of all turns and of the text under the loss mask."""
    read = read_chats(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
