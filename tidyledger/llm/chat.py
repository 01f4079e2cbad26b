"""Chats as one training text each, in Spark expressions only; the text can be taken apart again without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and what stands for their characters inside roles and texts.
OPEN, NEXT, CLOSE = "<turn ", "<next>", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(text: Column) -> Column:
    for sign, name in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescaped(text: Column) -> Column:
    for sign, name in reversed(ESCAPES):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def formatted_chats(
    turns: DataFrame,
    chat: str = "chat_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Chats of any source, one row each: (chat_id, formatted, loss_mask). The library itself keeps no chats.

    A chat's turns are collected and sorted by turn number, on a tie by role, then text; numbers that are missing
    come first. Adjacent turns of one role share a block: ``<turn role>text<next>text</turn>`` and a line end. The
    marks' characters inside roles and texts are escaped reversibly. ``loss_mask`` has one entry per mark: whether
    the text behind it, up to the next mark, is trained on; true for each text of a ``trained`` role.

    Missing roles and texts are empty, a missing chat id is a chat of its own, repeated rows are turns of their own.
    Other columns are not read. An empty table gives no rows. All array steps look at neighbours only, so a long
    chat costs in proportion to its length; a chat is one row of the result and so one task's work.
    """
    listed = turns.select(
        turns[chat].alias("chat_id"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    chats = listed.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def differs(own: Column, place: Column) -> Column:
        return F.coalesce(F.get("turns", place)["role"] != own["role"], F.lit(True))

    def piece(own: Column, i: Column) -> Column:
        head = F.when(differs(own, i - 1), F.concat(F.lit(OPEN), escaped(own["role"]), F.lit(">"))).otherwise(NEXT)
        return F.concat(head, escaped(own["text"]), F.when(differs(own, i + 1), CLOSE).otherwise(""))

    def mask(own: Column, i: Column) -> Column:
        learned = own["role"].isin(*trained) if trained else F.lit(False)
        return F.when(differs(own, i + 1), F.array(learned, F.lit(False))).otherwise(F.array(learned))

    return chats.select(
        "chat_id",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.flatten(F.transform("turns", mask)).alias("loss_mask"),
    )


def _body(segment: Column) -> Column:
    """Text behind the mark that a segment starts with."""
    return unescaped(F.substring(segment, F.length(F.substring_index(segment, ">", 1)) + 2, F.length(segment)))


def _segments(text: Column | str) -> Column:
    """What follows each mark's first character, up to the next mark."""
    parts = F.split(text, "<")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_turns(formatted: Column | str) -> Column:
    """array<struct<role, text>> of a formatted chat: its turns as they were."""

    def block(own: Column) -> Column:
        segments = _segments(own)
        mark = F.substring_index(F.get(segments, F.lit(0)), ">", 1)
        role = unescaped(F.substring(mark, len(OPEN), F.length(mark)))
        return F.transform(segments, lambda s: F.struct(role.alias("role"), _body(s).alias("text")))

    blocks = F.filter(F.split(formatted, CLOSE), lambda own: own != "")
    return F.flatten(F.transform(blocks, block))


def read_trained(formatted: Column | str, loss_mask: Column | str) -> Column:
    """All text under the loss mask of a formatted chat, unescaped."""
    under = F.zip_with(_segments(formatted), loss_mask, lambda s, learned: F.when(learned, _body(s)).otherwise(""))
    return F.array_join(under, "")
