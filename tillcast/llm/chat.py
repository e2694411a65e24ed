"""Conversations as training text, with Spark expressions only.

The turn structs of a conversation are collected and sorted, adjacent turns of one role
become one block, and array functions join the pieces:

    <|im_start|>role<|im_sep|>text<|im_next|>text of the next turn, same role<|im_end|>\\n

Texts and roles are escaped: between ``<`` and ``|`` one backslash is added to those that
stand there. So no text holds ``<|``, and taking one backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments``.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. ``segments``
    is an array of (text, loss) whose texts joined give ``formatted``; loss is true for the
    escaped texts of ``loss_role``. Null texts and roles are empty strings. Turns are
    ordered by turn (null first), then role, then text, so ties have one order and
    repeated rows stay, each as a turn. Rows without conv_id form one conversation. No
    rows give no rows.
    """
    item = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))

    def pieces(turn: Column, at: Column) -> Column:
        before = F.col("turns")[at - 1]["role"]
        head = F.concat(F.lit(START), escape(turn["role"]), F.lit(SEP))
        opening = (
            F.when(at == 0, head)
            .when(before == turn["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END + "\n"), head))
        )
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"]).alias("text"), (turn["role"] == loss_role).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("turns", pieces)), last)
    return chats.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def read_turns(formatted: Column) -> Column:
    """The turns, an array of (role, text), read back from ``formatted``."""

    def quoted(mark: str) -> str:
        return mark.replace("|", r"\|")

    def block(text: Column) -> Column:
        halves = F.split(text, quoted(SEP), -1)
        role = unescape(F.regexp_replace(halves[0], "^" + quoted(START), ""))
        return F.transform(
            F.split(halves[1], quoted(NEXT), -1),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    blocks = F.split(formatted, quoted(END) + "\n", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: turns, loss text and lengths, as digests."""
    line = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = formatted.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(learnt, "").alias("learnt"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
