"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered once more with that speaker as
the assistant, all others as named users, and a loss mask on the assistant's
words. A dialogue comes in segments of so many turn numbers, so that a numbered
one of any size never has to fit into one row or task; turns that share a number
share a segment. Nothing that a speaker says or is called can open or close a
turn: marks in it are spaced out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Turn numbers that one segment spans.
SEGMENT = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system",
    segment: int | None = SEGMENT, scratch: Scratch | None = None,
) -> DataFrame:
    """conv_id, perspective, segment, n_turns, dialogue, mask: one row for each participant and segment.

    A participant is any speaker but ``system``. A turn is rendered as
    ``<|im_start|>{role}\\n{text}<|im_end|>\\n`` with role ``assistant`` for the
    perspective's own turns, ``system``, or ``user name={speaker}``. mask is a run
    length code over the characters of dialogue: array of struct(length, loss),
    with loss 1 on an assistant's text and its end mark. Segment s holds turns
    segment * s up to segment * (s + 1), in order of turn, speaker, text; with None a
    dialogue is one segment.

    Exact repeats of a row are one turn. Rows without a conversation are left
    out; a null speaker is named ``unknown``, a null text is empty, a null turn
    counts as 0. A dialogue of the system alone has no perspective. An empty
    table gives an empty one; other columns are not read.
    """
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        _plain(F.regexp_replace(F.coalesce(F.col(speaker_col), F.lit("unknown")), r"[\x00-\x1F\x7F]+", " ")).alias("speaker"),
        _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    ).distinct()
    # repeats go before the text is multiplied; each side is a plain shuffle of the join, so a dialogue with most of the rows can be split
    people = scratch.save(rows.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct(), "participants")
    seen = rows.join(people, "conv_id")
    number = F.floor(F.col("turn") / segment).cast("long") if segment else F.lit(0).cast("long")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(
        F.col("speaker") == F.col("perspective"), F.lit("assistant"),
    ).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    own = (F.col("speaker") == F.col("perspective")).cast("int")
    head, body = F.concat(F.lit(OPEN), role, F.lit("\n")), F.concat("text", F.lit(CLOSE))
    shown = seen.select(
        "conv_id", "perspective", number.alias("segment"),
        F.struct(
            "turn", "speaker", "text", F.concat(head, body, F.lit("\n")).alias("shown"),
            F.array(
                F.struct(F.length(head).alias("length"), F.lit(0).alias("loss")), F.struct(F.length(body).alias("length"), own.alias("loss")),
                F.struct(F.lit(1).alias("length"), F.lit(0).alias("loss")),
            ).alias("mask"),
        ).alias("t"),
    )
    grouped = shown.groupBy("conv_id", "perspective", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return grouped.select(
        "conv_id", "perspective", "segment", F.size("ts").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("dialogue"), F.flatten(F.transform("ts", lambda t: t["mask"])).alias("mask"),
    )
