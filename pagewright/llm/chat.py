"""Chat formatting with perspective rotation, for dialogues of any number of speakers.

For every participant, the dialogue is rendered with that speaker as the assistant, all others as named users
and the system's turns as they are. One row is one rendered turn of one perspective, with its place in the
rendered dialogue; the rows of a perspective in order of ``seq`` are its text. Only the assistant's words and
the mark that ends them are trained on: ``mask_start`` to ``mask_end``, in characters of the dialogue.

Turns are kept apart so that a dialogue of any length stays spread over tasks: places come from distributed
running totals. A dialogue of T turns and P participants gives P x T rows, which is what is asked for.

Defined cases: a null or empty speaker is called ``unknown``; null text is empty; dialogues with a null id
form one dialogue; a dialogue of system turns alone has no participant and no row; repeated rows are
repeated turns; turns with the same number are ordered by speaker and a checksum of the text; a mark inside a text is broken up
so that no text can forge a turn; a text of any length is one turn, whole; an empty table gives no row; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, running_totals

SYSTEM = "system"
END = "<|end|>"


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, trained, seq, char_start, mask_start, mask_end."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    said = turns.select("conv_id", "turn", F.coalesce(F.nullif(plain(F.col("role")), F.lit("")), F.lit("unknown")).alias("speaker"), plain(F.col("text")).alias("content"))
    who = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    rendered = each.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.concat(head, "content", F.lit(END + "\n")).alias("segment"),
        own.alias("trained"),
        "content",
        F.length(head).cast("long").alias("_head"),
    ).withColumns({"_one": F.lit(1).cast("long"), "_chars": F.length("segment").cast("long"), "_sum": F.md5(F.col("content").cast("binary"))}).drop("content")
    placed = running_totals(freeze(rendered, "turns"), ["turn", "speaker", "_sum"], ["_one", "_chars"], ["conv_id", "perspective"], "dialogues")
    start = F.col("_chars_before")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "segment",
        "trained",
        F.col("_one_before").alias("seq"),
        start.alias("char_start"),
        F.when(F.col("trained"), start + F.col("_head")).alias("mask_start"),
        F.when(F.col("trained"), start + F.col("_chars") - 1).alias("mask_end"),
    )
