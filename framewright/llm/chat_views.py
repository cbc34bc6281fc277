"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's messages are
the assistant's and the ones to learn, all others are users under their names.
A view is a row per message, with its place in the rendered dialogue, so that a
dialogue of any length is never gathered in one row or task: places come from
prefix sums over ranges of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.ranges import prefix_sums

#: Roles that speak to the participants without being one.
CONTEXT_ROLES = ("system",)
END = "<|end|>\n"


def views(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> a row for each message and participant of its conversation.

    Columns: conv_id, perspective, place (0.. in the dialogue), turn, speaker,
    chat_role (assistant, user or system), rendered, start and stop (characters
    of the rendered dialogue), mask_start and mask_stop (the part to learn; equal
    to stop where there is none).  The dialogue is all rendered texts by place.

    Messages stand by turn, role and text, nulls first.  A null role speaks as
    "unknown", a null text is empty, a null conv_id is a conversation of its own.
    Repeated rows are messages of their own.  A conversation of context roles
    alone has no participant and no view.  Other columns are ignored.
    """
    m = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    context = F.col("speaker").isin(*CONTEXT_ROLES)
    people = m.where(~context).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    pairs = m.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(context, "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.concat(F.lit(" "), F.col("speaker"))).otherwise("")
    head = F.concat(F.lit("<|"), role, F.lit("|>"), name, F.lit("\n"))
    rows = pairs.select("conv_id", "perspective", "turn", "speaker", "text", role.alias("chat_role"), F.length(head).alias("head"), F.concat(head, F.col("text"), F.lit(END)).alias("rendered"))
    rows = rows.withColumn("chars", F.length("rendered").cast("long"))
    placed = prefix_sums(rows, ["conv_id", "perspective"], ["turn", "speaker", "text"], ["chars"])
    stop = F.col("before_chars") + F.col("chars")
    begin = F.when(F.col("chat_role") == "assistant", F.col("before_chars") + F.col("head")).otherwise(stop)
    return placed.select("conv_id", "perspective", F.col("place").cast("long").alias("place"), "turn", "speaker", "chat_role", "rendered", F.col("before_chars").alias("start"), stop.alias("stop"), begin.alias("mask_start"), stop.alias("mask_stop"))
