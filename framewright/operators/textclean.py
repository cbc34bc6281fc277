"""Cleaning of recognised frames: lines are filtered, cut, rewritten, checked and put together again with their boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.operators import vocab
from framewright.scratch import stored

LineTest = Callable[[Column], Column]


def lines_of(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A row per line of ``(keys, bboxs, texts, confidences)``: line_no, box, line, confidence; missing boxes are null."""
    boxes = F.coalesce("bboxs", F.array().cast(frames.schema["bboxs"].dataType))
    zipped = F.arrays_zip(F.col("texts").alias("line"), boxes.alias("box"), F.coalesce("confidences", F.array().cast("array<double>")).alias("confidence"))
    return frames.select(*keys, F.posexplode(zipped).alias("line_no", "l")).select(*keys, "line_no", "l.line", "l.box", "l.confidence").where("line is not null")


def first_of_equal(lines: DataFrame, keys: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Lines of a frame without those equal to an earlier one but for blanks at the ends; blank lines stay."""
    key = F.trim(text)
    k = F.row_number().over(W.partitionBy(*keys, key).orderBy(*order))
    return lines.withColumn("__k", k).where((F.col("__k") == 1) | (key == "")).drop("__k")


def resolved_frames(frames: DataFrame, keys: list[str], dictionary: DataFrame, domain: DataFrame, table: DataFrame) -> DataFrame:
    """normalised frames with their lines corrected: the end of the chain; every distinct token is resolved once."""
    lines = frames.select(*keys, F.posexplode(F.arrays_zip(F.col("texts").alias("line"), F.col("bboxs").alias("box"))).alias("line_no", "l")).select(*keys, "line_no", "l.line", "l.box")
    lines = stored(lines.withColumn("__id", F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], F.col("line_no").cast("string"))), "lines")
    found = vocab.corrected_lines(lines, "__id", "line", dictionary, domain, table).select("__id", "corrected")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "box", "corrected")))
    return lines.join(found, "__id").groupBy(*keys).agg(ordered.alias("l")).select(*keys, F.transform("l", lambda x: x["box"]).alias("bboxs"), F.transform("l", lambda x: x["corrected"]).alias("texts"))


def normalised_frames(frames: DataFrame, keys: list[str], foreign: bool = False, frame_filters: tuple[LineTest, ...] = (), line_filters: tuple[LineTest, ...] = ()) -> DataFrame:
    """Frames ``(keys, bboxs, texts, confidences)`` with clean lines.

    frame_filters say of an array of texts, line_filters of a line, whether it
    stays; they stand beside those below.

    Garbage of repeated words goes; glued phrases become lines of their own with
    the box of the line; superscripts are written plainly; lines that aren't
    Vietnamese go unless foreign is set; of equal lines the first stays.  Frames
    without lines go.  Lines keep their order.
    """
    for stays in frame_filters:
        frames = frames.where(stays(F.col("texts")))
    lines = lines_of(frames, keys).where(~T.repetition("line", F.coalesce("confidence", F.lit(None).cast("double"))))
    parts = lines.select(*keys, "line_no", "box", F.posexplode(T.glued_parts(F.col("line"))).alias("part_no", "line"))
    parts = parts.withColumn("line", T.math_notation(F.trim("line"))).where("line <> ''")
    if not foreign:
        parts = parts.where(~T.foreign_line(F.col("line")))
    for stays in line_filters:
        parts = parts.where(stays(F.col("line")))
    parts = first_of_equal(parts, keys, ["line_no", "part_no"])
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "part_no", "box", "line")))
    return parts.groupBy(*keys).agg(ordered.alias("l")).select(*keys, F.transform("l", lambda x: x["box"]).alias("bboxs"), F.transform("l", lambda x: x["line"]).alias("texts"))
