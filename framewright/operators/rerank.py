"""Criterion scores of a judging model: tolerant parsing, weighting, blending, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import once
from framewright.operators.ranks import numbered

#: Criteria with their weights, decision thresholds, and the scores that stand for a bare yes or no.
WEIGHTS = {
    "object_match": 0.25, "action_match": 0.20, "scene_match": 0.15, "attribute_match": 0.10, "relation_match": 0.10,
    "lighting_match": 0.05, "count_match": 0.05, "text_match": 0.04, "emotion_match": 0.03, "style_match": 0.03,
}
DECISIONS = ((0.75, "strong"), (0.45, "relevant"), (0.20, "weak"))
ALPHA, YES, NO = 0.4, 0.75, 0.10
YES_NO = ("object_match", "action_match", "scene_match", "attribute_match", "relation_match")


def _named_numbers(text: Column) -> Column:
    """Array of (name, value): every name in the text that a colon and a number follow, in order."""
    pair = F.lit(r'(\w+)"?\s*:\s*(\d+(?:[.]\d*)?)')
    return F.zip_with(F.regexp_extract_all(text, pair, F.lit(1)), F.regexp_extract_all(text, pair, F.lit(2)), lambda name, n: F.struct(name.alias("name"), n.try_cast("double").alias("n")))


def parsed(raw: Column) -> Column:
    """struct of the criteria, held within 0 and 1 (absent: 0), confidence (0.5), explanation (at most 300 characters), and
    whether any criterion was there.  Whole, broken and fenced JSON and plain "name: number" text are read alike; an answer
    that starts with a number goes on from the first criterion's name, and the first number of a name counts."""
    bare = F.trim(F.replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    text = F.when(bare.rlike("^[0-9]"), F.concat(F.lit(f"{next(iter(WEIGHTS))}:"), bare)).otherwise(bare)

    def judged(numbers: Column) -> Column:
        value = lambda name: F.get(F.filter(numbers, lambda x: x["name"] == name), F.lit(0))["n"]
        held = lambda name, otherwise: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value(name), F.lit(otherwise))))
        some = F.exists(numbers, lambda x: x["name"].isin(*WEIGHTS))
        said = F.coalesce(F.get_json_object(text, "$.explanation"), F.regexp_extract(text, 'explanation"\\s*:\\s*"([^"]*)', 1))
        return F.struct(
            *[held(name, 0.0).alias(name) for name in WEIGHTS],
            F.when(some, held("confidence", 0.5)).otherwise(0.0).alias("confidence"),
            F.when(some, F.left(said, F.lit(300))).otherwise("parse_error").alias("explanation"),
            some.alias("parsed"),
        )

    return once(_named_numbers(text), judged)


def with_fallback(scores: Column, answer: Column) -> Column:
    """scores, or, where they weren't parsed and there is a yes-or-no answer, flat ones of it."""
    flat = F.when(F.lower(F.trim(answer)).startswith("yes"), YES).otherwise(NO)
    said = F.when(F.lower(F.trim(answer)).startswith("yes"), "fallback:YES").otherwise("fallback:NO")
    other = F.struct(*[(flat if k in YES_NO else F.lit(0.0)).alias(k) for k in WEIGHTS], F.lit(0.5).alias("confidence"), said.alias("explanation"), F.lit(False).alias("parsed"))
    return F.when(scores["parsed"] | answer.isNull(), scores).otherwise(other)


def relevance(scores: Column) -> Column:
    return reduce(lambda s, k: s + WEIGHTS[k] * scores[k], WEIGHTS, F.lit(0.0))


def decision(score: Column) -> Column:
    return reduce(lambda c, x: c.when(score >= x[0], x[1]), DECISIONS[1:], F.when(score >= DECISIONS[0][0], DECISIONS[0][1])).otherwise("irrelevant")


def final_score(clip: Column, relevance_score: Column, alpha: float = ALPHA) -> Column:
    return F.round(alpha * clip + (1 - alpha) * relevance_score, 4)


def reranked(rows: DataFrame, keys: list[str], raw: str, clip: str, answer: str | None = None) -> DataFrame:
    """A row per key with relevance_score, decision, confidence, final_score and rank; several rows of a key are frames of a
    sequence, whose criteria are averaged first."""
    scores = parsed(F.col(raw)) if answer is None else with_fallback(parsed(F.col(raw)), F.col(answer))
    each = rows.select(*keys, clip, scores.alias("s"))
    whole = each.groupBy(*keys).agg(F.struct(*[F.avg(f"s.{k}").alias(k) for k in WEIGHTS]).alias("s"), F.avg("s.confidence").alias("confidence"), F.max(clip).alias("clip"))
    r = relevance(F.col("s"))
    out = whole.select(*keys, F.round(r, 4).alias("relevance_score"), decision(r).alias("decision"), F.round("confidence", 4).alias("confidence"), final_score(F.col("clip"), r).alias("final_score"))
    return numbered(out, ["-final_score", *keys])


def picture_grid(width: Column, height: Column, most: int = 12, tile: int = 448) -> Column:
    """struct(columns, rows) of at most so many tiles, of the shape nearest to the picture's.

    Of grids that are equally near, the largest that the picture fills by half;
    if it fills none, the smallest.
    """
    grids = F.lit([f"{c},{r}" for c in range(1, most + 1) for r in range(1, most // c + 1)])

    def rated(grid: Column) -> Column:
        columns, rows = (F.get(F.split(grid, ","), F.lit(k)).cast("int") for k in (0, 1))
        filled = width * height > columns * rows * (tile * tile / 2)
        apart = F.abs(width / height - columns / rows)
        return F.struct(apart.alias("apart"), F.when(filled, -columns * rows).otherwise(columns * rows).alias("size"), columns.alias("columns"), rows.alias("rows"))

    return once(F.array_min(F.transform(grids, rated)), lambda best: F.struct(best["columns"].alias("columns"), best["rows"].alias("rows")))
