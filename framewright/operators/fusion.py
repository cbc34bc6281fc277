"""Reciprocal rank fusion of ranked lists, and the identity of a frame across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators.ranks import numbered

IDENTITY = ("dataset", "video_id", "keyframe_id")


def identity(column: str, value: Column) -> Column:
    """Trimmed lower-case text, null as empty; keyframe ids that are numbers as whole numbers."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    if column != "keyframe_id":
        return F.lower(text)
    number = text.try_cast("double")
    return F.when(number.isNotNull(), number.cast("bigint").cast("string")).otherwise(F.lower(text))


def fuse(lists: list[tuple[DataFrame, str, float]], k: int = 60, top_k: int | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """Ranked lists with their labels and weights -> one ranking by the sum of weight / (k + rank).

    An item's identity is made of those identity columns that the lists have;
    matched_sources counts contributions, source_models are the sorted labels;
    the row shown is that of the first list, then rank.  Ties go to the row seen
    first.  group columns keep rankings apart.
    """
    parts = []
    for place, (df, label, weight) in enumerate(lists):
        have = [c for c in IDENTITY if c in df.columns]
        keys = F.concat_ws("\u0001", *[identity(c, F.col(c)) for c in have])
        parts.append(df.select(*group, keys.alias("__key"), F.struct(*[c for c in df.columns if c not in (*group, "rank")]).alias("__row"), F.col("rank").cast("long").alias("__rank"), F.lit(place).alias("__list"), F.lit(label).alias("__label"), F.lit(float(weight)).alias("__weight")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    fused = whole.groupBy(*group, "__key").agg(
        F.sum(F.col("__weight") / (k + F.col("__rank"))).alias("rrf_score"),
        F.count("*").alias("matched_sources"),
        F.array_sort(F.collect_set("__label")).alias("source_models"),
        F.min_by("__row", F.struct("__list", "__rank")).alias("__row"),
        F.min(F.struct("__list", "__rank")).alias("__seen"),
    )
    fused = fused.withColumn("rrf_score", F.round("rrf_score", 9))
    order = [F.desc("rrf_score"), "__seen", "__key"]
    shown = [*group, "__row.*", "rrf_score", "matched_sources", "source_models", "rank"]
    if top_k is None and not group:
        return numbered(fused, ["-rrf_score", "__seen", "__key"]).select(*shown)
    if not group:
        fused = fused.orderBy(*order).limit(top_k)
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select(*shown)


def fuse_candidates(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Per-event candidates of several models, fused by (video, keyframe, event); the best candidate score is kept."""
    return candidates.groupBy("video_id", "keyframe_id", "event_idx").agg(F.round(F.sum(1.0 / (k + F.col("candidate_rank"))), 9).alias("rrf_score"), F.array_sort(F.collect_set("model_key")).alias("source_models"), F.max("candidate_score").alias("candidate_score"))


def collisions(lists: list[tuple[DataFrame, str]]) -> DataFrame:
    """Frames that more than one list has, with the lists' names."""
    keyed = [df.select(F.concat_ws("/", *[identity(c, F.col(c)) for c in IDENTITY if c in df.columns]).alias("frame"), F.lit(label).alias("label")) for df, label in lists]
    whole = keyed[0]
    for p in keyed[1:]:
        whole = whole.union(p)
    return whole.groupBy("frame").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Ids of either run with where they occur (a, b, both) and whether their values agree."""
    x, y = a.select(key, F.col(value).alias("value_a"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    j = x.join(y, key, "full_outer")
    where = F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b").otherwise("both")
    return j.select(key, where.alias("found"), F.when(where == "both", F.col("value_a").eqNullSafe(F.col("value_b"))).alias("equal"))
