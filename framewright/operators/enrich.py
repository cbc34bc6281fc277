"""Joins of hits with frames: by key, by point in interval, nearest, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import vector
from framewright.operators.ranks import as_of, numbered
from framewright.scratch import stored


def timestamp(ts: Column, frame_idx: Column, fps: Column) -> Column:
    """Seconds of a frame: its timestamp, else frame number over rate; null without either."""
    return F.coalesce(ts, F.try_divide(frame_idx.cast("double"), fps))


def frame_key(c: Column, otherwise: int | None) -> Column:
    """A keyframe id as a whole number; text that isn't one gives `otherwise`."""
    number = c.cast("string").try_cast("double").cast("bigint")
    return number if otherwise is None else F.coalesce(number, F.lit(otherwise).cast("bigint"))


def of_event(frames: DataFrame, event: int, order: list[str]) -> DataFrame:
    """One source's frames that belong to an event (sub_query_idx, where there is one and it isn't null, says to which), ranked anew in order of columns."""
    if "sub_query_idx" in frames.columns:
        frames = frames.where(F.coalesce(F.col("sub_query_idx").cast("int"), F.lit(event)) == event).drop("sub_query_idx")
    return numbered(frames.drop("rank"), order).withColumn("sub_query_idx", F.lit(event))


def normalised(hits: DataFrame) -> DataFrame:
    """Hits with their score over the largest one of all (1 where that is 0)."""
    best = hits.agg(F.max("score").alias("__max"))
    return hits.join(F.broadcast(best)).withColumn("normalised_score", F.round(F.col("score") / F.when(F.col("__max") == 0, 1.0).otherwise(F.col("__max")), 6)).drop("__max")  # one row


def ocr_hits(hits: DataFrame, metadata: DataFrame, row_id: str, top_k: int) -> DataFrame:
    """Hits ``(video_id, keyframe_id, score)`` with their frame; those without one go, after scores were normalised.

    Of metadata rows with the same video and number the last one by row_id counts.
    """
    last = metadata.withColumn("__key", frame_key(F.col("keyframe_id"), -1)).groupBy("video_id", "__key").agg(F.max_by(F.struct(*[c for c in metadata.columns if c != "video_id"]), row_id).alias("meta"))
    keyed = normalised(hits).withColumn("__key", frame_key(F.col("keyframe_id"), None)).where("__key is not null").drop("keyframe_id")
    found = keyed.join(last, ["video_id", "__key"]).select("video_id", "meta.*", F.col("score").alias("ocr_score"), "normalised_score")
    order = [F.desc("normalised_score"), "video_id", row_id]
    return found.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def overlapping(a: DataFrame, b: DataFrame, key: str, left: tuple[str, str], right: tuple[str, str], width: float | None = None) -> DataFrame:
    """Rows of a joined with those of b of the same key whose intervals (start and end columns, ends included; equal for points) meet.

    Columns of both must differ but for the key.  Both sides are cut into time
    bins and meet by key and bin, so that a key of any length is spread over
    tasks; a pair counts in the first bin that it shares.  Bins are as wide as the
    intervals are long in the mean, so that a side has two rows a bin and interval
    or so.  Rows without a key or an end, or that end before they start, meet none.
    """
    whole = lambda d, ends: d.where(F.col(key).isNotNull() & (F.col(ends[0]) <= F.col(ends[1])))
    a, b = whole(a, left), whole(b, right)
    if width is None:
        lengths = [d.select((F.col(e[1]) - F.col(e[0])).cast("double").alias("n")) for d, e in ((a, left), (b, right))]
        width = lengths[0].union(lengths[1]).where("n > 0").agg(F.avg("n")).collect()[0][0] or 1.0
    number = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    binned = lambda d, ends: d.withColumn("__bin", F.explode(F.sequence(number(ends[0]), number(ends[1]))))
    meet = (F.col(left[0]) <= F.col(right[1])) & (F.col(right[0]) <= F.col(left[1])) & (F.col("__bin") == F.greatest(number(left[0]), number(right[0])))
    return binned(a, left).join(binned(b, right), [key, "__bin"]).where(meet).drop("__bin")


def asr_hits(hits: DataFrame, frames: DataFrame, row_id: str, top_k: int, most_frames: int = 50) -> DataFrame:
    """Segments ``(segment_id, video_id, start_time, end_time, score, rank)`` with the frames within them, both ends included.

    A segment keeps its first frames in order of row_id, and shows the middle one
    of those; segments without frames go, and top_k counts the others by rank.
    Segments and frames meet by video and time bin; a segment's first frames are
    taken of each of many parts before they meet.
    """
    h = normalised(hits).withColumnRenamed("rank", "hit_rank").select("segment_id", "video_id", "start_time", "end_time", "score", "normalised_score", "hit_rank")
    f = frames.select("video_id", F.col("ts").alias("__ts"), F.col(row_id).alias("frame"))
    each = overlapping(h, f, "video_id", ("start_time", "end_time"), ("__ts", "__ts"))
    first = lambda d, keys: d.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("frame"))).where(F.col("__k") <= most_frames)
    placed = first(first(each.withColumn("__part", F.pmod(F.xxhash64("frame"), F.lit(64))), ["segment_id", "__part"]), ["segment_id"])
    whole = placed.groupBy("segment_id", "video_id", "start_time", "end_time", "score", "normalised_score", "hit_rank").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    best = whole.orderBy("hit_rank", "segment_id").limit(top_k)
    return best.withColumn("cover", F.get("frames", F.floor(F.size("frames") / 2).cast("int"))).withColumn("rank", F.row_number().over(W.orderBy("hit_rank", "segment_id"))).drop("hit_rank")


def videos_of(frames: DataFrame, least: int) -> DataFrame:
    """Frames of the videos that have so many of them."""
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return frames.join(sizes, "video_id", "left_semi")


def exact_frames(frames: DataFrame, video: str, first: int, last: int) -> DataFrame:
    """The frames of a video by number."""
    return frames.where((F.col("video_id") == video) & frame_key(F.col("keyframe_id"), -1).between(first, last))


def candidate_scores(vectors: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """vec_id, query_id, score of every candidate ``(vec_id)`` with every one of a plan's few queries ``(query_id, vector)``."""
    each = vectors.join(candidates.select("vec_id").distinct(), "vec_id", "left_semi").join(F.broadcast(queries))  # a row per event of a query
    return each.select("vec_id", "query_id", F.round(vector.dot(F.col("vector"), F.col("embedding")), 6).alias("score"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order of columns."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k")


def timestamp_quality(frames: DataFrame) -> DataFrame:
    """How many frames of each video have no timestamp, 0, or more."""
    ts = F.col("timestamp_sec")
    return frames.groupBy("video_id").agg(F.count_if(ts.isNull()).alias("nulls"), F.count_if(ts == 0).alias("zeros"), F.count_if(ts > 0).alias("positive"))


def with_map(vectors: DataFrame, maps: DataFrame, row_id: str) -> DataFrame:
    """Vectors ``(video_id, keyframe, frame_no)`` with their map row: by keyframe id, else by frame number; the first row counts."""
    cols = [c for c in maps.columns if c not in ("video_id", "keyframe_id", "frame_idx", row_id)]
    one = lambda by, name: maps.groupBy(F.col("video_id").alias("__video"), F.col(by).alias("__at")).agg(F.min_by(F.struct(*cols), row_id).alias(name))
    j = vectors.join(one("keyframe_id", "__exact"), (F.col("video_id") == F.col("__video")) & (F.col("keyframe") == F.col("__at")), "left").drop("__video", "__at")
    j = j.join(one("frame_idx", "__frame"), (F.col("video_id") == F.col("__video")) & (F.col("frame_no") == F.col("__at")), "left").drop("__video", "__at")
    return j.withColumn("__m", F.coalesce("__exact", "__frame")).select(*vectors.columns, *[F.col(f"__m.{c}").alias(c) for c in cols])


def nearest_frame(frames: DataFrame, wanted: DataFrame, value: str, row_id: str) -> DataFrame:
    """For each row of ``(video_id, target)`` the frame of its video nearest to it by value; ties go to the first row.

    Only the frames next to a target on either side are compared (ranks.as_of).
    """
    rows = frames.select("video_id", F.col(value).cast("double").alias("target"), row_id)
    found = as_of(rows, wanted.select("video_id", F.col("target").cast("double").alias("target")), "video_id", "target", row_id)
    near = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.target") - F.col("target")).alias("far"), F.col(f"{side}.{row_id}").alias("row")))
    return found.select("video_id", "target", F.array_min(F.filter(F.array(near("before"), near("after")), lambda x: x.isNotNull()))["row"].alias(row_id)).where(F.col(row_id).isNotNull())


def neighbours(frames: DataFrame, centers: DataFrame, row_id: str, radius: int) -> DataFrame:
    """Frames up to radius places before and after each center of its video, in order of row_id; radius is held within 1 and 50.

    Frames are numbered by ranges; a center asks for 2 radius + 1 places, and
    places meet by video and number, so that no video is held together.
    """
    radius = min(50, max(1, radius))
    placed = stored(numbered(frames.select("video_id", row_id), [row_id], "__at", ["video_id"]), "places")
    mid = placed.join(centers.withColumnRenamed("center", row_id), ["video_id", row_id]).withColumnRenamed(row_id, "center")
    asked = mid.withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("__at", F.col("__at") + F.col("offset"))
    return placed.join(asked, ["video_id", "__at"]).select("video_id", "center", row_id, F.col("offset").cast("int").alias("offset"))
