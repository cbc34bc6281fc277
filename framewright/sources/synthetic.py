"""Seeded screen text and speech for tests and trials, by hashes of row numbers: equal seeds give equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "thành phố hôm nay tin tức thể thao bóng đá thời tiết mưa nắng giao thông trường học bệnh viện chợ đường cầu sông biển núi".split()
WIDTH, HEIGHT = 1280, 720


def _pick(seed: int, most: int, *keys) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(most)).cast("int")


def _sentence(seed: int, *keys) -> Column:
    size = _pick(seed, 6, *keys) + 2
    return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.get(F.lit(WORDS), _pick(seed + 1, len(WORDS), *keys, i))), " ")


def screen_text(spark: SparkSession, videos: int = 5, frames: int = 100, most_texts: int = 15, seed: int = 42) -> DataFrame:
    """OCR documents: 1 to most_texts lines a frame, each with a box within the picture."""
    f = spark.range(videos * frames).select(F.format_string("V%03d", F.floor(F.col("id") / frames)).alias("video_id"), F.format_string("%06d", F.col("id") % frames).alias("keyframe_id"), "id")
    numbers = F.sequence(F.lit(1), _pick(seed, most_texts, "id") + 1)

    def box(i: Column) -> Column:
        x, y = _pick(seed + 2, WIDTH - 100, "id", i), _pick(seed + 3, HEIGHT - 40, "id", i)
        return F.array(*[c.cast("double") for c in (x, y, x + 20 + _pick(seed + 4, 80, "id", i), y + 10 + _pick(seed + 5, 30, "id", i))])

    return f.select(F.lit("mock").alias("dataset"), "video_id", "keyframe_id", F.transform(numbers, box).alias("bboxs"), F.transform(numbers, lambda i: _sentence(seed + 6, "id", i)).alias("texts"))


def speech(spark: SparkSession, videos: int = 5, seconds: int = 600, seed: int = 42) -> DataFrame:
    """Speech segments of 3 to 8 seconds one after the other, up to the length of the video."""
    most = seconds // 3 + 1
    lengths = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: _pick(seed, 6, "id", i) + 3)
    stops = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    v = spark.range(videos).withColumn("stops", stops)
    parts = v.select("id", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("i", "start"), "stops").withColumn("end", F.get("stops", F.col("i") + 1)).where(F.col("end") <= seconds)
    return parts.select(F.lit("mock").alias("dataset"), F.format_string("V%03d", "id").alias("video_id"), F.col("start").cast("double").alias("start_time"), F.col("end").cast("double").alias("end_time"), _sentence(seed + 7, "id", "i").alias("text"))
