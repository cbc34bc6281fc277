"""Schemas, and adapters that present the provided tables as the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METADATA = (
    "dataset string, video_id string, keyframe_id string, keyframe_id_int int, source_name string, frame_idx int, timestamp_sec double, "
    "fps double, keyframe_path string, embedding_path string, map_path string"
)
DISPLAY = ("dataset", "video_id", "keyframe_id", "source_name", "frame_idx", "timestamp_sec", "fps", "keyframe_path", "embedding_path")
KEYFRAME_MAP = "keyframe_id int, video_id string, frame_idx int, timestamp_sec double, fps double"
OCR_DOCUMENT = "dataset string, video_id string, keyframe_id string, bboxs array<array<double>>, texts array<string>"
ASR_SEGMENT = "dataset string, video_id string, start_time double, end_time double, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as keyframes: the label is the video, the place within it the second."""
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select("vec_id", F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("keyframe_id"), place.alias("pos"), place.cast("double").alias("timestamp_sec"), "embedding")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames in the metadata schema; every seventh row has no timestamp, so that it comes from frame_idx and fps."""
    f = frames(spark, sf_dir)
    name = F.lpad(F.col("vec_id").cast("string"), 6, "0")
    return f.select(
        F.lit("emb").alias("dataset"), "video_id", name.alias("keyframe_id"), F.col("vec_id").cast("int").alias("keyframe_id_int"), name.alias("source_name"), (F.col("pos") * 25).cast("int").alias("frame_idx"),
        F.when(F.col("vec_id") % 7 != 0, F.col("timestamp_sec")).alias("timestamp_sec"), F.lit(25.0).alias("fps"), F.concat_ws("/", F.lit("keyframes/emb"), "video_id", F.concat(name, F.lit(".jpg"))).alias("keyframe_path"),
        F.concat_ws("/", F.lit("embeddings/emb"), "video_id", F.concat(name, F.lit(".npy"))).alias("embedding_path"), F.concat(F.lit("maps/emb/"), "video_id", F.lit(".csv")).alias("map_path"), "vec_id",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as speech segments: a turn is a second of its conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("chat").alias("dataset"), F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1).cast("double").alias("end_time"), "text")


def scored_events(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """events as a score matrix: the user is the video, time the order, the i-th kind the i-th query event, value the score."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("video_id"), place.alias("pos"), seconds.alias("ts"), *[F.when(F.col("event_type") == k, F.col("value")).alias(f"s{i}") for i, k in enumerate(kinds)])
