"""Incremental ingestion: a file stream that takes what is new, and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform=lambda df: df) -> None:
    """Take the files of source that earlier calls haven't, and append the transformed rows to sink."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream or table of events: key, start, end, n."""
    watermarked = events.withWatermark(time, late)
    found = watermarked.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
