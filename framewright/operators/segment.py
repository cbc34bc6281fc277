"""Scenes from cut probabilities, chunks of scenes, cluster keyframes and greedy removal of look-alikes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scenes(cuts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(video_id, pos, p)`` -> video_id, start, end: scenes end at frames with p above the threshold.

    A scene starts after the cut before it; a cut at a scene's own first frame
    is passed over and leaves the start where it is: of cuts that follow each
    other every second one counts, from the first one on, or, where that is the
    video's first frame, from the second one on.  The rest is a scene, and a video
    without any is one scene.
    """
    video = W.partitionBy("video_id").orderBy("pos")
    cut = cuts.where(F.col("p") > threshold).select("video_id", F.col("pos").cast("int").alias("pos"))
    runs = cut.withColumn("__run", F.col("pos") - F.row_number().over(video))
    placed = runs.withColumn("__first", F.min("pos").over(W.partitionBy("video_id", "__run")))
    made = placed.where((F.col("pos") - F.col("__first")) % 2 == F.when(F.col("__first") == 0, 1).otherwise(0))
    ended = made.select("video_id", (F.coalesce(F.lag("pos").over(video), F.lit(-1)) + 1).alias("start"), F.col("pos").alias("end"))
    sizes = cuts.groupBy("video_id").agg((F.count("*") - 1).cast("int").alias("__last"))
    tails = sizes.join(made.groupBy("video_id").agg((F.max("pos") + 1).alias("__next")), "video_id", "left").withColumn("start", F.coalesce("__next", F.lit(0)))
    return ended.unionByName(tails.where(F.col("start") <= F.col("__last")).select("video_id", "start", F.col("__last").alias("end")))


def chunks(found: DataFrame, max_gap: int) -> DataFrame:
    """Scenes cut into pieces of at most max_gap + 1 frames."""
    pieces = found.withColumn("__c", F.explode(F.sequence("start", "end", F.lit(max_gap + 1))))
    return pieces.select("video_id", F.col("__c").alias("start"), F.least(F.col("__c") + max_gap, F.col("end")).alias("end"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, from their products."""
    lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    squares = lengths - 2 * a @ b.T
    return np.sqrt(np.where(squares > 1e-12 * lengths, squares, 0))


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The row of b nearest to each of a; of equal ones (to nine digits) the first."""
    return np.round(distances(a, b), 9).argmin(1)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b) over points: a to the own cluster's others, b to the nearest other cluster; 0 for single points."""
    d, names = distances(x, x), np.unique(labels)
    if not 2 <= len(names) < len(x):
        raise ValueError("as many clusters as from 2 to one less than the points are needed")
    sums = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    at = np.arange(len(x))
    a = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[at, own] = np.inf
    b = means.min(1)
    return float(np.where(sizes[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def spread_out(x: np.ndarray, most: int) -> np.ndarray:
    """The first row, then always the row farthest from those taken; fewer where all others coincide with some."""
    taken, far = [0], distances(x, x[:1])[:, 0]
    while len(taken) < most and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


def merged_step_by_step(centers: np.ndarray) -> Iterator[np.ndarray]:
    """The centers, and again with the two closest replaced by their mean, down to three."""
    while len(centers) > 2:
        yield centers
        apart = distances(centers, centers)
        np.fill_diagonal(apart, np.inf)
        pair = np.unravel_index(int(apart.argmin()), apart.shape)
        centers = np.vstack([np.delete(centers, pair, axis=0), centers[list(pair)].mean(axis=0)])


def cluster_keyframes(x: np.ndarray, least: int = 3) -> list[int]:
    """Places of the frames to keep.  Under `least` frames: the middle one.  Else ceil(sqrt n) centers are spread out and
    merged step by step; the nearest frames of those whose clusters have the best silhouette are kept."""
    n = len(x)
    if n < least:
        return [n // 2] if n else []
    first = spread_out(x, int(np.ceil(np.sqrt(n))))

    def rating(centers: np.ndarray) -> float:
        labels = nearest(x, centers)
        return silhouette(x, labels) if 2 <= len(np.unique(labels)) < n else -1.0

    best = max([first, *merged_step_by_step(first)], key=lambda c: rating(c) if len(c) > 2 else -1.0)
    return sorted({int(i) for i in nearest(best, x)})


def histogram(pixels: bytes, bins: int = 8) -> np.ndarray:
    """Counts of the colours of RGB pixels, bins a channel, scaled to 0 .. 1; values of 255 lie beyond the last bin."""
    rgb = np.frombuffer(pixels, np.uint8)[: len(pixels) // 3 * 3].reshape(-1, 3).astype(np.int64)
    inside = rgb[(rgb < 255).all(axis=1)] * bins // 255
    counts = np.bincount(inside @ np.array([bins * bins, bins, 1]), minlength=bins**3).astype(np.float64)
    low, high = counts.min(), counts.max()
    return (counts - low) / (high - low) if high > low else np.zeros_like(counts)


def histograms(frames: DataFrame, pixels: str) -> DataFrame:
    """frames with ``histogram`` instead of their pixels; frames without pixels go."""
    others = [c for c in frames.columns if c != pixels]

    def run(batches):
        for batch in batches:
            rows = [histogram(x) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*others, "histogram"])

    schema = frames.select(*others).withColumn("histogram", F.array().cast("array<double>")).schema
    return frames.where(F.col(pixels).isNotNull()).select(*others, pixels).mapInArrow(run, schema)


def keyframes(cuts: DataFrame, frames: DataFrame, threshold: float = 0.5, max_gap: int = 400, least: int = 3, alike: float = 0.95, min_bins: int = 10) -> DataFrame:
    """``(video_id, pos, p)`` and ``(video_id, pos, vector, pixels)`` -> video_id, pos, keyframe_id: scenes, cut into chunks, cluster keyframes of each, and of those the ones that don't look alike, numbered."""
    pieces = chunks(scenes(cuts, threshold), max_gap).withColumnRenamed("video_id", "__video")
    inside = frames.join(pieces, (F.col("video_id") == F.col("__video")) & F.col("pos").between(F.col("start"), F.col("end"))).select("video_id", "start", "pos", "vector")
    chosen = select_frames(inside, ["video_id", "start"], "pos", "vector", lambda x: cluster_keyframes(x, least)).select("video_id", "pos")
    seen = histograms(frames.join(chosen, ["video_id", "pos"], "left_semi").select("video_id", "pos", "pixels"), "pixels")
    kept = select_frames(seen, ["video_id"], "pos", "histogram", lambda x: distinct_in_order(x, alike, min_bins))
    return kept.withColumn("keyframe_id", F.row_number().over(W.partitionBy("video_id").orderBy("pos")) - 1)


def distinct_in_order(x: np.ndarray, threshold: float, min_bins: int) -> list[int]:
    """Places kept in order: more than min_bins values above 0, and cosine with every kept one at most the threshold."""
    kept: list[int] = []
    for i, v in enumerate(x):
        length = np.linalg.norm(v)
        if (v > 0).sum() <= min_bins:
            continue
        others = x[kept]
        norms = np.linalg.norm(others, axis=1) * length if kept else np.zeros(0)
        if not kept or not (np.divide(others @ v, norms, out=np.zeros(len(kept)), where=norms > 0) > threshold).any():
            kept.append(i)
    return kept


def select_frames(frames: DataFrame, group: list[str], order: str, vector: str, choose) -> DataFrame:
    """The rows of each group that `choose` keeps of its vectors in order; a group is one scene or shot and fits one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[choose(np.stack(pdf[vector].to_list()).astype(np.float64))][[*group, order]]

    rows = frames.select(*group, order, vector)
    return rows.groupBy(*group).applyInPandas(run, rows.select(*group, order).schema)
