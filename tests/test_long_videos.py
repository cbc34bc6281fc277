"""Sequences of videos that are split over tasks, against those of one task and against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import maxplus, temporal


def best_of(s, frames, a, b):
    """The best path of events a to b - 1 by trying all; of equal sums that of the earliest last frames."""
    found = []
    for path in itertools.combinations(range(s.shape[1]), b - a):
        score = sum(s[a + i, j] for i, j in enumerate(path))
        if score > -np.inf:
            found.append((-score, tuple(frames[j] for j in reversed(path))))
    return (int(-min(found)[0]), min(found)[1]) if found else None


@pytest.mark.parametrize("seed", range(6))
def test_products_in_any_grouping(seed):
    r = np.random.default_rng(seed)
    s = np.where(r.random((3, 9)) < 0.3, -np.inf, r.integers(0, 4, (3, 9)).astype(float))  # many ties
    frames = [(j, j, float(j)) for j in range(9)]
    expected = {(a, b): f for a in range(3) for b in range(a + 1, 4) if (f := best_of(s, frames, a, b))}
    assert maxplus.run_product(s, frames, temporal.align) == expected
    parts = [maxplus.run_product(s[:, i:j], frames[i:j], temporal.align) for i, j in ((0, 2), (2, 3), (3, 7), (7, 9))]
    left = maxplus.product(maxplus.product(maxplus.product(parts[0], parts[1], 3), parts[2], 3), parts[3], 3)
    right = maxplus.product(parts[0], maxplus.product(parts[1], maxplus.product(parts[2], parts[3], 3), 3), 3)
    assert left == right == expected


@pytest.mark.parametrize("seed", range(4))
def test_windows_by_two_stacks(seed):
    r = np.random.default_rng(seed)
    s = np.where(r.random((2, 30)) < 0.2, -np.inf, r.integers(0, 5, (2, 30)).astype(float))
    frames, first, stop, windows = [(j,) for j in range(30)], 0, 1, []
    while first < 30:
        windows.append((first, stop))
        first = min(30, first + int(r.integers(0, 4)))
        stop = min(30, max(stop + int(r.integers(0, 5)), first + 1))
        if len(windows) > 60:
            break
    assert maxplus.windows_best(s, frames, windows) == [best_of(s[:, a:b], frames[a:b], 0, 2) for a, b in windows]


def video(name, n, seed, events=3):
    """Frames with repeated and null times and scores of few values."""
    rng = random.Random(seed)
    t = 0.0
    for i in range(n):
        t += rng.choice([0, 0.5, 1, 3])
        yield (name, i, None if i < 2 else t, *[None if rng.random() < 0.1 else rng.randrange(16) / 8 for _ in range(events)])


@pytest.mark.parametrize("duration", [None, 4.0, 60.0, 1e6])
def test_chunks_give_what_one_task_gives(spark, monkeypatch, duration):
    rows = [*video("hot", 150, 1), *video("b", 40, 2), *video("short", 9, 3), *video("tiny", 2, 4)]
    df = spark.createDataFrame(rows, "video_id string, pos long, ts double, s0 double, s1 double, s2 double").repartition(4)
    expected = [tuple(r) for r in temporal.sequences(df, 3, duration).orderBy("rank").collect()]
    monkeypatch.setattr(maxplus, "CHUNK", 16)
    monkeypatch.setattr(maxplus, "FAN", 3)
    got = [tuple(r) for r in temporal.sequences(df, 3, duration).orderBy("rank").collect()]
    assert got == expected and len({r[0] for r in got}) == 3


def test_a_long_video_is_several_tasks(spark):
    """Of 60,000 frames of one video, no task of the search has more than a chunk."""
    n = 60_000
    df = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("pos"), (F.col("id") / 10).alias("ts"), *[(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(100_000)) / 100_000.0).alias(f"s{k}") for k in range(2)])
    placed = maxplus.placed_frames(df, 2)
    sizes = [r.n for r in maxplus.chunks(placed, 2).select(F.size("frames").alias("n")).collect()]
    assert max(sizes) == maxplus.CHUNK and len(sizes) == -(-n // maxplus.CHUNK)
    got = temporal.sequences(df, 2).orderBy("rank").collect()
    rows = df.orderBy("pos").toPandas()
    expected = temporal.k_best(rows[["s0", "s1"]].to_numpy().T, rows["ts"].to_numpy(), None)
    assert [(r.path, r.score, r.start, r.end) for r in got] == [(path, round(score, 6), a, b) for score, path, a, b in expected]
