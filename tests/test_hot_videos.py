"""Joins in time where one video holds nearly all rows: results as by plain loops, plans that don't hold a video together."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewright.operators import enrich, ranks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def join_keys(df):
    """The columns on both sides of each equality of each join."""
    return [re.findall(r"\((\w+)#\d+L? <?=>? ?(\w+)#\d+L?\)", line) for line in plan(df).split("\n") if re.search(r"\bJoin (Inner|Left)", line)]


@pytest.fixture(scope="module")
def hot(spark):
    """10,000 frames of one video at repeated and null times, and a few others."""
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([None, rng.randrange(4000) / 4])) for i in range(10_000)]
    rows += [(v, 20_000 + i, float(i)) for v, n in (("a", 3), ("b", 1)) for i in range(n)] + [(None, 30_000, 1.0)]
    return rows, spark.createDataFrame(rows, "video_id string, vec_id long, ts double").repartition(8)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_frame_of_a_hot_video(spark, hot, uncoalesced):
    rows, frames = hot
    rng = random.Random(4)
    asked = [("hot", rng.randrange(-40, 9000) / 8) for _ in range(3000)] + [("a", 0.5), ("a", -1.0), ("b", 7.0), ("none", 1.0), (None, 1.0), ("hot", None)] + [("hot", 5.0)] * 50
    got = enrich.nearest_frame(frames, spark.createDataFrame(asked, "video_id string, target double"), "ts", "vec_id")
    by = {}
    for v, i, t in rows:
        if v is not None and t is not None:
            by.setdefault(v, []).append((t, i))
    expected = {(v, x): min((abs(t - x), i) for t, i in by[v])[1] for v, x in asked if v in by and x is not None}
    rows = got.collect()
    assert {(r.video_id, r.target): r.vec_id for r in rows} == expected and len(rows) == len(expected)
    assert all(any("__r" in pair for pair in keys) for keys in join_keys(got))


def test_ranges_part_a_group(spark, hot, uncoalesced):
    dealt = ranks.by_ranges(hot[1].where("ts is not null"), ["ts"], ["video_id"])
    per_range = [r["count"] for r in dealt.where("video_id = 'hot'").groupBy("__range").count().collect()]
    assert len(per_range) >= 4 and max(per_range) < 0.5 * sum(per_range)


def test_neighbours_of_a_hot_video(spark, hot, uncoalesced):
    rows, frames = hot
    centers = frames.where("vec_id % 3 = 0").select("video_id", F.col("vec_id").alias("center"))
    got = enrich.neighbours(frames.drop("ts"), centers, "vec_id", 2)
    of = {}
    for v, i, _ in rows:
        of.setdefault(v, []).append(i)
    expected = set()
    for v, ids in of.items():
        ids.sort()
        for k, i in enumerate(ids):
            if i % 3 == 0 and v is not None:
                expected |= {(v, i, ids[k + d], d) for d in range(-2, 3) if 0 <= k + d < len(ids)}
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)
    assert all(len(keys) >= 2 for keys in join_keys(got)) and join_keys(got)


def test_numbers_within_groups(spark, hot, uncoalesced):
    got = ranks.numbered(hot[1].drop("ts"), ["-vec_id"], "k", ["video_id"]).collect()
    assert len(got) == len(hot[0]) and all(r.k == 10_000 - r.vec_id for r in got if r.video_id == "hot")
    assert {(r.video_id, r.k) for r in got if r.video_id != "hot"} == {("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1)}


@pytest.mark.parametrize("width", [None, 0.25, 10_000.0])
def test_overlapping_intervals(spark, width):
    rng = random.Random(5)
    side = lambda n: [(rng.choice(["hot"] * 8 + ["x", None]), i, s, s + rng.choice([0, 0, 1, 2.5, 40, -1])) for i in range(n) for s in [rng.randrange(-200, 1200) / 2]]
    a, b = side(400) + [("hot", 400, None, 1.0), ("hot", 401, -1e3, 1e3)], side(400)
    left = spark.createDataFrame(a, "video_id string, i long, s double, e double")
    right = spark.createDataFrame(b, "video_id string, j long, from double, to double")
    got = enrich.overlapping(left, right, "video_id", ("s", "e"), ("from", "to"), width)
    meets = lambda x, y: None not in (x[0], x[2], y[2]) and x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    expected = sorted((x[1], y[1]) for x in a for y in b if meets(x, y))
    assert sorted((r.i, r.j) for r in got.collect()) == expected and len(expected) > 1000
    assert all(sum("__bin" in pair for pair in keys) == 1 and len(keys) >= 2 for keys in join_keys(got))


def test_speech_hits_of_a_hot_video(spark):
    frames = spark.createDataFrame([("hot", i, i / 4) for i in range(10_000)], "video_id string, vec_id long, ts double")
    hits = [(f"s{k}", "hot", k * 5.0, k * 5.0 + (2500.0 if k == 0 else 1.0), 600.0 - k, k + 1) for k in range(500)]
    got = enrich.asr_hits(spark.createDataFrame(hits, "segment_id string, video_id string, start_time double, end_time double, score double, rank long"), frames, "vec_id", 3).collect()
    assert [(r.segment_id, r.frames[0], len(r.frames), r.cover, r["rank"]) for r in got] == [("s0", 0, 50, 25, 1), ("s1", 20, 5, 22, 2), ("s2", 40, 5, 42, 3)]
