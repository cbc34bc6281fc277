"""Best strictly ordered paths through scored frames as (max, +) products, for videos that are split over tasks.

A fragment is the best path of some consecutive events within a run of frames:
its score, a whole number, and its frames, last first.  A run's product holds the
fragments of all ranges of events; the product of two runs in a row takes, for
each range, the best way to part its events between them.  Of equal scores the
fragment of the earlier last frame wins, then of the earlier one before it, so
that products may be taken in any grouping.

A long video is cut into chunks of frames.  The best path of all is the product of
its chunks, taken as a tree; after its cells were taken out, only the chunks that
had them are multiplied anew.  The best path of each of many windows, whose ends
only move forward, is the product of what lies before and behind a fixed frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ranks import as_of, numbered
from framewright.scratch import stored

#: Frames of a chunk, chunks multiplied by one task, and whole numbers for a score of 1.
CHUNK, FAN, SCALE = 32_768, 256, 1e9
#: Videos whose chosen paths are broadcast at most.
MOST_BROADCAST = 100_000

#: A score and its frames, last first: (place, pos, ts).
Fragment = tuple[int, tuple]
EMPTY: Fragment = (0, ())


def better(x: Fragment | None, y: Fragment | None) -> Fragment | None:
    if x is None or y is None:
        return y if x is None else x
    return x if x[0] > y[0] or (x[0] == y[0] and x[1] <= y[1]) else y


def joined(x: Fragment | None, y: Fragment | None) -> Fragment | None:
    return None if x is None or y is None else (x[0] + y[0], y[1] + x[1])


def product(x: dict, y: dict, events: int) -> dict:
    """The product of two runs in a row: (a, b) -> the best fragment of events a to b - 1, where there is one."""
    out = {}
    for a in range(events):
        for b in range(a + 1, events + 1):
            best = None
            for c in range(a, b + 1):
                left, right = EMPTY if c == a else x.get((a, c)), EMPTY if c == b else y.get((c, b))
                best = better(best, joined(left, right))
            if best:
                out[a, b] = best
    return out


def whole(s: np.ndarray) -> np.ndarray:
    """Scores as whole numbers, -inf where there is none."""
    s = np.asarray(s, np.float64)
    return np.where(np.isfinite(s), np.rint(s * SCALE), -np.inf)


def run_product(s: np.ndarray, frames: list[tuple], align) -> dict:
    """The product of a run from its events x frames matrix of whole numbers; align finds the best path of a matrix."""
    out = {}
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            score, path = align(s[a:b])
            if path:
                out[a, b] = (int(score), tuple(frames[j] for j in reversed(path)))
    return out


def suffixes(s: np.ndarray, frames: list[tuple], first: int, stop: int) -> dict[int, list]:
    """For each i from first on, the fragments of the events 0 to c - 1 within the frames i to stop - 1, by c."""
    m = len(s)
    best: list[list] = [[EMPTY if a == b else None for b in range(m + 1)] for a in range(m + 1)]
    out = {stop: list(best[0])}
    for j in range(stop - 1, first - 1, -1):
        for a in range(m):
            if s[a, j] != -np.inf:
                own = (int(s[a, j]), (frames[j],))
                for b in range(a + 1, m + 1):
                    if best[a + 1][b] is not None:
                        best[a][b] = better(joined(own, best[a + 1][b]), best[a][b])
        out[j] = list(best[0])
    return out


def windows_best(s: np.ndarray, frames: list[tuple], windows: list[tuple[int, int]], left: dict[int, list] | None = None, between: dict | None = None) -> list[Fragment | None]:
    """The best path of each window (first, stop) of frames; both only grow from window to window.

    Two stacks: what lies before a fixed frame by its suffixes, what lies behind it
    by a prefix that grows; when a window starts behind it, its end is the next
    fixed frame.  Given the suffixes of an earlier run, windows start there, at
    frames numbered as there, and have the product ``between`` on their way here.
    """
    m, out = len(s), []
    pivot, at, before = (0, 0, left) if left is not None else (-1, -1, {})
    start = lambda: [[EMPTY if a == b else (between or {}).get((a, b)) for b in range(m + 1)] for a in range(m + 1)]
    prefix = start()
    for first, stop in windows:
        if left is None and first >= pivot:
            pivot = at = stop
            before, prefix = suffixes(s, frames, first, stop), start()
        for j in range(at, stop):
            for b in range(m, 0, -1):
                if s[b - 1, j] != -np.inf:
                    own = (int(s[b - 1, j]), (frames[j],))
                    for c in range(b):
                        if prefix[c][b - 1] is not None:
                            prefix[c][b] = better(prefix[c][b], joined(prefix[c][b - 1], own))
        at = max(at, stop)
        best = None
        for c in range(m, -1, -1):
            best = better(best, joined(before[first][c], prefix[c][m]))
        out.append(best)
    return out


_FRAGMENT = "a int, b int, score bigint, place array<bigint>, pos array<bigint>, ts array<double>"
_PRODUCT = f"product array<struct<{_FRAGMENT.replace(' int', ':int').replace(' bigint', ':bigint').replace(' array', ':array')}>>".replace(", ", ",")


def _rows(p: dict) -> list[dict]:
    return [{"a": a, "b": b, "score": f[0], **{k: [x[i] for x in f[1]] for i, k in enumerate(("place", "pos", "ts"))}} for (a, b), f in p.items()]


def _of_rows(rows: list[dict] | None) -> dict:
    return {(r["a"], r["b"]): (r["score"], tuple(zip(r["place"], r["pos"], r["ts"], strict=True))) for r in rows or ()}


def _frames_of(batch: pa.RecordBatch, row: int, side: str, events: int) -> tuple[np.ndarray, list[tuple]]:
    """A chunk's matrix and frames from its row of a column of structs."""
    cells = batch[side].slice(row, 1).flatten()
    column = lambda name: cells.field(name).to_numpy(zero_copy_only=False)
    s = np.array([column(f"s{i}") for i in range(events)], np.float64).reshape(events, -1)
    return whole(s), list(zip(column("place").tolist(), cells.field("pos").to_pylist(), column("ts").tolist(), strict=True))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def schema_of(kind: str, columns: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field("video_id", _ARROW[kind]), *(pa.field(*c) for c in columns)])


_PRODUCTS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("score", pa.int64()), ("place", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64())), ("ts", pa.list_(pa.float64()))]))
_PATH = [("score", pa.int64()), ("place", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64())), ("ts", pa.list_(pa.float64()))]
_PATH_DDL = "score bigint, place array<bigint>, pos array<bigint>, ts array<double>"


def chunks(placed: DataFrame, events: int) -> DataFrame:
    """``(video_id, place, pos, ts, s0 ..)`` -> video_id, chunk, frames: a row per CHUNK frames."""
    frame = F.struct("place", "pos", "ts", *[f"s{i}" for i in range(events)])
    return placed.groupBy("video_id", F.floor((F.col("place") - 1) / CHUNK).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(frame)).alias("frames"))


def _multiplied(chunked: DataFrame, taken: DataFrame, events: int, align) -> DataFrame:
    """Products of chunks without the cells of ``(video_id, chunk, event, place)``."""
    out = taken.groupBy("video_id", "chunk").agg(F.collect_list(F.struct("event", "place")).alias("taken"))
    kind = chunked.schema["video_id"].dataType.simpleString()
    schema = schema_of(kind, [("chunk", pa.int32()), ("product", _PRODUCTS)])

    def run(batches):
        for batch in batches:
            made = []
            for i, row in enumerate(batch.drop_columns(["frames"]).to_pylist()):
                s, frames = _frames_of(batch, i, "frames", events)
                for cell in row["taken"] or ():
                    s[cell["event"], cell["place"] - frames[0][0]] = -np.inf
                made.append({"video_id": row["video_id"], "chunk": row["chunk"], "product": _rows(run_product(s, frames, align))})
            yield pa.RecordBatch.from_pylist(made, schema)

    return chunked.join(out, ["video_id", "chunk"], "left").select("video_id", "chunk", "frames", "taken").mapInArrow(run, f"video_id {kind}, chunk int, {_PRODUCT}")


def _multiply(products: DataFrame, events: int, keys: list[str]) -> DataFrame:
    """video_id, the whole-number keys and the product of each group's chunks in order."""
    kind = products.schema["video_id"].dataType.simpleString()
    schema = schema_of(kind, [*((k, pa.int32()) for k in keys), ("product", _PRODUCTS)])
    gathered = products.groupBy("video_id", *keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "product"))).alias("all"))

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                total = _of_rows(row["all"][0]["product"])
                for other in row["all"][1:]:
                    total = product(total, _of_rows(other["product"]), events)
                made.append({"video_id": row["video_id"], **{k: row[k] for k in keys}, "product": _rows(total)})
            yield pa.RecordBatch.from_pylist(made, schema)

    return gathered.mapInArrow(run, f"video_id {kind}, " + ", ".join(f"{k} int" for k in keys) + f", {_PRODUCT}")


def tree(products: DataFrame, events: int, left: int) -> DataFrame:
    """(video_id, product): the products of whole videos up to chunk left, FAN chunks at a time."""
    while left:
        grouped = products.withColumn("group", F.floor(F.col("chunk") / FAN).cast("int"))
        products = _multiply(grouped, events, ["group"]).withColumnRenamed("group", "chunk")
        left //= FAN
    return products.select("video_id", "product")


def repeated(placed: DataFrame, events: int, times: int, align) -> DataFrame:
    """``(video_id, turn, score, place, pos, ts)``: each video's best path so many times, each without the cells of those before; arrays last frame first."""
    chunked = stored(chunks(placed, events), "chunks")
    taken = stored(placed.sparkSession.createDataFrame([], "chunk int, event int, place bigint").join(chunked.select("video_id").limit(0)), "taken")
    products, found = stored(_multiplied(chunked, taken.select("video_id", "chunk", "event", "place"), events, align), "products"), []
    last = products.agg(F.max("chunk")).collect()[0][0] or 0
    for turn in range(times):
        best = tree(products, events, last).select("video_id", F.explode(F.filter("product", lambda f: (f["a"] == 0) & (f["b"] == events))).alias("f"))
        found.append(stored(best.select("video_id", F.lit(turn).alias("turn"), "f.score", "f.place", "f.pos", "f.ts"), "paths"))
        if turn + 1 < times:
            every = found[0]
            for other in found[1:]:
                every = every.union(other)
            cells = every.select("video_id", F.posexplode("place").alias("back", "place"))
            cells = cells.select("video_id", F.floor((F.col("place") - 1) / CHUNK).cast("int").alias("chunk"), (F.lit(events - 1) - F.col("back")).alias("event"), "place")
            # chunks that the last path touched
            touched = found[-1].select("video_id", F.explode("place").alias("place")).select("video_id", F.floor((F.col("place") - 1) / CHUNK).cast("int").alias("chunk")).distinct()
            again = _multiplied(chunked.join(touched, ["video_id", "chunk"], "left_semi"), cells, events, align)
            products = stored(products.join(touched, ["video_id", "chunk"], "left_anti").union(again), "products")
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    return every


def windowed(placed: DataFrame, events: int, duration: float, align) -> DataFrame:
    """``(video_id, turn, score, place, pos, ts)``: the best path of each window that starts at a frame and lasts so long; of windows with one end the widest; turn is the window's first place."""
    chunked = stored(chunks(placed, events), "chunks")
    asked = placed.select("video_id", "place", F.col("ts").alias("from"), (F.col("ts") + F.lit(float(duration))).alias("ts"))
    # of frames at one time the last place counts
    last = as_of(placed.select("video_id", "ts", (-F.col("place")).alias("late")), asked.select("video_id", "ts"), "video_id", "ts", "late")
    ends = asked.join(last, ["video_id", "ts"]).select("video_id", F.col("place").alias("first"), (-F.col("before.late")).alias("last"))
    wide = ends.groupBy("video_id", "last").agg(F.min("first").alias("first")).where(F.col("last") - F.col("first") + 1 >= events)
    of = lambda c: F.floor((F.col(c) - 1) / CHUNK).cast("int")
    groups = wide.groupBy("video_id", of("first").alias("a"), of("last").alias("b")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("windows"))
    groups = stored(groups, "windows")
    named = lambda side, chunk: chunked.select("video_id", F.col("chunk").alias(chunk), F.col("frames").alias(side))
    far = groups.where("b - a > 1").select("video_id", "a", "b", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("chunk"))
    none = placed.sparkSession.createDataFrame([], "chunk int, event int, place bigint").join(chunked.select("video_id").limit(0)).select("video_id", "chunk", "event", "place")
    products = _multiplied(chunked.join(far.select("video_id", "chunk").distinct(), ["video_id", "chunk"], "left_semi"), none, events, align)
    between = _multiply(far.join(stored(products, "products"), ["video_id", "chunk"]), events, ["a", "b"])
    rows = groups.join(named("left", "a"), ["video_id", "a"]).join(named("right", "b"), ["video_id", "b"]).join(between, ["video_id", "a", "b"], "left")
    kind = placed.schema["video_id"].dataType.simpleString()
    schema = schema_of(kind, [("turn", pa.int64()), *_PATH])

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["left", "right"]).to_pylist()):
                s, frames = _frames_of(batch, i, "left", events)
                start = frames[0][0]
                if row["a"] == row["b"]:
                    best = windows_best(s, frames, [(w["first"] - start, w["last"] - start + 1) for w in row["windows"]])
                else:
                    before = suffixes(s, frames, row["windows"][0]["first"] - start, len(frames))
                    s, frames = _frames_of(batch, i, "right", events)
                    best = windows_best(s, frames, [(w["first"] - start, w["last"] - frames[0][0] + 1) for w in row["windows"]], before, _of_rows(row["product"]))
                found = [(w, f) for w, f in zip(row["windows"], best, strict=True) if f]
                made = [{"video_id": row["video_id"], "turn": w["first"], "score": f[0], **{k: [x[n] for x in f[1]] for n, k in enumerate(("place", "pos", "ts"))}} for w, f in found]
                yield pa.RecordBatch.from_pylist(made, schema)

    return rows.select("video_id", "a", "b", "windows", "left", "right", "product").mapInArrow(run, f"video_id {kind}, turn bigint, {_PATH_DDL}")


def placed_frames(scored: DataFrame, events: int) -> DataFrame:
    """``(video_id, pos, ts, s0 ..)`` with the place (1..) of each frame in its video in order of time and pos; stored."""
    return stored(numbered(scored, ["ts", "pos"], "place", ["video_id"]).select("video_id", F.col("place").cast("long").alias("place"), "pos", "ts", *[f"s{i}" for i in range(events)]), "frames")


def suppressed(paths: DataFrame, events: int, most: int, overlap: float) -> DataFrame:
    """Of each video's paths the best ones, at most so many: a chosen one removes those that share too many frames or too much time with it.

    A round of one aggregation for each path chosen, over whatever is left, so
    that the paths of a video needn't meet in one task.
    """
    left, chosen = paths.withColumn("start", F.get("ts", F.lit(events - 1))).withColumn("end", F.get("ts", F.lit(0))), []
    for turn in range(most):
        left = stored(left, "left")
        # of equal scores the earliest turn
        best = left.groupBy("video_id").agg(F.min_by(F.struct("turn", "score", "place", "pos", "ts", "start", "end"), F.struct(-F.col("score"), F.col("turn"))).alias("c"))
        best = stored(best, "chosen")
        chosen.append(best.select("video_id", "c.*"))
        if turn + 1 < most:
            other = F.broadcast(best) if best.count() <= MOST_BROADCAST else best
            shared = F.size(F.array_intersect("place", "c.place")) / events
            hull = F.greatest("end", "c.end") - F.least("start", "c.start")
            both = F.greatest(F.least("end", "c.end") - F.greatest("start", "c.start"), F.lit(0.0))
            far = (shared < overlap) & (F.when(hull > 1e-12, both / hull).otherwise(0.0) < overlap)
            left = left.join(other, "video_id").where(far).drop("c")
    every = chosen[0]
    for c in chosen[1:]:
        every = every.union(c)
    return every


__all__ = ["CHUNK", "placed_frames", "repeated", "suppressed", "windowed", "windows_best"]
