"""Vectors: normalisation, exact and pruned nearest neighbours, multi-query aggregation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.text import once
from framewright.scratch import stored

#: Query vectors of a block, which is sent to every task; scores of a matrix product (32 MB).
MOST_QUERIES, SCORES = 10_000, 1 << 22


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalise(v: Column, floor: float = 1e-12) -> Column:
    """v over the larger of its length and floor."""
    return once(v, lambda a: once(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x.cast("double") / n)))


def unit_or_same(v: Column, floor: float = 1e-12) -> Column:
    """v at unit length, or unchanged where it is no longer than floor."""
    return F.when(norm(v) <= floor, F.transform(v, lambda x: x.cast("double"))).otherwise(l2_normalise(v, floor))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def query_rows(queries: DataFrame, query_id: str = "query_id", vector: str = "vector") -> tuple[list, np.ndarray]:
    """The ids and the matrix of a block of query vectors."""
    rows = queries.select(query_id, vector).orderBy(query_id).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors in one block")
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row, ties by id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), max(scores.shape[1], 1))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _scored(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of vectors for queries to six digits, in one matrix."""
    s = q @ x.T
    if metric == "l2":
        s *= -2
        s += (q**2).sum(1)[:, None]
        s += (x**2).sum(1)[None, :]
        np.negative(s, out=s)
    return np.round(s, 6, out=s)


class _Kept:
    """The best k of each query over all that a task has seen."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, np.zeros((queries, k), bool)
        self.scores, self.ids = np.zeros((queries, k)), np.zeros((queries, k), np.int64)

    def add(self, asking: np.ndarray, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Up to k more of each asking query, by row in order."""
        place = np.arange(len(row)) - np.searchsorted(row, row)
        more = [np.zeros((len(asking), self.k), a.dtype) for a in (self.found, self.scores, self.ids)]
        for into, value in zip(more, (True, scores, ids), strict=True):
            into[row, place] = value
        found, score, vec = (np.concatenate([have[asking], new], 1) for have, new in zip((self.found, self.scores, self.ids), more, strict=True))
        order = np.lexsort((vec, -score, ~found), axis=1)[:, : self.k]
        for have, both in zip((self.found, self.scores, self.ids), (found, score, vec), strict=True):
            have[asking] = np.take_along_axis(both, order, 1)

    def rows(self) -> pa.RecordBatch:
        q, _ = np.nonzero(self.found)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(self.ids[self.found]), pa.array(self.scores[self.found])], names=["q", "vec_id", "score"])


def _searcher(shared, k: int, metric: str):
    """The best k of each task for each query; with cells, for the queries that probe the row's cell."""

    def run(batches):
        matrix, probed = shared.value
        kept = _Kept(len(matrix), k)
        for batch in batches:
            all_ids, all_x = batch.column(0).to_numpy(), _matrix(batch.column(1)) if batch.num_rows else None
            cells = batch.column(2).to_numpy() if probed is not None else np.zeros(batch.num_rows, int)
            for cell in np.unique(cells):
                asking = np.arange(len(matrix)) if probed is None else np.flatnonzero(probed[:, cell])
                here = np.flatnonzero(cells == cell)
                q = matrix[asking]
                step = max(1, SCORES // max(len(q), 1))
                for a in range(0, len(here) if len(q) else 0, step):
                    ids, x = all_ids[here[a : a + step]], all_x[here[a : a + step]]
                    s = _scored(q, x, metric)
                    row, col = _best(s, ids, k)
                    kept.add(asking, row, s[row, col], ids[col])
        yield kept.rows()

    return run


def _blocks(queries: DataFrame, search) -> DataFrame:
    """search() of each block of at most MOST_QUERIES queries, dealt by a hash of their ids.

    Of several blocks each is searched and written before the next one's vectors
    are sent, so that the tasks hold one block at a time, as does the driver.
    """
    n = queries.count()
    blocks = 1 if n <= MOST_QUERIES else -(-n * 5 // (4 * MOST_QUERIES)) + 1
    if blocks == 1:
        return search(queries)[0]
    block, parts = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), []
    for b in range(blocks):
        found, sent = search(queries.where(block == b))
        parts.append(stored(found, "nearest"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(vec_id, embedding)`` and ``(query_id, vector)`` -> query_id, vec_id, score, rank: the best k of each query.

    cosine is the inner product of unit vectors, larger is better; l2 is the
    squared distance, smaller is better.  Queries go in blocks of MOST_QUERIES to
    all tasks; there each batch of vectors is a matrix product and a task keeps its
    best k, so that only those are shuffled; scores count to six digits, ties go to the
    smaller vec_id.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    return _blocks(queries, lambda some: _nearest(vectors, some, k, metric, None))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str, probe):
    """The best k of a block of queries, and the broadcast that it needs."""
    spark = vectors.sparkSession
    ids, matrix = query_rows(queries)
    names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    columns, probed = [F.col("vec_id").cast("long"), "embedding"], None
    if probe and ids:
        probed = probe(matrix)
        vectors, columns = vectors.where(F.col("cell").isin([int(c) for c in np.flatnonzero(probed.any(0))])), [*columns, "cell"]
    rows = vectors.select(*columns).where("embedding is not null") if ids else vectors.select(*columns).where("false")
    shared = spark.sparkContext.broadcast((matrix, probed))
    found = rows.mapInArrow(_searcher(shared, k, metric), "q int, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    score = F.col("score") if metric == "cosine" else -F.col("score")
    return ranked.join(F.broadcast(names), "q").select("query_id", "vec_id", score.alias("score"), "rank"), shared  # the ids of a block of queries


def aggregate_queries(hits: DataFrame, n_queries: int | Column, top_k: int | None, by: str = "vec_id", group: tuple[str, ...] = ()) -> DataFrame:
    """Hits of several queries as one ranking: mean and best score over the lists with the item, share of queries matched, 0.8 mean + 0.2 share.

    Means and shares count to eight digits and the sum to nine, so that sixth digits of scores are never halved."""
    a = hits.groupBy(*group, by).agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.countDistinct("query_id").alias("matched_queries"))
    a = a.withColumn("avg_score", F.round("avg_score", 8)).withColumn("coverage_score", F.round(F.col("matched_queries") / (n_queries if isinstance(n_queries, Column) else F.lit(max(1, n_queries))), 8))
    a = a.withColumn("alignment_score", F.round(0.8 * F.col("avg_score") + 0.2 * F.col("coverage_score"), 9))
    order = [F.desc("alignment_score"), by]
    if top_k is None:
        return a
    if group:
        return a.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top_k)
    return a.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def multi_query_search(vectors: DataFrame, queries: DataFrame, top_k: int, candidate_k: int) -> DataFrame:
    """One ranking of the queries' best vectors; queries with an ``event`` column have one for each event."""
    hits = nearest(vectors, queries, candidate_k)
    if "event" not in queries.columns:
        return aggregate_queries(hits, queries.count(), top_k)
    sizes = queries.groupBy("event").agg(F.count("*").alias("n_queries"))
    grouped = hits.join(queries.select("query_id", "event").join(sizes, "event"), "query_id")
    return aggregate_queries(grouped, F.col("n_queries"), top_k, group=("event", "n_queries")).drop("n_queries")


def legacy_rerank(hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """0.9 mean + 0.1 share of the queries that returned anything; rows with a null key are left out."""
    keys = [k for k in keys if k in hits.columns]
    whole = hits.agg(F.greatest(F.lit(1), F.countDistinct("sub_query_idx")).alias("n"))
    for k in keys:
        hits = hits.where(F.col(k).isNotNull())
    a = hits.groupBy(*keys).agg(F.round(F.avg("score"), 8).alias("avg_score"), F.max("score").alias("max_score"), F.countDistinct("sub_query_idx").alias("matched_queries"))
    a = a.join(F.broadcast(whole)).withColumn("coverage_score", F.round(F.col("matched_queries") / F.col("n"), 8)).drop("n")  # one row
    return a.withColumn("alignment_score", F.round(0.9 * F.col("avg_score") + 0.1 * F.col("coverage_score"), 9))


def train_centroids(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on at most `sample` vectors, those of the smallest hashes of vec_id."""
    rows = vectors.select("vec_id", "embedding").where("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    x = np.array([r[1] for r in rows], np.float64)
    centers = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        for c in range(len(centers)):
            if (near == c).any():
                m = x[near == c].mean(0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    return centers


def with_cell(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """Every vector with the number of its nearest centroid, the column to partition a table by."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            cell = (_matrix(batch.column(1)) @ shared.value.T).argmax(1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "cell"])

    return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "vec_id long, embedding array<float>, cell int")


def nearest_by_cells(indexed: DataFrame, centers: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """nearest() of each query over the vectors of its own nearest cells; of a table partitioned by cell, cells that no query probes aren't read."""

    def probe(matrix: np.ndarray) -> np.ndarray:
        near = np.argsort(-(matrix @ centers.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(matrix), len(centers)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    return _blocks(queries, lambda some: _nearest(indexed, some, k, "cosine", probe))


def hash_encode(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a text encoder: signed hashed word counts at unit length."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = once(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return l2_normalise(counts)


def encode_once(texts: DataFrame, text: str, encoder) -> DataFrame:
    """Every row with the vector of its text; texts that differ in case and spacing alone are encoded once."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    keyed = texts.withColumn("__key", key)
    vectors = keyed.select("__key").distinct().withColumn("vector", encoder(F.col("__key")))
    return keyed.join(vectors, "__key").drop("__key")
