"""Vector code compression: four codebooks of 256 entries learnt in rounds of nearest-entry assignment, by VA-file filtering.

Every codebook entry is held as an approximation: each coordinate is the number
of a cell, of which a position has 16.  A part of a vector takes two small
tables, the least and the largest squared distance that any coordinate in a cell
can have from its own coordinate.  Sums over an entry's cells bound its distance
from below and above; only entries whose lower bound doesn't exceed the smallest
upper bound are compared in whole numbers.  Rows never meet: a round is one pass
over the vectors and sums of 4 x 256 entries.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import stored

#: Parts of a vector, entries of a part's codebook, rounds of learning, bits of a cell's number, factor of the whole numbers.
PARTS, ENTRIES, ROUNDS, CELL_BITS, SCALE = 4, 256, 4, 4, 1024
#: Components of this size or more are no vectors' components: squares of their whole numbers don't fit 64 bits.
LIMIT = 65_536.0
#: Rows bounded at once; labels that are broadcast at most.
SLICE, MOST_BROADCAST = 1_024, 100_000


def usable(embedding: Column) -> Column:
    """Whether a vector is given and all its components are finite and below LIMIT."""
    good = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LIMIT), F.lit(False)))
    return F.coalesce(good & (F.size(embedding) > 0) & (F.size(embedding) % PARTS == 0), F.lit(False))


class Cells:
    """One part's codebook (entries x positions, whole numbers) with the cells of its coordinates."""

    def __init__(self, book: np.ndarray):
        self.book, (n, width) = book, book.shape
        cells = 1 << CELL_BITS
        # cells of equal numbers of entries: a coordinate's cell follows from its rank
        rank = np.argsort(np.argsort(book, axis=0, kind="stable"), axis=0, kind="stable")
        cell = rank * cells // max(n, cells)
        self.low, self.high = np.full((width, cells), np.inf), np.full((width, cells), -np.inf)
        at = (np.broadcast_to(np.arange(width), book.shape), cell)
        np.minimum.at(self.low, at, book)
        np.maximum.at(self.high, at, book)
        self.low, self.high = (np.where(np.isfinite(x), x, 0.0) for x in (self.low, self.high))  # cells without entries
        member = np.zeros((width, cells, n))
        member[at[0], cell, np.broadcast_to(np.arange(n)[:, None], book.shape)] = 1.0
        self.member = member.reshape(width * cells, n)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of each part from each entry, by its cells alone."""
        x = parts[:, :, None].astype(np.float64)
        below, above = self.low - x, x - self.high
        least = np.maximum(np.maximum(below, above), 0.0)
        most = np.maximum(np.abs(below), np.abs(above))
        flat = (len(parts), self.member.shape[0])
        return (least * least).reshape(flat) @ self.member, (most * most).reshape(flat) @ self.member

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower index, and the squared distance, in whole numbers."""
        least, most = self.bounds(parts)
        # a millionth more than float sums of squares can be off
        row, entry = np.nonzero(least <= most.min(axis=1, keepdims=True) * (1 + 1e-6) + 1)
        d = parts[row] - self.book[entry]
        d = np.einsum("ij,ij->i", d, d)
        first = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]], best


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """The rows' components as whole numbers, floors of SCALE times their values."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * float(SCALE)).astype(np.int64).reshape(-1, size)


def _assigned(x: np.ndarray, books: list[Cells]):
    """For slices of rows: where they begin, their parts, and each part's entries and distances."""
    width = x.shape[1] // PARTS
    for a in range(0, len(x), SLICE):
        rows = x[a : a + SLICE].reshape(-1, PARTS, width)
        yield a, rows, [books[p].nearest(rows[:, p]) for p in range(PARTS)]


def _sums(shared, size: int):
    """One task's share of a round: for each part and entry the sum and the count of its vectors' parts."""

    def run(batches):
        books = [Cells(b) for b in shared.value]
        shape = (PARTS, len(books[0].book))
        total, count = np.zeros((*shape, size // PARTS), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            for _, rows, found in _assigned(_whole(batch.column("x"), size), books):
                for p, (entry, _) in enumerate(found):
                    np.add.at(total[p], entry, rows[:, p])
                    count[p] += np.bincount(entry, minlength=shape[1])
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        offsets = np.arange(len(part) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _codes(shared, size: int):
    def run(batches):
        books = [Cells(b) for b in shared.value]
        for batch in batches:
            x = _whole(batch.column("x"), size)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for a, rows, found in _assigned(x, books):
                for p, (entry, distance) in enumerate(found):
                    code[a : a + len(rows), p] = entry
                    error[a : a + len(rows)] += distance
            texts = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), texts, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, label, x)`` of the usable vectors, and their length: that of the usable vector of the smallest id."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(usable(F.col("x")))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).select(F.size("x")).collect()
    size = first[0][0] if first else PARTS
    return rows.where(F.size("x") == size), size


def train(rows: DataFrame, size: int) -> np.ndarray:
    """The codebooks, parts x entries x positions, after ROUNDS rounds over all rows."""
    spark = rows.sparkSession
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    books = np.floor(np.array([r.x for r in first]).reshape(-1, PARTS, size // PARTS) * float(SCALE)).astype(np.int64).transpose(1, 0, 2)
    for _ in range(ROUNDS if len(first) else 0):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(books))
        parts = rows.select("x").mapInArrow(W.released(_sums(shared, size)), "part int, entry int, n long, sums array<long>")
        each = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size // PARTS)])
        books = books.copy()
        for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), each.alias("sums")).collect():  # PARTS x ENTRIES rows at most
            books[r.part, r.entry] = [s // r.n for s in r.sums]
        shared.destroy()
    return books


def encode(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding, label)`` -> vec_id, code, error, label_error, codebooks_sha256, a row per usable vector.

    A null vector, one with a null, NaN, infinite or huge (LIMIT) component, an
    empty one or one that four parts don't divide has no row, nor has one of
    another length than the usable vector of the smallest vec_id.  Null ids come
    last in order, equal ids by their vectors, equal rows each count and each have
    a row.  With fewer than 256 vectors the codebooks have so many entries; an
    empty table gives no rows.  Null labels are one label.  Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows, size = prepared(vectors)
    books = train(rows, size)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(books))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(W.released(_codes(shared, size)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = stored(coded, "codes")
    shared.destroy()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    if sums.count() <= MOST_BROADCAST:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
