"""Tables that an index consists of, and the contracts of sources and sinks."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from framewright.operators import fulltext, vector
from framewright.scratch import stored


class Indexer(Protocol):
    """A stored index: made anew, added to, counted, dropped."""

    def create(self, docs: DataFrame) -> None: ...
    def insert(self, docs: DataFrame) -> None: ...
    def count(self) -> int: ...
    def exists(self) -> bool: ...
    def delete(self) -> None: ...


class Retriever(Protocol):
    """Something that finds its best rows for a query."""

    def search(self, query: str | DataFrame, top_k: int) -> DataFrame: ...


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class _Stored:
    """An index below a folder: segments that are never changed, and one file that names those that count.

    A write makes a new segment and then puts a new manifest in the place of the
    old one, in one step; until then readers see what was there, and a write that
    dies leaves a segment that nobody reads.  Rows carry their segment's number;
    a removal is a segment of keys, which hides the rows of earlier segments.
    """

    #: Rows of a bucket's file, and keys of removals that are broadcast, at most.
    FILE_ROWS, MOST_BROADCAST = 2_000_000, 1_000_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        path, files = _file_system(self.spark, f"{self.path}/manifest")
        return files.exists(path)

    def delete(self) -> None:
        path, files = _file_system(self.spark, self.path)
        files.delete(path, True)

    def manifest(self) -> dict:
        """Its version and its segments: name, number, tables, and how many keys it removes."""
        if not self.exists():
            return {"version": 0, "segments": []}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest").collect()))

    def _commit(self, before: dict, segments: list[dict]) -> None:
        """Put a manifest of these segments in the place of `before`; an error if another writer came first."""
        if self.manifest()["version"] != before["version"]:
            raise RuntimeError("the index was changed by another writer")
        text = json.dumps({"version": before["version"] + 1, "segments": segments})
        made, files = _file_system(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}")
        out = files.create(made, True)
        out.write(text.encode())
        out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(made), files.makeQualified(target), options)

    def _segment(self, before: dict, tables: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], removes: int = 0) -> dict:
        """A new segment with these tables, split by bucket where they have one; rows get its number.  A function makes its table of the first one, as written."""
        number = 1 + max((s["number"] for s in before["segments"]), default=0)
        name, first = f"v{number:06d}-{uuid.uuid4().hex[:8]}", None
        for table, rows in tables.items():
            rows = (rows(first) if callable(rows) else rows).withColumn("segment", F.lit(number))
            writer = rows.write.partitionBy("bucket").option("maxRecordsPerFile", self.FILE_ROWS) if "bucket" in rows.columns else rows.write
            writer.parquet(f"{self.path}/{table}/version={name}")
            # a segment without rows has no file that tells its columns
            first = self.spark.read.schema(S.StructType(rows.schema.fields)).parquet(f"{self.path}/{table}/version={name}") if first is None else first
        return {"name": name, "number": number, "tables": sorted(tables), "removes": removes}

    def _read(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        base = f"{self.path}/{table}"
        paths = [f"{base}/version={s['name']}" for s in (manifest or self.manifest())["segments"] if table in s["tables"]]
        return self.spark.read.option("basePath", base).parquet(*paths).drop("version") if paths else None

    def _live(self, table: str, key: str) -> DataFrame:
        """The rows of a table whose key wasn't removed after they were written."""
        manifest = self.manifest()
        rows, removed = self._read(table, manifest), self._read("removed", manifest)
        if rows is None:
            raise ValueError(f"no index at {self.path}")
        if removed is not None:
            gone = removed.groupBy(key).agg(F.max("segment").alias("__gone")).withColumnRenamed(key, "__key")
            if sum(s["removes"] for s in manifest["segments"]) <= self.MOST_BROADCAST:
                gone = F.broadcast(gone)
            rows = rows.join(gone, (F.col(key) == F.col("__key")) & (F.col("__gone") > F.col("segment")), "left_anti")
        return rows

    def _files(self, rows: DataFrame, n: int, spread: str, *order: str) -> DataFrame:
        """rows dealt by bucket, and by a hash of a column where a bucket is more than a file."""
        parts = max(1, -(-n // (self.BUCKETS * self.FILE_ROWS)))
        dealt = rows.repartition("bucket") if parts == 1 else rows.repartition(self.BUCKETS * parts, "bucket", F.pmod(F.xxhash64(spread), F.lit(parts)))
        return dealt.sortWithinPartitions("bucket", *order) if order else dealt

    def vacuum(self) -> list[str]:
        """Delete the segments that the manifest doesn't name, of dead writes and from before a compaction; their names."""
        live, gone = {s["name"] for s in self.manifest()["segments"]}, set()
        path, files = _file_system(self.spark, self.path)
        for table in (f.getPath() for f in files.listStatus(path) if f.isDirectory()):
            for version in (f.getPath() for f in files.listStatus(table) if f.isDirectory()):
                name = version.getName().removeprefix("version=")
                if name not in live:
                    files.delete(version, True)
                    gone.add(name)
        return sorted(gone)


class FullTextIndex(_Stored):
    """Postings split by a hash of the term, terms with their document counts split by a hash of their first letters, documents with their lengths, and totals.

    A query reads the buckets of its terms and of their expansions alone.  Counts
    of a term, and totals, are added up when read; removals add negative ones.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, key: str, text: str):
        super().__init__(spark, path)
        self.key, self.text = key, text

    def _bucket(self, of):
        return F.pmod(F.xxhash64(of), F.lit(self.BUCKETS)).cast("int")

    def _buckets(self, values: list[str]) -> list[int]:
        """The buckets of some values; a few at a time, found where the tables' were."""
        rows = self.spark.createDataFrame([(v,) for v in values], "v string").select(self._bucket(F.col("v")).alias("b")).distinct().collect()
        return sorted(r["b"] for r in rows)

    def create(self, docs: DataFrame) -> None:
        """Write the index anew."""
        before = self.manifest()
        self._commit(before, [self._added(before, docs)])

    def insert(self, docs: DataFrame) -> None:
        """Add documents whose keys the index doesn't have."""
        before = self.manifest()
        self._commit(before, [*before["segments"], self._added(before, docs.join(self.documents().select(self.key), self.key, "left_anti"))])

    def remove(self, keys: DataFrame) -> int:
        """Remove the documents of these keys; how many there were."""
        before = self.manifest()
        segment = self._removed(before, keys)
        if segment:
            self._commit(before, [*before["segments"], segment])
        return segment["removes"] if segment else 0

    def bulk(self, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """Remove keys and write documents, which replace those of the same key, in one version."""
        before = self.manifest()
        gone = docs.select(self.key) if removed is None else docs.select(self.key).union(removed.select(self.key))
        segment = self._removed(before, gone)
        segments = [*before["segments"], *([segment] if segment else [])]
        self._commit(before, [*segments, self._added({**before, "segments": segments}, docs)])

    def compact(self) -> None:
        """The live documents in one segment, without what was removed."""
        before = self.manifest()
        rows = self.postings().select(self.key, "term", "tf", "positions", "dl")
        listed = self.documents().select(self.key, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions"), "dl")
        self._commit(before, [self._written(before, rows.union(listed))])

    def _added(self, before: dict, docs: DataFrame) -> dict:
        return self._written(before, fulltext.postings(docs, self.key, self.text, listed=True))

    def _written(self, before: dict, rows: DataFrame) -> dict:
        """A segment of postings, among them those of the empty term; they are made once, and counted as they were written."""
        dealt = rows.withColumn("bucket", self._bucket("term")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        listed = lambda made: made.where((F.col("bucket") == self._bucket(F.lit(""))) & (F.col("term") == "")).groupBy(self.key).agg(F.first("dl").alias("dl"))
        tables = {
            "postings": dealt, "terms": lambda made: self._counted(made.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))),
            "documents": listed, "totals": lambda made: self._totals(listed(made), 1),
        }
        return self._segment(before, tables)

    def _counted(self, terms: DataFrame) -> DataFrame:
        terms = stored(terms.withColumn("bucket", self._bucket(F.substring("term", 1, fulltext.PREFIX))), "terms")
        return self._files(terms, terms.count(), "term", "term")

    @staticmethod
    def _totals(docs: DataFrame, sign: int) -> DataFrame:
        return docs.agg((sign * F.count("*")).alias("n_docs"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("tokens"))

    def _removed(self, before: dict, keys: DataFrame) -> dict | None:
        """A segment that removes those keys that the index has; its terms count below nothing."""
        if not before["segments"]:
            return None
        gone = stored(self.documents().join(keys.select(self.key).distinct(), self.key, "left_semi").select(self.key, "dl"), "removed")
        n = gone.count()
        if not n:
            return None
        own = self.postings().select(self.key, "term").join(F.broadcast(gone.select(self.key)) if n <= self.MOST_BROADCAST else gone.select(self.key), self.key, "left_semi")
        tables = {"removed": gone.select(self.key), "terms": self._counted(own.groupBy("term").agg((-F.count("*")).alias("df"))), "totals": self._totals(gone, -1)}
        return self._segment(before, tables, n)

    def documents(self) -> DataFrame:
        """The keys and lengths of the documents with tokens."""
        return self._live("documents", self.key)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of some terms, of which only the buckets are read."""
        rows = self._live("postings", self.key)
        rows = rows.where("term <> ''") if terms is None else rows
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(self._buckets(terms)) & F.col("term").isin(terms)) if terms else rows.where("false")
        return rows.drop("bucket", "segment")

    def terms(self, starts: list[str]) -> DataFrame:
        """``(term, df)`` with the given first letters."""
        start = F.substring("term", 1, fulltext.PREFIX)
        rows = self._read("terms").where(F.col("bucket").isin(self._buckets(starts)) & start.isin(starts))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> fulltext.Index:
        totals = self._read("totals").agg(F.sum("n_docs").alias("n_docs"), F.try_divide(F.sum("tokens"), F.sum("n_docs")).alias("avgdl"))
        return fulltext.Index(self.key, self.postings, self.terms, totals)

    def count(self) -> int:
        return self._read("totals").agg(F.coalesce(F.sum("n_docs"), F.lit(0))).collect()[0][0]

    def search(self, query: str, top_k: int, weights: DataFrame | None = None) -> DataFrame:
        return fulltext.search(self.index(), self.key, query, top_k, weights)


class VectorIndex(_Stored):
    """Unit vectors split by their nearest centroid, and the centroids: an exact search reads all, a pruned one the cells that its queries probe.

    An index is opened again by its path.  Unless a number of cells is given, there
    are as many as the root of the number of vectors that the index is made of,
    from FEWEST to MOST, so that a cell grows as slowly as their number.
    """

    FEWEST, MOST = 16, 4_096

    def __init__(self, spark: SparkSession, path: str, cells: int | None = None):
        super().__init__(spark, path)
        self.cells = cells

    @property
    def BUCKETS(self) -> int:  # noqa: N802
        return self.cells or self.FEWEST

    def create(self, vectors: DataFrame) -> None:
        """Centroids of these vectors, and the vectors."""
        before, unit = self.manifest(), self._unit(vectors)
        cells = self.cells or min(self.MOST, max(self.FEWEST, math.isqrt(unit.count())))
        centers = vector.train_centroids(unit, cells, max(20_000, 16 * cells))
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
        made = self.spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1)
        self._commit(before, [self._segment(before, {"centers": made, "vectors": self._celled(unit, centers)})])

    def insert(self, vectors: DataFrame) -> None:
        """Add vectors whose ids the index doesn't have, to the cells that it has."""
        before = self.manifest()
        new = self._unit(vectors).join(self.table().select("vec_id"), "vec_id", "left_anti")
        self._commit(before, [*before["segments"], self._segment(before, {"vectors": self._celled(new, self.centers())})])

    def remove(self, ids: DataFrame) -> int:
        """Remove the vectors of these ``(vec_id)``; how many there were."""
        before = self.manifest()
        gone = stored(self.table().join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id"), "removed")
        n = gone.count()
        if n:
            self._commit(before, [*before["segments"], self._segment(before, {"removed": gone}, n)])
        return n

    def compact(self) -> None:
        """The live vectors and the centroids in one segment."""
        before = self.manifest()
        rows = stored(self.table().withColumnRenamed("cell", "bucket"), "vectors")
        centers = self._read("centers", before).select("cell", "center")
        self._commit(before, [self._segment(before, {"centers": centers.coalesce(1), "vectors": self._files(rows, rows.count(), "vec_id")})])

    @staticmethod
    def _unit(vectors: DataFrame) -> DataFrame:
        return vectors.select("vec_id", vector.l2_normalise(F.col("embedding")).cast("array<float>").alias("embedding"))

    def _celled(self, unit: DataFrame, centers) -> DataFrame:
        rows = stored(vector.with_cell(unit, centers).withColumnRenamed("cell", "bucket"), "vectors")
        return self._files(rows, rows.count(), "vec_id")

    def centers(self):
        return np.array([r["center"] for r in self._read("centers").orderBy("cell").collect()], np.float64)

    def table(self) -> DataFrame:
        return self._live("vectors", "vec_id").select("vec_id", "embedding", F.col("bucket").cast("int").alias("cell"))

    def count(self) -> int:
        return self.table().count()

    def search(self, query: DataFrame, top_k: int, probes: int | None = None) -> DataFrame:
        """The best of ``(query_id, vector)`` over all vectors, or over those of each query's nearest cells."""
        return vector.nearest(self.table(), query, top_k) if probes is None else vector.nearest_by_cells(self.table(), self.centers(), query, top_k, probes)


def cache_vectors(vectors: DataFrame, path: str, size: int, half: bool = False) -> None:
    """``(vec_id, embedding)`` as bytes of 32, or 16, bits a number; a vector of another size is an error."""
    kind = np.float16 if half else np.float32

    def packed(batches):
        for batch in batches:
            data = []
            for v in batch.column(1):
                x = np.asarray(v.values if v.is_valid else [], kind)
                if len(x) != size:
                    raise ValueError(f"a vector of {len(x)} numbers where {size} are expected")
                data.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([np.dtype(kind).name] * len(data), pa.string())], names=["vec_id", "data", "kind"])

    vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(packed, "vec_id long, data binary, kind string").write.mode("overwrite").parquet(path)


def cached_vectors(spark: SparkSession, path: str) -> DataFrame:
    """What cache_vectors() wrote, as ``(vec_id, embedding)``."""

    def unpacked(batches):
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), k).astype(np.float32) for x, k in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return spark.read.schema("vec_id long, data binary, kind string").parquet(path).mapInArrow(unpacked, "vec_id long, embedding array<float>")


def keyframe_map(frames: DataFrame, path: str) -> None:
    """Map files by video, with ids from 0 in order of frames."""
    number = (F.row_number().over(W.partitionBy("video_id").orderBy("frame_idx")) - 1).cast("int")
    rows = frames.select(F.col("video_id").alias("video"), number.alias("keyframe_id"), "video_id", "frame_idx", "timestamp_sec", "fps")
    rows.write.mode("overwrite").option("header", True).partitionBy("video").csv(path)


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    return rows if overwrite else rows.join(done.select(*keys).distinct(), keys, "left_anti")
