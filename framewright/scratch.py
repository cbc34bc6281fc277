"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs no recomputation of earlier passes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(clear, spark)
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are so far, to give to drop()."""
    return len(_written)


def drop(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables written since then, but for the last few; results that still read them become invalid."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """drop() of all tables, as far as it goes: at the end of the interpreter the session may have ended, and its folder goes with it."""
    try:
        drop(spark, 0)
    except Exception:
        return
