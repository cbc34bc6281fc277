"""Intermediate tables in the folder that the driver and all executors share, and the size of Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from framewright.scratch import clear, drop, new_path, shared_dir, stored, written

__all__ = ["clear", "drop", "new_path", "shared_dir", "small_batches", "stored", "written"]

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whole texts of an Arrow batch and their bytes at most (a longer text is a batch of its own): they are held by the JVM and by the Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES; smaller settings stay."""
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        digits, unit = re.fullmatch(r"(-?\d+)([a-z]?).*", spark.conf.get(key).lower()).groups()
        have = int(digits) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
        if have <= 0 or have > most:
            spark.conf.set(key, most)
