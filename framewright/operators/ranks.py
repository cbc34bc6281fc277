"""Ranks and running values over whole results or groups of any size, without a window over all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.scratch import stored


def _ordered(order: list[str]) -> list[Column]:
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


def by_ranges(rows: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """rows, stored, with ``__range``: rows of a group that come first in order have no larger one.  Only equal rows can't be parted."""
    by = [*map(F.asc_nulls_last, group or []), *_ordered(order)]
    return stored(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], name: str = "rank", group: list[str] | None = None) -> DataFrame:
    """rows with their number (1..) in order of columns, of all or within their group, "-column" from the largest down; nulls of a column stand last.

    Rows are dealt by ranges, counted by range, and numbered within their range;
    equal rows stand in either order.  For results that a limit has bounded, a
    window is enough.
    """
    group = group or []
    dealt = by_ranges(rows, order, group)
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("__range", *group).agg(F.count("*").alias("__n")).select("__range", *group, before.alias("__before"))  # a row per range and group
    own = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__range", *group).orderBy(*_ordered(order))))
    if not group:
        placed = own.join(F.broadcast(ranges), "__range")
        return placed.select(*rows.columns, (F.col("__before") + F.col("__k")).alias(name))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["__range", *group]]
    placed = own.alias("o").join(ranges.alias("r"), same)
    return placed.select(*[F.col(f"o.{c}") for c in rows.columns], (F.col("r.__before") + F.col("o.__k")).alias(name))


def as_of(rows: DataFrame, asked: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``(group, at)`` of asked, each once, with ``before`` and ``after``: structs (at, value) of the last row of its group at or before it, and the first at or after.

    Of rows ``(group, at, value)`` at one place the smallest value counts; rows and
    questions without a group or a place are left out.  Rows and questions are put
    in one order and dealt by ranges, so that a group of any size is spread over
    tasks; what lies beyond a range are the ends of other ranges, a row for each
    range and group.
    """
    have = rows.where(F.col(group).isNotNull() & F.col(at).isNotNull()).groupBy(group, at).agg(F.min(value).alias(value))
    ask = asked.where(F.col(group).isNotNull() & F.col(at).isNotNull()).select(group, at).distinct()
    both = have.withColumn("__asks", F.lit(False)).unionByName(ask.withColumn("__asks", F.lit(True)), allowMissingColumns=True)
    dealt = by_ranges(both, [at, "__asks"], [group]).withColumn("__row", F.when(~F.col("__asks"), F.struct(at, value)))
    ends = dealt.groupBy("__range", group).agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    ranges = W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(group).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    beyond = ends.select(F.col("__range").alias("__r"), F.col(group).alias("__g"), F.max("__last").over(ranges).alias("__earlier"), F.min("__first").over(later).alias("__later"))
    # rows stand before questions of the same place in both directions
    own = W.partitionBy("__range", group)
    ahead = own.orderBy(at, "__asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    back = own.orderBy(F.desc(at), "__asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = dealt.withColumns({"before": F.max("__row").over(ahead), "after": F.min("__row").over(back)}).where("__asks")
    found = found.join(beyond, (F.col("__range") == F.col("__r")) & (F.col(group) == F.col("__g")))
    return found.select(group, at, F.coalesce("before", "__earlier").alias("before"), F.coalesce("after", "__later").alias("after"))
