"""Places and running sums over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from framewright.llm.store import stored


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df with ``before_v`` for each v of values, the sum of v over the rows of its group that come first in order, and ``place`` (0..).

    Rows are dealt by ranges of (group, order), so that a group of any size is
    spread over tasks; what lies before a range is a sum over earlier ranges, of
    which there are as many as shuffle partitions.  No group is one group of all
    rows.  Order is ascending, nulls first; equal rows stand in either order.
    """
    dealt = stored(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    names = {v: f"before_{v}" for v in values}
    sums = dealt.groupBy("__range", *group).agg(F.count("*").alias("__before"), *[F.sum(v).alias(n) for v, n in names.items()])
    ahead = Win.partitionBy(*group).orderBy("__range").rowsBetween(Win.unboundedPreceding, -1)
    earlier = sums.select("__range", *group, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("__before", *names.values())])
    own = Win.partitionBy("__range", *group).orderBy(*order)
    inner = own.rowsBetween(Win.unboundedPreceding, -1)
    inside = {n: F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(n) for v, n in names.items()}
    rows = dealt.select("*", *inside.values(), (F.row_number().over(own) - 1).alias("__in_range"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ["__range", *group]]
    joined = rows.alias("r").join(earlier.alias("e"), same)
    sums = [(F.col(f"r.{n}") + F.col(f"e.{n}")).alias(n) for n in names.values()]
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *sums, (F.col("r.__in_range") + F.col("e.__before")).alias("place"))
