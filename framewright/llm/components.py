"""Connected components of an edge table, by contraction; no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` undirected edges -> ``(v long, label long)`` for each vertex of an edge.

    Each round maps a vertex to the smallest label two steps away and contracts
    the edges by that map; vertex ids must be hashes, so that a round removes a
    fixed share of the labels whatever the shape.  A vertex with many edges is
    summed before it is shuffled (``min``).  Self loops and repeated edges are
    ignored; no edges give no rows; equal inputs give equal labels.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(edges.select("a", "b").where("a <> b"), "edges")
    labels = None
    while not left.isEmpty():
        near = both(left).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        near = stored(near, "near")
        step = near.alias("x").join(near.alias("y"), F.col("x.m") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.m").alias("label"))
        step = stored(step, "step")
        if labels is None:
            labels = step
        else:
            later = step.select(F.col("v").alias("old"), F.col("label").alias("new"))
            labels = labels.join(later, labels["label"] == later["old"], "left").select("v", F.coalesce("new", "label").alias("label"))
        labels = stored(labels, "labels")
        of = lambda c: step.select(F.col("v").alias(c), F.col("label").alias("to_" + c))  # noqa: E731, B023
        left = left.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct()
        left = stored(left, "edges")
    return labels if labels is not None else left.select(F.col("a").alias("v"), F.col("b").alias("label"))
