"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights and source sizes; blocks of equal numbers of words are
apportioned to sources by highest quotients (target / 1, / 3, / 5, ...), then
each source's blocks to its shards the same way.  In a shard, documents lie end
to end in a seeded order and are cut into blocks; each block is taken so many
times, and a seeded selection of blocks once more, until the quota is met.
Which blocks those are is a formula, so no table of blocks is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from framewright.llm.ranges import prefix_sums
from framewright.llm.store import stored

#: Weights of the sources, repeating; most times that a source's words are taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Words of a block at most; blocks of the whole, and of the smallest source, at least.
BLOCK_WORDS, BLOCKS, SOURCE_BLOCKS = 4096, 100_000, 100
#: Words and documents of a shard, and shards of a source at most.
SHARD_WORDS, MOST_SHARDS = 500_000, 100_000
#: Sources that are sent to all executors at most (about 100 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 10_000

#: Primes above the number of blocks of any shard.
_PRIMES = (2147483647, 1999999973, 1767263189, 1500450271, 1299709999)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """``(source, source_size)`` -> also sid (1.. by code point, null last), weight and target.

    Targets share the sum of all sizes by weight; one that is above `most` times
    its source's size stops there, and the rest is shared again by weight.  With
    sources in order of size over weight, those that stop are the first ones.
    """
    placed = prefix_sums(sources.withColumn("__none", F.col("source").isNull()), [], ["__none", "source"], [])
    ranked = placed.withColumn("sid", F.col("place") + 1).withColumn("weight", F.get(F.lit(list(weights)), (F.col("place") % len(weights)).cast("int"))).drop("place", "__none")
    ranked = ranked.withColumn("__cap", F.col("source_size") * most).withColumn("__full", F.col("source_size") / F.col("weight"))
    filled = stored(prefix_sums(ranked, [], ["__full", "sid"], ["__cap", "weight"]), "filled")
    sums = filled.agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__weights"))
    level = (F.col("__all") - F.col("before___cap")) / (F.col("__weights") - F.col("before_weight"))
    levelled = filled.join(F.broadcast(sums)).withColumn("__level", level).withColumn("__stops", F.col("__cap") <= F.col("__level") * F.col("weight"))  # one row
    last = levelled.agg(F.max(F.when(~F.col("__stops"), F.col("__level"))).alias("__last"))
    target = F.when(F.col("__stops"), F.col("__cap").cast("double")).otherwise(F.col("__last") * F.col("weight"))
    return levelled.join(F.broadcast(last)).select(*sources.columns, "sid", "weight", target.alias("target"))  # one row


def apportion(cells: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """Cells with ``quota``: each group's seats, apportioned to its keys by highest quotients weight / (2k + 1), ties by key.

    Seats that the largest possible divisor gives anyway are counted without
    making their quotients; about six quotients a cell are compared.
    """
    sums = cells.groupBy(group).agg(F.sum(weight).alias("__all"), F.count("*").alias("__cells"))
    share = F.col(seats) * F.col(weight) / F.col("__all")
    slack = F.col("__cells") / F.greatest(F.col(seats), F.lit(1))
    x = cells.join(sums, group).where((F.col("__all") > 0) & (F.col(weight) > 0) & (F.col(seats) > 0))
    x = stored(x.withColumn("__base", F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 2).cast("long")).withColumn("__top", (F.ceil(share * (1 + slack)) + 2).cast("long")), "cells")
    left = x.groupBy(group).agg((F.first(seats) - F.sum("__base")).alias("__rest"))
    quotients = x.select(group, key, F.explode(F.sequence("__base", "__top")).alias("__k"), F.col(weight).alias("__w")).withColumn("__minus", -F.col("__w") / (2 * F.col("__k") + 1))
    best = prefix_sums(quotients, [group], ["__minus", key, "__k"], []).join(left, group)
    won = best.where(F.col("place") < F.col("__rest")).groupBy(group, key).agg(F.count("*").alias("__won"))
    counted = x.select(group, key, "__base").join(won, [group, key], "left").select(group, key, (F.col("__base") + F.coalesce("__won", F.lit(0))).alias("quota"))
    return cells.join(counted, [group, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = 11) -> DataFrame:
    """``(doc_id, text, source)`` -> a row per document: doc_id, source, size, source_size, target, taken.

    taken counts the words that the mix takes of the document, repeats included,
    at most `most` times its size.  Null, empty and blank texts have size 0 and
    give nothing; texts of any length are counted whole; the null source is a
    source.  Order depends on doc_id, text and the seed alone, so that reruns
    agree; repeated rows are documents of their own, next to each other.  Other
    columns are ignored; no rows give no rows.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stored(docs.select("doc_id", "source", words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash")), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    sources = stored(sources, "targets")
    whole = sources.agg(F.sum("source_size").alias("__total"), F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).alias("__smallest"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.col("__total") / BLOCKS, F.col("__smallest") / SOURCE_BLOCKS)).cast("long")
    sources = sources.join(F.broadcast(whole)).withColumn("block", F.coalesce(block, F.lit(1).cast("long")))  # one row
    sources = sources.withColumn("blocks", F.ceil(F.col("__total") / F.col("block"))).withColumn("one", F.lit(1)).drop("__total", "__smallest")
    shard_words = F.greatest(F.lit(SHARD_WORDS), F.ceil((F.col("source_size") + F.col("n_docs")) / MOST_SHARDS))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("n_docs")) / shard_words)).cast("long"))
    sources = stored(apportion(sources, "one", "sid", "target", "blocks").withColumnRenamed("quota", "source_quota"), "sources")

    of = _small(sources.select(F.col("source").alias("s"), "sid", "shards"))
    placed = sized.join(of, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "sid", "hash", F.pmod("hash", "shards").alias("shard"))
    cells = placed.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"))
    facts = sources.select("sid", "source", "source_size", "target", "block", "source_quota")
    cells = apportion(stored(cells.join(_small(facts), "sid"), "shards"), "sid", "shard", "shard_size", "source_quota")
    there = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")
    quota = F.least(F.col("quota"), most * F.col("there"))
    cells = cells.withColumn("there", there).withColumn("times", F.floor(quota / F.col("there"))).withColumn("more", quota % F.col("there"))

    line = Win.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "hash"), "hash", "doc_id", "size").rowsBetween(Win.unboundedPreceding, 0)
    lined = placed.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    rows = lined.join(cells.select("sid", "shard", "source", "source_size", "target", "block", "there", "times", "more"), ["sid", "shard"])
    prime = F.get(F.lit(list(_PRIMES)), F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.lit(len(_PRIMES))).cast("int"))
    shift = F.pmod(F.xxhash64(F.lit(seed + 3), "sid", "shard"), "there")

    def overlap(j: Column) -> Column:
        inside = F.least(F.col("end"), (j + 1) * F.col("block")) - F.greatest(F.col("start"), j * F.col("block"))
        return F.when(F.pmod(j * prime + shift, "there") < F.col("more"), inside).otherwise(F.lit(0).cast("long"))

    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))
    once_more = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda n, j: n + overlap(j))
    taken = F.when(F.col("size") > 0, F.col("times") * F.col("size") + once_more).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
