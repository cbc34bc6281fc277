"""Shaping of results: grouping, pages, flattening, safe values, paths, summaries and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.operators.ranks import numbered


def by_video(results: DataFrame, score: str = "score", time: str = "ts") -> DataFrame:
    """Results in groups of their video: groups by best score, rows in a group by score, then time."""
    groups = numbered(results.groupBy("video_id").agg(F.max(score).alias("group_score")), ["-group_score", "video_id"], "group_rank")
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc(score), time))
    return results.withColumn("place_in_group", place).join(groups, "video_id").select(*results.columns, "group_score", "place_in_group", "group_rank")


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """A page of rows by rank; numbers beyond either end give the first or last page."""
    last = ranked.agg(F.greatest(F.lit(1), F.ceil(F.max("rank") / size)).alias("__last"))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), F.coalesce("__last", F.lit(1)))
    held = ranked.join(F.broadcast(last))  # one row
    return held.where((F.col("rank") > (at - 1) * size) & (F.col("rank") <= at * size)).drop("__last")


def flattened(results: DataFrame, sequence: str = "matched_sequence") -> DataFrame:
    """A row per frame of each result's sequence, with the frame's fields over the result's; results without one stay; ranks follow."""
    fields = results.schema[sequence].dataType.elementType.fieldNames()
    rows = results.select(*[c for c in results.columns if c != sequence], F.posexplode_outer(sequence).alias("__pos", "__frame"))
    cols = [F.coalesce(F.col(f"__frame.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in results.columns if c not in (sequence, "rank")]
    extra = [F.col(f"__frame.{c}").alias(c) for c in fields if c not in results.columns]
    return numbered(rows.select(*cols, *extra, F.col("rank").alias("__rank"), "__pos"), ["__rank", "__pos"]).drop("__rank", "__pos")


def display(results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return results.select(*[c for c in columns if c in results.columns])


def safe_double(c: Column, otherwise: float | None = None) -> Column:
    """A number that is one; text that isn't, NaN and infinities give `otherwise`."""
    n = c.cast("string").try_cast("double")
    finite = F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n)
    return finite if otherwise is None else F.coalesce(finite, F.lit(otherwise))


def safe_int(c: Column, otherwise: int | None = None) -> Column:
    n = safe_double(c).cast("bigint")
    return n if otherwise is None else F.coalesce(n, F.lit(otherwise).cast("bigint"))


def serialised(results: DataFrame) -> Column:
    """JSON of a result; its score is the first of retrieval, alignment, average and plain score that is there."""
    chain = [safe_double(F.col(c)) for c in ("retrieval_score", "alignment_score", "avg_score", "score") if c in results.columns]
    doubles = [safe_double(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes if c != "score"]
    return F.to_json(F.struct(*doubles, F.coalesce(*chain, F.lit(0.0)).alias("score")))


def frame_path(dataset: Column, video: Column, frame: Column, suffix: str = ".jpg") -> Column:
    return F.concat_ws("/", dataset, video, F.concat(T.padded(frame), F.lit(suffix)))


def video_link(base: Column, seconds: Column) -> Column:
    return F.concat(base, F.when(seconds.isNotNull(), F.concat(F.lit("#t="), F.format_string("%.2f", seconds))).otherwise(""))


def clamped_box(box: Column, width: int, height: int) -> Column:
    """x1, y1, x2, y2 within the picture; null where nothing is left."""
    side = lambda i, most: F.least(F.greatest(F.get(box, F.lit(i)), F.lit(0.0)), F.lit(float(most)))
    x1, y1, x2, y2 = side(0, width), side(1, height), side(2, width), side(3, height)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def verdict(status: Column, body: Column) -> Column:
    """struct(status, message) of an answer to a submission, from its HTTP status and JSON body."""
    said = F.upper(F.coalesce(F.get_json_object(body, "$.submission"), F.lit("")))
    as_ = lambda name, message: F.struct(F.lit(name).alias("status"), message.alias("message") if isinstance(message, Column) else F.lit(message).alias("message"))
    failed = F.coalesce(F.get_json_object(body, "$.description"), F.concat(F.lit("HTTP Error "), status.cast("string")))
    return (
        F.when(status == 412, as_("wrong", "Wrong Answer")).when(status >= 400, as_("error", failed)).when(status == 202, as_("pending", "Submitted, waiting for verdict"))
        .when(F.contains(said, F.lit("CORRECT")), as_("correct", "Correct!")).when(F.contains(said, F.lit("WRONG")), as_("wrong", "Wrong Answer")).otherwise(as_("pending", "Submitted"))
    )


def latency_summary(runs: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.avg(seconds), 6).alias("mean_s"), F.round(F.min(seconds), 6).alias("min_s"), F.round(F.max(seconds), 6).alias("max_s"))


def _grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    w = df.select(key, T.words(F.lower(text)).alias("w")).where(f"size(w) >= {n}")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.concat_ws(" ", *[F.element_at("w", i + k) for k in range(n)]))
    return w.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count("*").alias("c"))


def bleu(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """One row: corpus BLEU of 1- to 4-grams, with one added to matches and totals, and the brevity penalty, times 100."""
    parts = []
    for n in range(1, 5):
        r, h = _grams(pairs, key, reference, n), _grams(pairs, key, output, n)
        match = h.join(r.withColumnRenamed("c", "r"), [key, "g"], "left").agg(F.sum(F.least("c", F.coalesce("r", F.lit(0)))).alias("m"), F.sum("c").alias("t"))
        parts.append(match.select(F.log((F.coalesce("m", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + 1)).alias("p")))
    logs = reduce(lambda a, b: a.unionAll(b), parts).agg(F.avg("p").alias("p"))
    sizes = pairs.agg(*[F.sum(F.size(T.words(F.lower(c)))).alias(a) for c, a in ((reference, "r"), (output, "h"))])
    penalty = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest("h", F.lit(1))))
    return logs.join(F.broadcast(sizes)).select(F.round(100 * penalty * F.exp("p"), 6).alias("bleu"))  # one row each


def char_f(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """One row: mean over pairs of the F score of their characters, blanks left out, times 100."""
    chars = lambda c, n: pairs.select(key, F.explode(F.split(F.replace(F.lower(c), F.lit(" "), F.lit("")), "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias(n))
    both = chars(reference, "r").join(chars(output, "h"), [key, "ch"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("r", F.lit(0)), F.coalesce("h", F.lit(0)))).alias("o"), F.sum("r").alias("r"), F.sum("h").alias("h"))
    p, q = F.col("o") / F.greatest(F.coalesce("h", F.lit(0)), F.lit(1)), F.col("o") / F.greatest(F.coalesce("r", F.lit(0)), F.lit(1))
    scored = pairs.select(key).join(both.select(key, (2 * p * q / F.greatest(p + q, F.lit(1e-12))).alias("f")), key, "left")
    return scored.agg(F.round(100 * F.avg(F.coalesce("f", F.lit(0.0))), 6).alias("char_f"))


def substring_score(text: Column, terms: list[str]) -> Column:
    """How often the terms occur in a text, case aside."""
    low = F.lower(text)
    return reduce(lambda s, t: s + (F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t), terms, F.lit(0.0))


def token_score(text: Column, query: str, digits: int = 4) -> Column:
    """0.75 of the share of query words that occur, and 0.25 of the share of words that are query words, to so many digits."""
    asked = list(dict.fromkeys(query.lower().split()))
    own = F.array_distinct(T.words(F.lower(text)))
    common = F.size(F.array_intersect(own, F.lit(asked)))
    return F.round(0.75 * common / max(1, len(asked)) + 0.25 * common / F.greatest(F.size(own), F.lit(1)), digits)
