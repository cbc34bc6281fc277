"""Vectors, aggregation, fusion, enrichment and temporal alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright import catalog
from framewright.operators import enrich, fusion, temporal, vector
from framewright.operators.ranks import numbered

#: Stored vectors that stand for the sub-queries of two query events.
EVENTS = ((3, 17), (42, 99, 123))
SUBS = tuple(v for e in EVENTS for v in e)
KINDS = ("view", "click", "purchase")
#: Of 16 cells: enough for a recall of 0.9 of each table's stated queries (see the tests).
PROBES = 12


def asked(spark, d):
    """The stated queries: every vector whose id is divisible by 20."""
    return catalog.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_vectors(spark, d, ids=SUBS):
    e = catalog.table(spark, d, "embeddings")
    return e.where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vectors(spark, d):
    return catalog.table(spark, d, "embeddings").select("vec_id", "embedding")


def hits(spark, d, ids=SUBS, k=30):
    return vector.nearest(vectors(spark, d), query_vectors(spark, d, ids), k)


def v1(spark, d):
    e = catalog.table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda x: x.cast("double") * F.col("vec_id")))
    return e.select("vec_id", F.round(F.get(vector.l2_normalise(F.col("x")), F.lit(0)), 6).alias("first"), F.round(vector.norm(vector.unit_or_same(F.col("x"))), 6).alias("length"))


def v2(spark, d):
    q = F.broadcast(query_vectors(spark, d, EVENTS[0]))  # two rows
    return vectors(spark, d).join(q).select("query_id", "vec_id", F.round(vector.dot(F.col("vector"), F.col("embedding")), 6).alias("score"))


def v3(spark, d):
    return vector.nearest(vectors(spark, d), asked(spark, d), 10, "l2").select("query_id", "vec_id", "rank", F.round("score", 5).alias("distance"))


def v4(spark, d):
    v = vectors(spark, d)
    centers = vector.train_centroids(v, 16)
    return vector.nearest_by_cells(vector.with_cell(v, centers), centers, asked(spark, d), 10, PROBES)


def v4_all(spark, d):
    """The same, with all cells probed."""
    v = vectors(spark, d)
    centers = vector.train_centroids(v, 16)
    return vector.nearest_by_cells(vector.with_cell(v, centers), centers, asked(spark, d), 10, 16)


def v5(spark, d):
    """Events of five sub-queries each: the stated queries in order."""
    return vector.multi_query_search(vectors(spark, d), asked(spark, d).withColumn("event", F.floor(F.col("query_id") / 100)), 10, 30)


def v6(spark, d):
    return vector.nearest(vectors(spark, d), asked(spark, d), 20)


def v7(spark, d):
    texts = catalog.table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(catalog.table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.upper("text").alias("text")))
    encoded = vector.encode_once(texts, "text", vector.hash_encode)
    return encoded.select("conv_id", "turn", F.round(vector.norm(F.col("vector")), 6).alias("length"))


def j1(spark, d):
    return vector.nearest(vectors(spark, d), asked(spark, d), 30)


def a1(spark, d):
    return vector.aggregate_queries(hits(spark, d), len(SUBS), None)


def a2(spark, d):
    sub = F.create_map(*[x for i, q in enumerate(SUBS) for x in (F.lit(q), F.lit(i))])
    h = hits(spark, d).withColumn("sub_query_idx", sub[F.col("query_id")]).withColumn("keyframe_id", F.when(F.col("vec_id") % 11 != 0, F.col("vec_id")))
    return vector.legacy_rerank(h, ("dataset", "keyframe_id"))


def _lists(spark, d):
    of = lambda ids: vector.multi_query_search(vectors(spark, d), query_vectors(spark, d, ids), 40, 60).select(F.format_string("%06d", "vec_id").alias("keyframe_id"), "alignment_score", "rank")
    return of(EVENTS[0]), of(EVENTS[1]).withColumn("keyframe_id", F.col("keyframe_id").cast("int").cast("string"))


def a3(spark, d):
    a, b = _lists(spark, d)
    return fusion.fuse([(a, "one", 1.0), (b, "two", 0.5)], top_k=50).select(F.col("keyframe_id").cast("long").alias("keyframe_id"), "rrf_score", "matched_sources", F.array_join("source_models", ",").alias("sources"), "rank")


def j11(spark, d):
    a, b = _lists(spark, d)
    return fusion.collisions([(a, "one"), (b, "two")]).select("frame", F.array_join("labels", ",").alias("labels"))


def _candidates(spark, d):
    """Per model and event: the best 40 of its sub-queries; the second model sees the first half of the vectors twice."""
    e = vectors(spark, d)
    parts = []
    for model, change in (("plain", F.col), ("doubled", lambda c: F.concat(F.slice(c, 1, 32), F.slice(c, 1, 32)))):
        for i, ids in enumerate(EVENTS):
            found = vector.multi_query_search(e.select("vec_id", change("embedding").alias("embedding")), query_vectors(spark, d, ids).select("query_id", change("vector").alias("vector")), 40, 60)
            parts.append(found.select(F.lit(model).alias("model_key"), F.lit(i).alias("event_idx"), F.col("vec_id").alias("keyframe_id"), F.col("alignment_score").alias("candidate_score"), F.col("rank").alias("candidate_rank")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.join(catalog.frames(spark, d).select("vec_id", "video_id", F.col("timestamp_sec").alias("ts")), F.col("keyframe_id") == F.col("vec_id")).drop("vec_id")


def a4(spark, d):
    return fusion.fuse_candidates(_candidates(spark, d).where("model_key = 'plain'")).select("video_id", "keyframe_id", "event_idx", "rrf_score", "candidate_score")


def m9(spark, d):
    c = _candidates(spark, d)
    fused = fusion.fuse_candidates(c).join(c.select("keyframe_id", "ts").distinct(), "keyframe_id")
    return temporal.sequences(temporal.score_matrix(fused, 2, "rrf_score"), 2, None, top_k=10).select("video_id", "score", "avg_score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "start", "end", "duration", "middle", "rank")


def a5(spark, d):
    e = catalog.table(spark, d, "events")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    c = e.select(F.col("user_id").alias("video_id"), F.date_trunc("day", F.col("ts")).alias("keyframe_id"), F.unix_date(F.to_date("ts")).cast("double").alias("ts"), kind.alias("event_idx"), F.col("value").alias("score"))
    return temporal.score_matrix(c, 3).select("video_id", "pos", "ts", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(3)])


def m1(spark, d):
    best = temporal.best_alignment(catalog.scored_events(spark, d, KINDS), 3)
    return best.select("video_id", F.round("score", 6).alias("score"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def _packed(df):
    return df.select("video_id", "score", "avg_score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("duration", 3).alias("duration"), "middle", "rank")


def m2(spark, d):
    return _packed(temporal.sequences(catalog.scored_events(spark, d, KINDS), 3))


def m3(spark, d):
    return _packed(temporal.sequences(catalog.scored_events(spark, d, KINDS), 3, duration=864000.0, top_k=50))


def m6(spark, d):
    """Candidates of both events, each scored against the first sub-query of every event, aligned per video."""
    c = _candidates(spark, d).where("model_key = 'plain'").select("keyframe_id").distinct()
    f = catalog.frames(spark, d).join(c, "keyframe_id")
    firsts = [e[0] for e in EVENTS]
    q = query_vectors(spark, d, firsts).groupBy().agg(*[F.max(F.when(F.col("query_id") == v, F.col("vector"))).alias(f"q{i}") for i, v in enumerate(firsts)])
    s = f.join(F.broadcast(q)).select("video_id", "pos", F.col("timestamp_sec").alias("ts"), *[F.round(vector.dot(F.col(f"q{i}"), F.col("embedding")), 6).alias(f"s{i}") for i in range(2)])  # one row
    best = temporal.best_alignment(s, 2)
    return best.select("video_id", F.round("score", 6).alias("score"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def m11(spark, d):
    e = catalog.table(spark, d, "events").select("user_id", F.round("value", 2).alias("a"), F.round(F.col("value") + F.col("event_id") % 7, 2).alias("b"), "event_id")
    return e.select("event_id", F.round(temporal.time_iou_column(F.col("a"), F.col("b"), F.lit(20.0), F.lit(25.0)), 6).alias("iou"))


def w5(spark, d):
    f = catalog.frames(spark, d).select("video_id", "keyframe_id", F.col("timestamp_sec").alias("ts"))
    return temporal.window_ends(f, 3).select("video_id", "keyframe_id", "end")


def _ocr_scores(spark, d):
    docs = catalog.table(spark, d, "documents")
    return docs.select((F.col("doc_id") % 10).cast("string").alias("video_id"), F.concat(F.when(F.col("doc_id") % 5 == 0, "0").otherwise(""), (F.col("doc_id") % 700).cast("string"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise("")).alias("keyframe_id"), F.col("n_chars").cast("double").alias("score"))


def j3(spark, d):
    found = enrich.ocr_hits(_ocr_scores(spark, d).where("score > 6000"), catalog.metadata(spark, d), "vec_id", 100_000)
    return found.select("video_id", "vec_id", "ocr_score", "normalised_score")


def j4(spark, d):
    s = catalog.segments(spark, d).withColumn("segment_id", F.concat_ws("-", "video_id", F.col("start_time").cast("int"))).withColumn("score", F.length("text").cast("double"))
    s = numbered(s, ["-score", "segment_id"])
    f = catalog.frames(spark, d).select("video_id", "vec_id", (F.col("timestamp_sec") / 4).alias("ts"))
    found = enrich.asr_hits(s, f, "vec_id", 20)
    return found.select("segment_id", "video_id", "normalised_score", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), "cover", "rank")


def j5(spark, d):
    m = catalog.metadata(spark, d)
    maps = m.where("vec_id % 3 <> 0").select("video_id", F.col("keyframe_id_int").alias("keyframe_id"), "frame_idx", "timestamp_sec", "fps", F.col("vec_id").alias("row"))
    v = m.select("video_id", (F.col("vec_id") + F.when(F.col("vec_id") % 4 == 0, 100_000).otherwise(0)).cast("int").alias("keyframe"), F.col("frame_idx").alias("frame_no"))
    return enrich.with_map(v, maps, "row")


def j6(spark, d):
    return enrich.candidate_scores(vectors(spark, d), hits(spark, d), query_vectors(spark, d, tuple(e[0] for e in EVENTS)))


def j8(spark, d):
    m = catalog.metadata(spark, d)
    return enrich.exact_frames(m, "3", 0, 60).select("video_id", "keyframe_id", "keyframe_path")


def j9(spark, d):
    f = catalog.metadata(spark, d).withColumn("ts", enrich.timestamp(F.lit(None).cast("double"), F.col("frame_idx"), F.col("fps")))
    w = f.groupBy("video_id").agg(F.max("ts").alias("m")).select("video_id", F.explode(F.array(F.lit(0.5), F.col("m") / 2 + 0.25, F.col("m") + 9)).alias("target"))
    return enrich.nearest_frame(f, w, "ts", "vec_id")


def j10(spark, d):
    f = catalog.frames(spark, d).select("video_id", "vec_id")
    return enrich.neighbours(f, f.where("vec_id % 20 = 0").select("video_id", F.col("vec_id").alias("center")), "vec_id", 3)


def j12(spark, d):
    docs = catalog.table(spark, d, "documents")
    a = docs.where("doc_id % 3 <> 0").select("doc_id", "text")
    b = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return fusion.compare_runs(a, b, "doc_id", "text")


def p7(spark, d):
    m = catalog.metadata(spark, d)
    rate = F.when(F.col("vec_id") % 2 == 0, F.col("fps")).otherwise(0.0)
    return m.select("vec_id", enrich.timestamp(F.col("timestamp_sec"), F.col("frame_idx"), rate).alias("ts"), F.coalesce("timestamp_sec", F.lit(0.0)).alias("ts_or_0"))


def a14(spark, d):
    m = catalog.metadata(spark, d)
    return enrich.timestamp_quality(m)


QUERIES = {
    "v1_l2_normalise": v1, "v2_inner_product": v2, "v3_l2_nearest": v3, "v4_pruned_nearest": v4, "v4_all_cells": v4_all, "v5_multi_query_search": v5, "v6_image_similarity": v6, "v7_encode_once": v7,
    "j1_t1_top_k_per_query": j1, "a1_multi_query_aggregation": a1, "a2_legacy_rerank": a2, "a3_weighted_rrf": a3, "a4_j7_candidate_rrf": a4, "a5_p4_score_matrix": a5, "a14_timestamp_quality": a14,
    "m1_w4_best_alignment": m1, "m2_m4_m8_k_best": m2, "m3_m4_windowed_k_best": m3, "m6_alignment_from_vectors": m6, "m9_multi_model_temporal": m9, "m11_time_iou": m11, "w5_window_ends": w5,
    "j3_a9_ocr_enrichment": j3, "j4_p6_asr_interval_join": j4, "j5_map_fallback_join": j5, "j6_candidate_vectors": j6, "j8_p5_exact_frame": j8, "j9_nearest_frame": j9, "j10_neighbours": j10,
    "j11_collisions": j11, "j12_run_comparison": j12, "p7_p8_timestamps": p7,
}

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_DIST = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"
_FRAMES = "frames AS (SELECT vec_id, label::VARCHAR AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings)"
_META = (
    _FRAMES + ", metadata AS (SELECT vec_id, video_id, lpad(vec_id::VARCHAR, 6, '0') AS keyframe_id, vec_id::INT AS keyframe_id_int, (pos * 25)::INT AS frame_idx, CASE WHEN vec_id % 7 <> 0 THEN pos::DOUBLE END AS timestamp_sec, "
    "25.0::DOUBLE AS fps, 'keyframes/emb/' || video_id || '/' || lpad(vec_id::VARCHAR, 6, '0') || '.jpg' AS keyframe_path FROM frames)"
)


def _hits(ids, k, name="hits"):
    dot = _DOT.format(a="q.embedding", b="e.embedding")
    return (
        f"{name}_s AS (SELECT q.vec_id AS query_id, e.vec_id, round({dot}, 6) AS score FROM embeddings e CROSS JOIN embeddings q WHERE {f'q.vec_id IN ({str(list(ids))[1:-1]})' if ids else 'q.vec_id % 20 = 0'}), "
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {name}_s) WHERE rank <= {k})"
    )


def _agg(source, n):
    return (
        f"(SELECT vec_id, avg_score, max_score, matched_queries, coverage_score, round(0.8 * avg_score + 0.2 * coverage_score, 9) AS alignment_score FROM "
        f"(SELECT vec_id, round(avg(score), 8) AS avg_score, max(score) AS max_score, count(DISTINCT query_id) AS matched_queries, round(count(DISTINCT query_id) / {n}::DOUBLE, 8) AS coverage_score FROM {source} GROUP BY vec_id))"
    )


def _search(name, ids, k, top):
    return f"{_hits(ids, k, name)}, {name}_r AS (SELECT *, row_number() OVER (ORDER BY alignment_score DESC, vec_id) AS rank FROM {_agg(name, len(ids))} QUALIFY rank <= {top})"


_PATH = "array_to_string(list_transform({p}, lambda x: x::VARCHAR), ',')"
_M1 = """
b0 AS (SELECT *, CASE WHEN s0 IS NOT NULL THEN struct_pack(s := s0, p := -pos, path := [pos]) END AS b FROM f),
b1 AS (SELECT video_id, pos, s1, s2, max(b) OVER w AS x FROM b0 WINDOW w AS (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c1 AS (SELECT *, CASE WHEN x IS NOT NULL AND s1 IS NOT NULL THEN struct_pack(s := x.s + s1, p := -pos, path := list_append(x.path, pos)) END AS b FROM b1),
"""

ORACLE_SQL = {
    "v1_l2_normalise": f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * vec_id) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM x)
SELECT vec_id, round(x[1] / greatest(n, 1e-12), 6) AS first, CASE WHEN n <= 1e-12 THEN round(n, 6) ELSE 1.0 END AS length FROM n""",
    "v2_inner_product": f"SELECT q.vec_id AS query_id, e.vec_id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id IN (3, 17)",
    "v3_l2_nearest": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_DIST.format(a='q.embedding', b='e.embedding')}, 6) AS d FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "v4_all_cells": f"WITH {_hits(None, 10)} SELECT * FROM hits",
    "v5_multi_query_search": f"""WITH {_hits(None, 30)}, n AS (SELECT vec_id // 100 AS event, count(*) AS n FROM embeddings WHERE vec_id % 20 = 0 GROUP BY 1), g AS (SELECT query_id // 100 AS event, vec_id, round(avg(score), 8) AS avg_score, max(score) AS max_score, count(DISTINCT query_id) AS matched_queries FROM hits GROUP BY 1, 2),
c AS (SELECT g.*, round(matched_queries / n::DOUBLE, 8) AS coverage_score FROM g JOIN n ON n.event = g.event), a AS (SELECT *, round(0.8 * avg_score + 0.2 * coverage_score, 9) AS alignment_score FROM c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY alignment_score DESC, vec_id) AS rank FROM a) WHERE rank <= 10""",
    "v6_image_similarity": f"WITH {_hits(None, 20)} SELECT * FROM hits",
    "v7_encode_once": "WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, text FROM conversations) SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END AS length FROM t",
    "j1_t1_top_k_per_query": f"WITH {_hits(None, 30)} SELECT query_id, vec_id, score, rank FROM hits",
    "a1_multi_query_aggregation": f"WITH {_hits(SUBS, 30)} SELECT * FROM {_agg('hits', len(SUBS))}",
    "a2_legacy_rerank": f"""WITH {_hits(SUBS, 30)}, a AS (SELECT vec_id AS keyframe_id, round(avg(score), 8) AS avg_score, max(score) AS max_score, count(DISTINCT query_id) AS matched_queries FROM hits WHERE vec_id % 11 <> 0 GROUP BY vec_id),
c AS (SELECT *, round(matched_queries / (SELECT count(DISTINCT query_id) FROM hits)::DOUBLE, 8) AS coverage_score FROM a) SELECT *, round(0.9 * avg_score + 0.1 * coverage_score, 9) AS alignment_score FROM c""",
    "a3_weighted_rrf": f"""WITH {_search('a', EVENTS[0], 60, 40)}, {_search('b', EVENTS[1], 60, 40)},
u AS (SELECT vec_id, rank, 1.0::DOUBLE AS w, 'one' AS l, 0 AS k FROM a_r UNION ALL SELECT vec_id, rank, 0.5::DOUBLE, 'two', 1 FROM b_r),
g AS (SELECT vec_id AS keyframe_id, round(sum(w / (60 + rank)), 9) AS rrf_score, count(*) AS matched_sources, string_agg(l, ',' ORDER BY l) AS sources, min(k * 1000 + rank) AS seen FROM u GROUP BY vec_id)
SELECT keyframe_id, rrf_score, matched_sources, sources, rank FROM (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, seen, keyframe_id) AS rank FROM g) WHERE rank <= 50""",
    "j11_collisions": f"WITH {_search('a', EVENTS[0], 60, 40)}, {_search('b', EVENTS[1], 60, 40)} SELECT a_r.vec_id::VARCHAR AS frame, 'one,two' AS labels FROM a_r JOIN b_r ON a_r.vec_id = b_r.vec_id",
    "a4_j7_candidate_rrf": f"""WITH {_FRAMES}, {_search('a', EVENTS[0], 60, 40)}, {_search('b', EVENTS[1], 60, 40)}, u AS (SELECT *, 0 AS event_idx FROM a_r UNION ALL SELECT *, 1 FROM b_r)
SELECT f.video_id, u.vec_id AS keyframe_id, event_idx, round(1.0 / (60 + rank), 9) AS rrf_score, alignment_score AS candidate_score FROM u JOIN frames f ON f.vec_id = u.vec_id""",
    "a5_p4_score_matrix": """WITH c AS (SELECT user_id AS video_id, date_trunc('day', ts) AS day, max(CASE WHEN event_type = 'view' THEN value END) AS s0, max(CASE WHEN event_type = 'click' THEN value END) AS s1, max(CASE WHEN event_type = 'purchase' THEN value END) AS s2 FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM c)
SELECT video_id, pos, date_diff('day', DATE '1970-01-01', day::DATE)::DOUBLE AS ts, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM p WHERE n >= 3""",
    "a14_timestamp_quality": f"WITH {_META} SELECT video_id, count(*) FILTER (timestamp_sec IS NULL) AS nulls, count(*) FILTER (timestamp_sec = 0) AS zeros, count(*) FILTER (timestamp_sec > 0) AS positive FROM metadata GROUP BY video_id",
    "m1_w4_best_alignment": f"""WITH f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE WHEN event_type = 'view' THEN value END AS s0, CASE WHEN event_type = 'click' THEN value END AS s1, CASE WHEN event_type = 'purchase' THEN value END AS s2 FROM events), {_M1}
b2 AS (SELECT video_id, pos, s2, max(b) OVER w AS x FROM c1 WINDOW w AS (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT video_id, max(CASE WHEN x IS NOT NULL AND s2 IS NOT NULL THEN struct_pack(s := x.s + s2, p := -pos, path := list_append(x.path, pos)) END) AS b FROM b2 GROUP BY video_id)
SELECT video_id, round(b.s, 6) AS score, {_PATH.format(p='b.path')} AS path FROM c2 WHERE b IS NOT NULL""",
    "m6_alignment_from_vectors": f"""WITH {_FRAMES}, {_search('a', EVENTS[0], 60, 40)}, {_search('b', EVENTS[1], 60, 40)}, u AS (SELECT vec_id FROM a_r UNION SELECT vec_id FROM b_r),
f AS (SELECT video_id, pos, round({_DOT.format(a='x.embedding', b='f.embedding')}, 6) AS s0, round({_DOT.format(a='y.embedding', b='f.embedding')}, 6) AS s1, NULL AS s2 FROM frames f JOIN u ON u.vec_id = f.vec_id CROSS JOIN embeddings x CROSS JOIN embeddings y WHERE x.vec_id = {EVENTS[0][0]} AND y.vec_id = {EVENTS[1][0]}), {_M1}
z AS (SELECT video_id, max(b) AS b FROM c1 GROUP BY video_id) SELECT video_id, round(b.s, 6) AS score, {_PATH.format(p='b.path')} AS path FROM z WHERE b IS NOT NULL""",
    "m11_time_iou": """WITH e AS (SELECT event_id, round(value, 2) AS a, round(value + event_id % 7, 2) AS b FROM events), h AS (SELECT *, greatest(b, 25.0) - least(a, 20.0) AS hull FROM e)
SELECT event_id, CASE WHEN hull > 1e-12 THEN round(greatest(0.0, least(b, 25.0) - greatest(a, 20.0)) / hull, 6) ELSE 0.0 END AS iou FROM h""",
    "w5_window_ends": f"WITH {_FRAMES} SELECT video_id, vec_id AS keyframe_id, count(*) OVER (PARTITION BY video_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 3 FOLLOWING) AS \"end\" FROM frames",
    "j3_a9_ocr_enrichment": f"""WITH {_META}, h AS (SELECT (doc_id % 10)::VARCHAR AS video_id, doc_id % 700 AS k, doc_id % 13 = 0 AS odd, n_chars::DOUBLE AS score FROM documents WHERE n_chars > 6000), n AS (SELECT *, round(score / (SELECT max(score) FROM h), 6) AS normalised_score FROM h)
SELECT n.video_id, m.vec_id, n.score AS ocr_score, n.normalised_score FROM n JOIN metadata m ON m.video_id = n.video_id AND m.vec_id = n.k WHERE NOT odd""",
    "j4_p6_asr_interval_join": f"""WITH {_FRAMES}, s AS (SELECT conv_id::VARCHAR || '-' || turn::INT AS segment_id, conv_id::VARCHAR AS video_id, turn::DOUBLE AS a, (turn + 1)::DOUBLE AS b, length(text)::DOUBLE AS score FROM conversations),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, segment_id) AS hit_rank, round(score / max(score) OVER (), 6) AS normalised_score FROM s),
j AS (SELECT r.*, f.vec_id, row_number() OVER (PARTITION BY segment_id ORDER BY f.vec_id) AS k FROM r JOIN frames f ON f.video_id = r.video_id AND f.pos / 4.0 BETWEEN r.a AND r.b),
g AS (SELECT segment_id, video_id, normalised_score, hit_rank, list(vec_id ORDER BY vec_id) AS frames FROM j WHERE k <= 50 GROUP BY ALL)
SELECT segment_id, video_id, normalised_score, {_PATH.format(p='frames')} AS frames, frames[1 + (len(frames) // 2)::BIGINT] AS cover, rank FROM (SELECT *, row_number() OVER (ORDER BY hit_rank) AS rank FROM g) WHERE rank <= 20""",
    "j5_map_fallback_join": f"""WITH {_META}, mp AS (SELECT * FROM metadata WHERE vec_id % 3 <> 0), v AS (SELECT video_id, (vec_id + CASE WHEN vec_id % 4 = 0 THEN 100000 ELSE 0 END)::INT AS keyframe, frame_idx AS frame_no FROM metadata)
SELECT v.*, CASE WHEN a.vec_id IS NOT NULL THEN a.timestamp_sec ELSE b.timestamp_sec END AS timestamp_sec, coalesce(a.fps, b.fps) AS fps FROM v LEFT JOIN mp a ON a.video_id = v.video_id AND a.keyframe_id_int = v.keyframe LEFT JOIN mp b ON b.video_id = v.video_id AND b.frame_idx = v.frame_no""",
    "j6_candidate_vectors": f"WITH {_hits(SUBS, 30)}, c AS (SELECT DISTINCT vec_id FROM hits) SELECT e.vec_id, q.vec_id AS query_id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings e JOIN c ON c.vec_id = e.vec_id CROSS JOIN embeddings q WHERE q.vec_id IN (3, 42)",
    "j8_p5_exact_frame": f"WITH {_META} SELECT video_id, keyframe_id, keyframe_path FROM metadata WHERE video_id = '3' AND vec_id BETWEEN 0 AND 60",
    "j9_nearest_frame": f"""WITH {_META}, f AS (SELECT video_id, vec_id, frame_idx / fps AS ts FROM metadata), m AS (SELECT video_id, max(ts) AS m FROM f GROUP BY video_id), w AS (SELECT video_id, unnest([0.5, m / 2 + 0.25, m + 9]) AS target FROM m)
SELECT video_id, target, vec_id FROM (SELECT w.*, f.vec_id, row_number() OVER (PARTITION BY w.video_id, w.target ORDER BY abs(f.ts - w.target), f.vec_id) AS k FROM w JOIN f ON f.video_id = w.video_id) WHERE k = 1""",
    "j10_neighbours": f"WITH {_FRAMES} SELECT a.video_id, b.vec_id AS center, a.vec_id, a.pos - b.pos AS \"offset\" FROM frames a JOIN frames b ON a.video_id = b.video_id WHERE b.vec_id % 20 = 0 AND abs(a.pos - b.pos) <= 3",
    "j12_run_comparison": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'both' END AS found, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN text = CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END END AS equal
FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 <> 0""",
    "p7_p8_timestamps": f"WITH {_META} SELECT vec_id, CASE WHEN timestamp_sec IS NOT NULL THEN timestamp_sec WHEN vec_id % 2 = 0 THEN frame_idx / fps END AS ts, coalesce(timestamp_sec, 0.0) AS ts_or_0 FROM metadata",
}
