"""Sources and sinks, planning, serving, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import catalog
from framewright.functions import text as T
from framewright.operators import enrich, fulltext, rerank, serve, translate, vector
from framewright.plans.query_plan import planned
from framewright.plans.search import SearchSystem, hash_encoder
from framewright.registry import language
from framewright.registry.retrieval import _FRAMES, _META, SUBS, _agg, _hits, asked, hits, vectors
from framewright.scratch import new_path, stored
from framewright.sources import files, sinks
from framewright.streaming import ingest


def s1(spark, d):
    path = new_path(spark, "metadata")
    catalog.metadata(spark, d).drop("vec_id").write.option("header", True).csv(path)
    return files.metadata_csv(spark, path).select("video_id", "keyframe_id", "keyframe_id_int", "frame_idx", "timestamp_sec", "fps", "keyframe_path")


def s3(spark, d):
    m = catalog.metadata(spark, d)
    odd = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("debug_"), F.col("vec_id").cast("string"), F.lit("_frame_"), F.col("frame_idx").cast("string"))).when(F.col("vec_id") % 3 == 1, F.col("keyframe_id")).otherwise(F.concat(F.lit("shot"), F.col("vec_id").cast("string"), F.lit("at"), F.col("frame_idx").cast("string"), F.lit("x")))
    path = m.select("vec_id", F.concat_ws("/", F.lit("root"), "dataset", "video_id", F.concat(odd, F.lit(".npy"))).alias("path"))
    k = path.select("vec_id", files.key_of_path(F.col("path")).alias("k")).select("vec_id", "k.*")
    return k.select("vec_id", "dataset", "video_id", files.keyframe_of_stem(F.col("stem")).alias("f")).select("vec_id", "dataset", "video_id", "f.*")


def _json(spark, rows, name):
    """A file per video: rows are (video_id, value)."""
    path = new_path(spark, name)
    rows.select("value", F.concat("video_id", F.lit(".d")).alias("v")).repartition("v").write.partitionBy("v").text(path)
    return path


def s4(spark, d):
    """documents as recognised frames: written as JSON text, read back as OCR documents."""
    docs = catalog.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("video_id"), F.format_string("%06d", "doc_id").alias("kf"), F.split("text", "\n").alias("texts"))
    boxes = F.transform("texts", lambda t: F.array(F.lit(0), F.lit(0), F.length(t), F.lit(1)))
    frame = F.concat(F.lit('"'), F.col("kf"), F.lit('": ['), F.to_json(boxes), F.lit(", "), F.to_json("texts"), F.lit("]"))
    videos = docs.select("video_id", frame.alias("frame")).groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list("frame")), ", ").alias("frames"))
    found = files.ocr_json(spark, _json(spark, videos.select("video_id", F.concat(F.lit("{"), "frames", F.lit("}")).alias("value")), "ocr"), suffix=".txt")
    return found.select("keyframe_id", F.size("bboxs").alias("boxes"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def s5(spark, d):
    """Conversations as speech files, one a conversation, read back."""
    turn = F.to_json(F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("text").alias("transcript")))
    videos = catalog.segments(spark, d).select("video_id", turn.alias("t")).groupBy((F.col("video_id").cast("long") % 40).cast("string").alias("video_id")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("t"), ", "), F.lit("]")).alias("value"))
    return files.asr_json(spark, _json(spark, videos, "asr"), suffix=".txt").select("start_time", "end_time", "text")


def s6(spark, d):
    """Nested frames with broken files among them: all strings below a keyframe count."""
    docs = catalog.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("video_id"), F.format_string("%06d", "doc_id").alias("kf"), F.split("text", "\n").alias("texts"))
    frame = F.concat(F.lit('"'), F.col("kf"), F.lit('": {"a": '), F.to_json("texts"), F.lit(', "b": [1, [["deep"]]]}'))
    videos = docs.select("video_id", frame.alias("frame")).groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list("frame")), ", ").alias("frames"))
    whole = videos.select("video_id", F.when(F.col("video_id") % 7 == 3, "{broken").otherwise(F.concat(F.lit("{"), "frames", F.lit("}"))).alias("value"))
    found = files.screen_text_json(spark, _json(spark, whole, "screen"), suffix=".txt")
    return found.select("keyframe_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def s9(spark, d):
    """The vocabulary written as JSON lines and read back."""
    from framewright.operators import vocab

    path = new_path(spark, "vocabulary")
    files.write_vocabulary(vocab.domain_vocabulary(catalog.table(spark, d, "documents"), "source", "text", 3, 0.5), path)
    return files.vocabulary_json(spark, path, lines=True)


def s15(spark, d):
    """Vectors cached as bytes and read back."""
    path = new_path(spark, "cache")
    sinks.cache_vectors(vectors(spark, d), path, 64)
    return sinks.cached_vectors(spark, path).select("vec_id", F.size("embedding").alias("size"), F.round(F.get("embedding", F.lit(7)).cast("double"), 6).alias("eighth"))


def p9(spark, d):
    """Frames of one event: those that name no event or this one."""
    e = catalog.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("sub_query_idx"), "value", F.lit(1).alias("rank"))
    return enrich.of_event(e, 1, ["-value", "event_id"]).select("event_id", "sub_query_idx", "rank")


def x30(spark, d):
    """Texts turned round by a translator that fails on batches with a certain text and on that text."""

    def batch(texts):
        if any("z" in t for t in texts):
            raise ValueError("no translation")
        return [t[::-1] for t in texts]

    c = catalog.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return translate.translated(c, "text", "said", batch).select("conv_id", "turn", "said")


def x31(spark, d):
    e = catalog.table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, (200, 412, 500, 202, 200, 200))), (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    body = F.when(F.col("event_id") % 6 == 0, '{"submission": "correct"}').when(F.col("event_id") % 6 == 4, '{"submission": "WRONG"}').when(F.col("event_id") % 6 == 2, '{"description": "down"}').otherwise("{}")
    return e.select("event_id", serve.verdict(F.col("status"), body).alias("v")).select("event_id", "v.status", "v.message")


def s8(spark, d):
    """Bigrams written as tab-separated text with a bad row, and read back."""
    from framewright.operators import vocab

    path = new_path(spark, "bigrams")
    b = vocab.bigrams(catalog.table(spark, d, "documents"), "doc_id", "text")
    b.select(F.concat_ws("\t", "w1", "w2", F.col("n").cast("string")).alias("value")).union(spark.createDataFrame([("w1\tw2\tcount",), ("broken",)], "value string")).write.text(path)
    return files.frequency_tsv(spark, path, 2).select(F.col("w1"), F.col("w2"), "n")


def s13(spark, d):
    docs = catalog.table(spark, d, "documents").select("doc_id", "text")
    index = sinks.FullTextIndex(spark, new_path(spark, "fulltext"), "doc_id", "text")
    index.create(docs.where("doc_id % 2 = 0"))
    index.insert(docs)
    # a version without some, and one that writes these and others again
    index.remove(docs.where("doc_id % 5 = 0"))
    index.bulk(docs.where("doc_id % 5 = 0 or doc_id % 7 = 0"))
    return index.search("de la", 25)


def s14(spark, d):
    index = sinks.VectorIndex(spark, new_path(spark, "vectors"))
    index.create(vectors(spark, d).where("vec_id % 3 > 0"))
    index.remove(vectors(spark, d).where("vec_id % 5 = 0"))
    index.insert(vectors(spark, d))
    return sinks.VectorIndex(spark, index.path).search(asked(spark, d), 10).select("query_id", "vec_id", "rank", F.round("score", 3).alias("score"))


def s16(spark, d):
    path = new_path(spark, "maps")
    m = catalog.metadata(spark, d).withColumn("timestamp_sec", F.coalesce("timestamp_sec", F.lit(-1.0)))
    sinks.keyframe_map(m, path)
    return files.keyframe_maps(spark, path).select("video_id", "keyframe_id", "frame_idx", "timestamp_sec", "fps")


def s17(spark, d):
    """Two runs of a file stream over a folder that grows between them; the second takes what is new."""
    source, sink, state = (new_path(spark, n) for n in ("arrivals", "arrived", "state"))
    e = catalog.table(spark, d, "events").select("event_id", "user_id", "value")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(source)
        ingest.ingest(spark, source, e.schema, sink, state, lambda df: df.where("value > 20"))
    return spark.read.schema(e.schema).parquet(sink).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def s17_skip(spark, d):
    docs, done = catalog.table(spark, d, "documents").select("doc_id", "source"), catalog.table(spark, d, "labels")
    return sinks.unprocessed(docs, done, ["doc_id"])


def sessions(spark, d):
    e = catalog.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = ingest.sessions(e, "ts", "user_id", "6 hours", "1 day")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


def s12(spark, d):
    m = catalog.metadata(spark, d).select("dataset", "video_id", "source_name", "keyframe_id_int")
    kinds = F.when(F.col("keyframe_id_int") % 3 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).when(F.col("keyframe_id_int") % 3 == 1, F.array(F.lit(".webp"))).otherwise(F.array().cast("array<string>"))
    f = m.select("dataset", "video_id", F.col("keyframe_id_int").cast("string").alias("stem"), F.explode(kinds).alias("s")).select("dataset", "video_id", "stem", F.concat_ws("/", F.lit("k"), "video_id", F.concat("stem", "s")).alias("path"))
    return files.keyframe_files(m, f).select("keyframe_id_int", "path")


def x32(spark, d):
    t = catalog.table(spark, d, "conversations").select("conv_id", "turn", files.recognised_lines(F.when(F.col("turn") == 1, " NO_TEXT ").otherwise(F.col("text"))).alias("lines"))
    return t.select("conv_id", "turn", F.size("lines").alias("n"), F.array_join("lines", "|").alias("lines"))


def _ranked(spark, d):
    h = vector.aggregate_queries(hits(spark, d), len(SUBS), 60)
    return h.join(catalog.frames(spark, d).select("vec_id", "video_id", F.col("timestamp_sec").alias("ts")), "vec_id").withColumn("score", F.col("alignment_score"))


def a10(spark, d):
    return serve.by_video(_ranked(spark, d)).select("vec_id", "video_id", "group_score", "place_in_group", "group_rank")


def w7(spark, d):
    r = _ranked(spark, d)
    return serve.page(r, 2, 7).select("vec_id", "rank").unionAll(serve.page(r, 99, 7).select("vec_id", "rank"))


def q4(spark, d):
    g = _ranked(spark, d).groupBy("video_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("rank", "vec_id", F.col("score").alias("s")))).alias("q"))
    g = g.withColumn("matched_sequence", F.transform("q", lambda x: F.struct(x["vec_id"].alias("vec_id"), F.when(x["vec_id"] % 2 == 0, x["s"]).alias("score")))).drop("q")
    g = g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "video_id")))
    return serve.flattened(g).select("video_id", "vec_id", "score", "rank")


def q8(spark, d):
    return _ranked(spark, d).select("vec_id", serve.serialised(_ranked(spark, d).select("vec_id", "video_id", "alignment_score", "avg_score")).alias("json"))


def x20(spark, d):
    e = catalog.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "-Infinity").when(F.col("event_id") % 5 == 2, "abc").otherwise(F.col("event_id").cast("string")).alias("t"))
    return e.select("event_id", serve.safe_double(F.col("t"), -1.0).alias("d"), serve.safe_int(F.col("t")).alias("i"))


def x21(spark, d):
    m = catalog.metadata(spark, d)
    number = F.when(F.col("vec_id") % 2 == 0, F.col("vec_id").cast("string")).otherwise(F.concat(F.lit("k"), F.col("vec_id").cast("string")))
    return m.select("vec_id", serve.frame_path(F.col("dataset"), F.col("video_id"), number).alias("path"), serve.video_link(F.concat(F.lit("v/"), "video_id"), F.col("timestamp_sec")).alias("link"))


def x22(spark, d):
    m = catalog.metadata(spark, d)
    return m.select("vec_id", T.mmss(F.col("frame_idx") / F.lit(4.0)).alias("time"), T.padded(F.col("vec_id") * 10007).alias("padded"), T.frame_of(F.col("vec_id") * 500, F.lit(25.0)).alias("frame"))


def x24(spark, d):
    """Judgements written as whole, broken, fenced and plain text from labels and event values."""
    e = catalog.table(spark, d, "events").select("event_id", "user_id", F.round(F.pmod(F.col("value"), F.lit(1.0)), 2).alias("v"))
    whole = F.concat(F.lit('{"object_match": '), F.col("v"), F.lit(', "action_match": 1.5, "scene_match": '), F.col("v"), F.lit(', "confidence": 0.9, "explanation": "fits"}'))
    raw = F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 45)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("object_match: "), F.col("v"), F.lit(", text_match: 0.5"))).when(F.col("event_id") % 5 == 3, "no idea").otherwise(whole)
    answer = F.when(F.col("event_id") % 2 == 0, "Yes, it does").otherwise("NO")
    return rerank.reranked(e.select("event_id", raw.alias("raw"), answer.alias("answer"), F.lit(0.3).alias("clip")), ["event_id"], "raw", "clip", "answer")


def x27(spark, d):
    e = catalog.table(spark, d, "events").select("user_id", F.round(F.pmod(F.col("value"), F.lit(1.0)), 2).alias("v"))
    raw = F.concat(F.lit('{"object_match":'), F.col("v"), F.lit(',"emotion_match":1,"confidence":0.25}'))
    return rerank.reranked(e.select("user_id", raw.alias("raw"), F.col("v").alias("clip")), ["user_id"], "raw", "clip").select("user_id", "relevance_score", "decision", "confidence")


def x29(spark, d):
    c = catalog.table(spark, d, "conversations")
    raw = F.concat(F.lit("<|im_start|>assistant\nTranslation: "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), F.regexp_replace("text", '"', ""), F.lit('"'))).otherwise(F.col("text")), F.lit("  <|im_end|>\n"))
    return c.select("conv_id", "turn", T.model_output(raw).alias("out"))


def x33(spark, d):
    v = catalog.table(spark, d, "events").select("event_id", F.array(F.col("value") - 20, F.col("value") - 10, F.col("value") * 3, F.lit(60.0)).alias("b"))
    box = serve.clamped_box(F.col("b"), 100, 50)
    return v.select("event_id", *[F.round(F.get(box, F.lit(i)), 6).alias(f"c{i}") for i in range(4)])


def a11(spark, d):
    e = catalog.table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("scenes"), (F.col("value") / 1000).alias("seconds"))
    return serve.latency_summary(e, ["event_type", "scenes"], "seconds")


def _pairs(spark, d):
    c = catalog.table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("int").cast("string")).alias("conv_id"), "text")
    return c.withColumn("out", F.regexp_replace("text", "th", "t"))


def a12(spark, d):
    p = _pairs(spark, d)
    return serve.bleu(p, "conv_id", "text", "out").join(serve.char_f(p, "conv_id", "text", "out"))  # one row each


def t10(spark, d):
    docs = catalog.table(spark, d, "documents").select("doc_id", F.round(serve.substring_score(F.col("text"), ["the", "ing"]), 6).alias("score")).where("score > 0")
    return docs.orderBy(F.desc("score"), "doc_id").limit(30)


def t11(spark, d):
    docs = catalog.table(spark, d, "documents").select("doc_id", serve.token_score(F.col("text"), "the of and ereaan", 9).alias("score"))
    return docs.orderBy(F.desc("score"), "doc_id").limit(30)


def u2(spark, d):
    """Overlap of a document's words with the next one's, and what either lacks, over sources."""
    docs = catalog.table(spark, d, "documents").select("doc_id", F.array_distinct(T.words(F.lower("text"))).alias("w"))
    both = docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") + 1 == F.col("b.doc_id"))
    common = F.size(F.array_intersect("a.w", "b.w"))
    return both.select("a.doc_id", F.round(common / F.greatest(F.lit(1), F.least(F.size("a.w"), F.size("b.w"))), 6).alias("overlap"), F.size(F.array_except("a.w", "b.w")).alias("only_a"))


def u4(spark, d):
    e = catalog.table(spark, d, "events")
    return enrich.first_of_each(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def p1(spark, d):
    """Display columns that exist, of frames with a usable id and of videos with enough frames."""
    m = catalog.metadata(spark, d).withColumn("vec_id", F.when(F.col("vec_id") % 17 == 0, -1).otherwise(F.col("vec_id")))
    return serve.display(enrich.videos_of(m.where("vec_id >= 0"), 45), (*catalog.DISPLAY, "score", "missing")).drop("source_name", "embedding_path", "dataset")


def x28(spark, d):
    """Parts as pictures whose sides follow from their keys and sizes."""
    p = catalog.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1800 + 100).cast("int").alias("width"), (F.col("p_size") * 37 + 100).cast("int").alias("height"))
    return p.select("p_partkey", rerank.picture_grid(F.col("width"), F.col("height")).alias("g")).select("p_partkey", "g.columns", "g.rows")


def q1(spark, d):
    return planned(catalog.table(spark, d, "benchmark"), "item_id", "text")


def _system(spark, d):
    f = catalog.frames(spark, d).select("vec_id", F.lit("emb").alias("dataset"), "video_id", F.col("keyframe_id").cast("string").alias("keyframe_id"), F.col("timestamp_sec").alias("ts"))
    docs = catalog.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    places = docs.select("doc", (F.col("doc") % 10).cast("string").alias("video_id"), (F.col("doc") % 500).cast("string").alias("keyframe_id"))
    seg = catalog.segments(spark, d).withColumn("segment_id", F.concat_ws("-", "video_id", F.col("start_time").cast("int")))
    # a search that takes neither builds neither
    screen = lambda: (stored(fulltext.postings(docs, "doc", "text"), "postings"), places)
    speech = lambda: (stored(fulltext.postings(seg, "segment_id", "text"), "postings"), seg.select("segment_id", "video_id", "start_time", "end_time"))
    swapped = vectors(spark, d).select("vec_id", F.reverse("embedding").alias("embedding"))
    return SearchSystem(spark, f, {"hash": (vectors(spark, d), hash_encoder), "reversed": (swapped, hash_encoder)}, screen, speech)


def q2(spark, d):
    _, found = _system(spark, d).search("of the, and that. in this. with the", "auto", 10)
    return found.select("video_id", "score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "rank")


def f11(spark, d):
    return _system(spark, d).ocr_search("of the and", 10).select("vec_id", "ocr_score", "score", "rank")


def q3(spark, d):
    found = _system(spark, d).advanced("of the, and that. in this", ["hash", "reversed"], use_ocr=True, use_asr=True, top_k=20, weights={"ocr": 0.5})
    return found.select("vec_id", "rrf_score", "matched_sources", F.array_join("source_models", ",").alias("sources"), "rank")


def q3t(spark, d):
    found = _system(spark, d).advanced("of the, and that. in this", ["hash", "reversed"], temporal_mode=True, use_ocr=True, use_asr=True, top_k=20)
    return found.select("video_id", "score", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "rank")


def f12_search(spark, d):
    """Speech search with the frames inside each segment and the one to show."""
    found = _system(spark, d).asr_search("of the", 10)
    return found.select("segment_id", "video_id", "score", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), "cover", "rank")


QUERIES = {
    "s5_asr_json": s5, "s6_nested_text": s6, "s9_vocabulary_json": s9, "s15_vector_cache": s15, "p9_of_event": p9, "x30_translated": x30, "x31_verdicts": x31, "f12_asr_search": f12_search,
    "s1_metadata_csv": s1, "s3_path_keys": s3, "s4_ocr_json": s4, "s8_frequency_tsv": s8, "s12_keyframe_files": s12, "s13_fulltext_index": s13, "s14_vector_index": s14, "s16_s7_keyframe_maps": s16,
    "s17_incremental_stream": s17, "s17_skip_processed": s17_skip, "stream_sessions": sessions, "x32_recognised_lines": x32, "a10_by_video": a10, "w7_pages": w7, "q4_flattened": q4, "q8_serialised": q8,
    "x20_safe_casts": x20, "x21_paths": x21, "x22_x23_times": x22, "x24_x26_judgements": x24, "x27_a13_sequence_rerank": x27, "x29_model_output": x29, "x33_boxes": x33, "a11_latency": a11, "a12_bleu_char_f": a12,
    "t10_substring_score": t10, "t11_token_score": t11, "q1_query_plan": q1, "x28_picture_grid": x28, "u2_u5_u6_sets": u2, "u4_first_of_each": u4, "p1_p2_p3_p4_display": p1, "q2_dispatch": q2, "q3_advanced_frames": q3, "q3_m10_advanced_temporal": q3t, "f10_f11_ocr_search": f11,
}

_RANKED = f"{_FRAMES}, {_hits(SUBS, 30)}, rk AS (SELECT *, row_number() OVER (ORDER BY alignment_score DESC, vec_id) AS rank FROM {_agg('hits', len(SUBS))} QUALIFY rank <= 60), r AS (SELECT rk.*, f.video_id, f.pos AS ts, alignment_score AS score FROM rk JOIN frames f ON f.vec_id = rk.vec_id)"
_REL = "0.25 * {o} + 0.2 * {a} + 0.15 * {s} + 0.1 * {t} + 0.1 * {r} + 0.04 * {x} + 0.03 * {e}"
_DEC = "CASE WHEN {r} >= 0.75 THEN 'strong' WHEN {r} >= 0.45 THEN 'relevant' WHEN {r} >= 0.2 THEN 'weak' ELSE 'irrelevant' END"

_BIG = "(SELECT conv_id, array_to_string(ws[i:i + {m}], ' ') AS g, count(*) AS c FROM (SELECT conv_id, ws, unnest(range(1, len(ws) - {m} + 1)) AS i FROM {t}) GROUP BY 1, 2)"


def _bleu():
    parts = []
    for n in range(1, 5):
        r, h = _BIG.format(m=n - 1, t="r"), _BIG.format(m=n - 1, t="h")
        parts.append(f"SELECT ln((coalesce(sum(least(h.c, coalesce(r.c, 0))), 0) + 1.0) / (coalesce(sum(h.c), 0) + 1)) AS p FROM {h} h LEFT JOIN {r} r ON r.conv_id = h.conv_id AND r.g = h.g")
    words = "list_filter(string_split_regex(trim(lower({c}), ' '), '[\\s\\x0b]+'), lambda x: x <> '')"
    chars = "(SELECT conv_id, ch, count(*) AS c FROM (SELECT conv_id, unnest(string_split(replace(lower({c}), ' ', ''), '')) AS ch FROM p) WHERE ch <> '' GROUP BY 1, 2)"
    return f"""WITH p AS (SELECT conv_id::VARCHAR || '-' || turn::INT AS conv_id, text, replace(text, 'th', 't') AS o FROM conversations), r AS (SELECT conv_id, {words.format(c='text')} AS ws FROM p), h AS (SELECT conv_id, {words.format(c='o')} AS ws FROM p),
l AS ({' UNION ALL '.join(parts)}), s AS (SELECT (SELECT sum(len(ws)) FROM r) AS a, (SELECT sum(len(ws)) FROM h) AS b),
m AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, sum(least(coalesce(x.c, 0), coalesce(y.c, 0))) AS o, sum(coalesce(x.c, 0)) AS r, sum(coalesce(y.c, 0)) AS h FROM {chars.format(c='text')} x FULL JOIN {chars.format(c='o')} y ON x.conv_id = y.conv_id AND x.ch = y.ch GROUP BY 1),
f AS (SELECT avg(coalesce(2 * (m.o / greatest(m.h, 1)) * (m.o / greatest(m.r, 1)) / greatest(m.o / greatest(m.h, 1) + m.o / greatest(m.r, 1), 1e-12), 0)) AS f FROM p LEFT JOIN m ON m.conv_id = p.conv_id)
SELECT round(100 * CASE WHEN b >= a THEN 1.0 ELSE exp(1 - a / greatest(b, 1)::DOUBLE) END * exp((SELECT avg(p) FROM l)), 6) AS bleu, round(100 * (SELECT f FROM f), 6) AS char_f FROM s"""


ORACLE_SQL = {
    "a12_bleu_char_f": _bleu(),
    "u2_u5_u6_sets": "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(trim(lower(text), ' '), '[\\s\\x0b]+'), lambda x: x <> '')) AS w FROM documents), j AS (SELECT a.doc_id, a.w AS a, b.w AS b, len(list_intersect(a.w, b.w)) AS c FROM w a JOIN w b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(c / greatest(1, least(len(a), len(b))), 6) AS overlap, (len(a) - c)::INT AS only_a FROM j",
    "u4_first_of_each": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "p1_p2_p3_p4_display": f"WITH {_META}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM metadata WHERE vec_id % 17 <> 0) SELECT video_id, keyframe_id, frame_idx, timestamp_sec, fps, keyframe_path FROM n WHERE n >= 45",
    "x27_a13_sequence_rerank": f"""WITH e AS (SELECT user_id, avg(round(value % 1.0, 2)) AS o, max(round(value % 1.0, 2)) AS clip FROM events GROUP BY user_id), r AS (SELECT *, 0.0::DOUBLE + 0.25 * o + 0.03 * 1.0 AS rel FROM e),
f AS (SELECT user_id, round(rel, 4) AS relevance_score, {_DEC.format(r='rel')} AS decision, 0.25::DOUBLE AS confidence FROM r) SELECT * FROM f""",
    "s13_fulltext_index": language._full(["de", "la"], "doc_id", 25),
    "s5_asr_json": "SELECT turn::DOUBLE AS start_time, (turn + 1)::DOUBLE AS end_time, text FROM conversations",
    "s6_nested_text": "WITH l AS (SELECT doc_id, list_append(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]')), 'deep') AS t FROM documents WHERE (doc_id // 50) % 7 <> 3) SELECT lpad(doc_id::VARCHAR, 6, '0') AS keyframe_id, len(t)::INT AS n, md5(array_to_string(t, '|')) AS texts_md5 FROM l",
    "s9_vocabulary_json": language.ORACLE_SQL["a7_domain_vocabulary"],
    "s15_vector_cache": "SELECT vec_id, len(embedding)::INT AS size, round(embedding[8]::DOUBLE, 6) AS eighth FROM embeddings",
    "p9_of_event": "SELECT event_id, 1 AS sub_query_idx, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events WHERE event_id % 3 IN (0, 1)",
    "x30_translated": "SELECT conv_id, turn, CASE WHEN contains(text, 'z') OR trim(text) = '' THEN text ELSE reverse(text) END AS said FROM conversations",
    "x31_verdicts": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'error' WHEN 4 THEN 'wrong' ELSE 'pending' END AS status, CASE event_id % 6 WHEN 0 THEN 'Correct!' WHEN 1 THEN 'Wrong Answer' WHEN 2 THEN 'down' WHEN 3 THEN 'Submitted, waiting for verdict' WHEN 4 THEN 'Wrong Answer' ELSE 'Submitted' END AS message FROM events",
    "s1_metadata_csv": f"WITH {_META} SELECT video_id, keyframe_id, keyframe_id_int, frame_idx, timestamp_sec, fps, keyframe_path FROM metadata",
    "s3_path_keys": f"WITH {_META} SELECT vec_id, 'emb' AS dataset, video_id, keyframe_id_int, keyframe_id, CASE WHEN vec_id % 3 <> 1 THEN frame_idx END AS frame_idx FROM metadata",
    "s4_ocr_json": "SELECT lpad(doc_id::VARCHAR, 6, '0') AS keyframe_id, len(string_split(text, chr(10)))::INT AS boxes, md5(replace(text, chr(10), '|')) AS texts_md5 FROM documents",
    "s8_frequency_tsv": "WITH w AS (SELECT list_filter(string_split_regex(trim(lower(text), ' '), '[\\s\\x0b]+'), lambda x: x <> '') AS ws FROM documents), b AS (SELECT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT w1, w2, count(*) AS n FROM b GROUP BY w1, w2",
    "s12_keyframe_files": f"WITH {_META} SELECT keyframe_id_int, CASE vec_id % 3 WHEN 0 THEN 'k/' || video_id || '/' || vec_id || '.jpg' WHEN 1 THEN 'k/' || video_id || '/' || vec_id || '.webp' ELSE 'emb/' || video_id || '/' || keyframe_id || '.jpg' END AS path FROM metadata",
    "s14_vector_index": f"WITH {_hits(None, 10)} SELECT query_id, vec_id, rank, round(score, 3) AS score FROM hits",
    "s16_s7_keyframe_maps": f"WITH {_META} SELECT video_id, (frame_idx / 25)::INT AS keyframe_id, frame_idx, coalesce(timestamp_sec, -1.0) AS timestamp_sec, fps FROM metadata",
    "s17_incremental_stream": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 20 GROUP BY user_id",
    "s17_skip_processed": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 21600 AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "x32_recognised_lines": "WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN []::VARCHAR[] ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS x FROM conversations) SELECT conv_id, turn, len(x)::INT AS n, array_to_string(x, '|') AS lines FROM l",
    "a10_by_video": f"WITH {_RANKED}, g AS (SELECT *, max(score) OVER (PARTITION BY video_id) AS group_score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ts) AS place_in_group FROM r) SELECT vec_id, video_id, group_score, place_in_group, dense_rank() OVER (ORDER BY group_score DESC, video_id) AS group_rank FROM g",
    "w7_pages": f"WITH {_RANKED} SELECT vec_id, rank FROM r WHERE rank BETWEEN 8 AND 14 UNION ALL SELECT vec_id, rank FROM r WHERE rank > 7 * (ceil((SELECT max(rank) FROM r) / 7.0) - 1)",
    "q4_flattened": f"WITH {_RANKED}, g AS (SELECT video_id, max(score) AS best FROM r GROUP BY video_id) SELECT r.video_id, vec_id, CASE WHEN vec_id % 2 = 0 THEN score ELSE best END AS score, row_number() OVER (ORDER BY best DESC, r.video_id, r.rank) AS rank FROM r JOIN g ON g.video_id = r.video_id",
    "x20_safe_casts": "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN -1.0 ELSE event_id::DOUBLE END AS d, CASE WHEN event_id % 5 >= 3 THEN event_id END AS i FROM events",
    "x21_paths": f"WITH {_META} SELECT vec_id, 'emb/' || video_id || '/' || CASE WHEN vec_id % 2 = 0 THEN keyframe_id ELSE 'k' || vec_id END || '.jpg' AS path, 'v/' || video_id || CASE WHEN timestamp_sec IS NULL THEN '' ELSE '#t=' || printf('%.2f', timestamp_sec) END AS link FROM metadata",
    "x22_x23_times": f"WITH {_META}, t AS (SELECT *, frame_idx / 4.0 AS s FROM metadata) SELECT vec_id, printf('%02d:%05.2f', floor(s / 60)::INT, s - floor(s / 60) * 60) AS time, CASE WHEN length((vec_id * 10007)::VARCHAR) < 6 THEN lpad((vec_id * 10007)::VARCHAR, 6, '0') ELSE (vec_id * 10007)::VARCHAR END AS padded, round_even(vec_id * 0.5 * 25, 0)::BIGINT AS frame FROM t",
    "x24_x26_judgements": f"""WITH e AS (SELECT event_id, event_id % 5 AS m, round(value % 1.0, 2) AS v, event_id % 2 = 0 AS yes FROM events),
s AS (SELECT *, CASE WHEN m = 3 THEN CASE WHEN yes THEN 0.75 ELSE 0.1 END ELSE v END AS o, CASE WHEN m IN (0, 1, 4) THEN 1.0 WHEN m = 2 THEN 0.0 WHEN yes THEN 0.75 ELSE 0.1 END AS a, CASE WHEN m IN (1, 4) THEN v WHEN m IN (0, 2) THEN 0.0 WHEN yes THEN 0.75 ELSE 0.1 END AS sc,
 CASE WHEN m = 3 THEN CASE WHEN yes THEN 0.75 ELSE 0.1 END ELSE 0.0 END AS t, CASE WHEN m = 2 THEN 0.5 ELSE 0.0 END AS x, CASE WHEN m IN (1, 4) THEN 0.9 ELSE 0.5 END AS confidence FROM e),
r AS (SELECT *, 0.0::DOUBLE + {_REL.format(o='o', a='a', s='sc', t='t', r='t', x='x', e='0.0')} AS rel FROM s),
f AS (SELECT event_id, round(rel, 4) AS relevance_score, {_DEC.format(r='rel')} AS decision, confidence, round(0.4 * 0.3 + 0.6 * rel, 4) AS final_score FROM r)
SELECT *, row_number() OVER (ORDER BY final_score DESC, event_id) AS rank FROM f""",
    "x33_boxes": """WITH b AS (SELECT event_id, least(greatest(value - 20, 0.0), 100.0) AS x1, least(greatest(value - 10, 0.0), 50.0) AS y1, least(greatest(value * 3, 0.0), 100.0) AS x2, 50.0::DOUBLE AS y2 FROM events)
SELECT event_id, CASE WHEN x2 > x1 AND y2 > y1 THEN round(x1, 6) END AS c0, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y1, 6) END AS c1, CASE WHEN x2 > x1 AND y2 > y1 THEN round(x2, 6) END AS c2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS c3 FROM b""",
    "a11_latency": "SELECT event_type, user_id % 3 AS scenes, count(*) AS runs, round(avg(value / 1000), 6) AS mean_s, round(min(value / 1000), 6) AS min_s, round(max(value / 1000), 6) AS max_s FROM events GROUP BY 1, 2",
    "t10_substring_score": "WITH s AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'ing', ''))) / 3 AS score FROM documents) SELECT doc_id, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30",
    "t11_token_score": """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(trim(lower(text), ' '), '[\\s\\x0b]+'), lambda x: x <> '')) AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x IN ('the', 'of', 'and', 'ereaan'))) AS c FROM w) SELECT doc_id, round(0.75 * c / 4 + 0.25 * c / greatest(n, 1), 9) AS score FROM s ORDER BY score DESC, doc_id LIMIT 30""",
    "f10_f11_ocr_search": f"""WITH {_FRAMES}, h AS (SELECT *, round(score / max(score) OVER (), 6) AS ns FROM ({language._full(["of", "the", "and"], "doc", 30)})), j AS (SELECT f.vec_id, h.score AS ocr_score, ns AS score, row_number() OVER (ORDER BY ns DESC, f.video_id, f.vec_id) AS rank FROM h JOIN frames f ON f.video_id = (doc % 10)::VARCHAR AND f.vec_id = doc % 500)
SELECT * FROM j WHERE rank <= 10""",
    "f12_asr_search": f"""WITH {_FRAMES}, s AS (SELECT conv_id::VARCHAR || '-' || turn::INT AS segment_id, conv_id::VARCHAR AS video_id, turn::DOUBLE AS a, (turn + 1)::DOUBLE AS b FROM conversations),
h AS (SELECT x.segment_id, video_id, a, b, x.rank AS hit_rank, round(score / max(score) OVER (), 6) AS score FROM ({language._full(["of", "the"], "segment_id", 30, where="true", key="conv_id::VARCHAR || '-' || turn::INT", table="conversations")}) x JOIN s ON s.segment_id = x.segment_id),
j AS (SELECT h.*, f.vec_id, row_number() OVER (PARTITION BY segment_id ORDER BY f.vec_id) AS k FROM h JOIN frames f ON f.video_id = h.video_id AND f.pos BETWEEN a AND b), g AS (SELECT segment_id, video_id, score, hit_rank, list(vec_id ORDER BY vec_id) AS frames FROM j WHERE k <= 50 GROUP BY ALL)
SELECT segment_id, video_id, score, array_to_string(list_transform(frames, lambda x: x::VARCHAR), ',') AS frames, frames[1 + (len(frames) // 2)::BIGINT] AS cover, rank FROM (SELECT *, row_number() OVER (ORDER BY hit_rank) AS rank FROM g) WHERE rank <= 10""",
    "x28_picture_grid": """WITH p AS (SELECT p_partkey, 100 + p_partkey % 1800 AS w, 100 + p_size * 37 AS h FROM part), g AS (SELECT c, r FROM range(1, 13) a(c) CROSS JOIN range(1, 13) b(r) WHERE c * r <= 12),
k AS (SELECT p_partkey, c, r, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(w / h - c / r), CASE WHEN w * h > c * r * 100352 THEN -c * r ELSE c * r END, c, r) AS n FROM p CROSS JOIN g)
SELECT p_partkey, c::INT AS columns, r::INT AS rows FROM k WHERE n = 1""",
    "q1_query_plan": r"""WITH q AS (SELECT item_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(10), ' '), '[.;]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS e FROM benchmark),
d AS (SELECT item_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS e FROM q),
v AS (SELECT item_id, CASE WHEN len(e) > 1 THEN 'temporal' ELSE 'semantic' END AS mode, unnest(range(0, len(e)))::INT AS event_idx, unnest(e) AS event FROM d),
p AS (SELECT *, list_filter(list_transform(list_prepend(event, string_split(event, ',')), lambda x: trim(x)), lambda x: x <> '') AS p FROM v),
s AS (SELECT *, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i) AS s FROM p)
SELECT item_id, mode, event_idx, unnest(range(0, len(s)))::INT AS sub_idx, unnest(s) AS text FROM s""",
}
