"""The engine's search API: semantic, temporal, screen text, speech, automatic and fused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import enrich, fulltext, fusion, temporal, vector
from framewright.operators.translate import Gate
from framewright.plans.query_plan import QueryPlan, candidate_k, plan

Encoder = Callable[[DataFrame], DataFrame]
#: Postings and the places of their keys.
Texts = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Model:
    """Vectors ``(vec_id, embedding)``, the encoder of texts (None: the model takes pictures alone), and whether it is asked unless named."""

    vectors: DataFrame
    encoder: Encoder | None
    enabled: bool = True

    @property
    def supports_text(self) -> bool:
        return self.encoder is not None


def chosen_models(models: dict[str, Model], names: list[str] | None = None) -> dict[str, Model]:
    """The named models, enabled or not, or else the enabled ones; unknown names are an error."""
    if not names:
        return {name: m for name, m in models.items() if m.enabled}
    if missing := sorted({*names} - {*models}):
        raise ValueError(f"unknown models {missing}; there are {sorted(models)}")
    return {name: m for name, m in models.items() if name in names}


def hash_encoder(texts: DataFrame) -> DataFrame:
    """The stand-in for a model: ``(query_id, text)`` -> ``(query_id, vector)``."""
    return texts.select("query_id", vector.hash_encode(F.col("text")).alias("vector"))


class SearchSystem:
    """Tables and hooks of an installation.

    models: name -> Model, or (vectors, encoder); frames:
    ``(vec_id, dataset, video_id, keyframe_id, ts)``; ocr and asr: postings with
    the key columns of their documents, as made by fulltext.postings() with the
    keys "doc" and "segment_id", and tables that give each key its place; or a
    function that gives both, which is called when first searched.
    Every method returns a lazy DataFrame, best rows first by ``rank``; an empty
    plan gives no rows.  translate, a Gate or a function, is applied to vector
    queries only; a request may force it on or off.
    """

    def __init__(self, spark: SparkSession, frames: DataFrame, models: dict[str, tuple[DataFrame, Encoder]], ocr: Texts | Callable[[], Texts] | None = None, asr: Texts | Callable[[], Texts] | None = None, translate: Gate | Callable[[str], str] | None = None):
        if not models:
            raise RuntimeError("no model is loaded")
        self.models = {name: m if isinstance(m, Model) else Model(*m) for name, m in models.items()}
        self.spark, self.frames, self.ocr, self.asr, self.translate = spark, frames, ocr, asr, translate if isinstance(translate, Gate) else Gate(translate)

    def _texts(self, name: str) -> Texts:
        """The postings and places of "ocr" or "asr", opened once."""
        if callable(found := getattr(self, name)):
            setattr(self, name, found := found())
        return found

    def available_models(self) -> list[str]:
        """Enabled models."""
        return sorted(chosen_models(self.models))

    def text_models(self) -> list[str]:
        """Enabled models that take texts."""
        return [name for name, m in sorted(chosen_models(self.models).items()) if m.supports_text]

    def _chosen(self, model: str | None) -> tuple[DataFrame, Encoder]:
        if model is None and not self.text_models():
            raise RuntimeError("no model takes texts")
        name = model or next(n for n in self.models if n in self.text_models())
        if name not in self.models:
            raise KeyError(f"unknown model {name}")
        if not self.models[name].supports_text:
            raise ValueError(f"model {name} takes pictures alone")
        return self.models[name].vectors, self.models[name].encoder

    def _semantic(self, subs: list[str], top_k: int, wide_k: int, model: str | None) -> DataFrame:
        vectors, encode = self._chosen(model)
        texts = self.spark.createDataFrame(list(enumerate(subs)), "query_id int, text string")
        found = vector.multi_query_search(vectors, encode(texts), top_k, wide_k)
        return found.join(self.frames, "vec_id").withColumn("score", F.col("alignment_score"))

    def semantic(self, query: str, top_k: int = 10, multiplier: int = 5, model: str | None = None, translate: bool | None = None) -> DataFrame:
        p = plan(self.translate(query, translate), "semantic")
        return self._semantic(p.sub_queries, top_k, candidate_k(top_k, multiplier), model) if p.events else self._none()

    def _none(self) -> DataFrame:
        return self.frames.where("false").withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))

    def temporal(self, query: str, top_k: int = 10, multiplier: int = 5, model: str | None = None, duration_limit: float | None = None, translate: bool | None = None) -> DataFrame:
        """Sequences over the candidates of all events, scored by each event's whole text."""
        p = plan(self.translate(query, translate), "temporal")
        if not p.events:
            return self._none()
        vectors, encode = self._chosen(model)
        wide = candidate_k(top_k, multiplier)
        pools = [self._semantic(e, wide, wide, model).select("vec_id") for e in p.events]
        pool = pools[0]
        for other in pools[1:]:
            pool = pool.union(other)
        whole = encode(self.spark.createDataFrame(list(enumerate(p.event_queries)), "query_id int, text string"))
        near = vectors.join(pool.distinct(), "vec_id", "left_semi").join(F.broadcast(whole))  # a row per event
        cells = near.select("vec_id", F.col("query_id").alias("event_idx"), F.round(vector.dot(F.col("vector"), F.col("embedding")), 6).alias("score")).join(self.frames.select("vec_id", "video_id", "ts"), "vec_id")
        matrix = temporal.score_matrix(cells.withColumnRenamed("vec_id", "keyframe_id"), len(p.events))
        return temporal.sequences(matrix, len(p.events), duration_limit, top_k=top_k)

    def ocr_search(self, query: str, top_k: int = 10, oversample: int = 3) -> DataFrame:
        if self.ocr is None:
            raise RuntimeError("screen text isn't indexed")
        postings, places = self._texts("ocr")
        hits = fulltext.search(postings, "doc", query, max(top_k * oversample, top_k)).join(places, "doc").drop("doc", "rank")
        meta = self.frames.select("vec_id", "dataset", "video_id", F.col("keyframe_id").cast("string").alias("keyframe_id"), "ts")
        return enrich.ocr_hits(hits, meta, "vec_id", top_k).withColumn("score", F.col("normalised_score"))

    def asr_search(self, query: str, top_k: int = 10, oversample: int = 3) -> DataFrame:
        if self.asr is None:
            raise RuntimeError("speech isn't indexed")
        postings, places = self._texts("asr")
        hits = fulltext.search(postings, "segment_id", query, max(top_k * oversample, top_k)).join(places, "segment_id")
        return enrich.asr_hits(hits, self.frames, "vec_id", top_k).withColumn("score", F.col("normalised_score"))

    def search(self, query: str, mode: str = "auto", top_k: int = 10, **options) -> tuple[QueryPlan, DataFrame]:
        p = plan(query, mode)
        run = {"semantic": self.semantic, "temporal": self.temporal, "ocr": self.ocr_search, "asr": self.asr_search}[p.mode]
        return p, run(query, top_k, **options)

    def _frames_of(self, df: DataFrame, source: str) -> DataFrame:
        """Any source's rows as frames ranked from 1: a speech segment gives its frames in order."""
        if source == "asr":
            rows = df.select("rank", "score", F.posexplode("frames").alias("pos", "vec_id"))
        else:
            rows = df.select("rank", "score", F.lit(0).alias("pos"), "vec_id")
        placed = rows.withColumn("rank", F.row_number().over(W.orderBy("rank", "pos")))  # the frames of at most top_k hits
        return placed.select("vec_id", "score", "rank").join(self.frames, "vec_id")

    def advanced(self, query: str, models: list[str], temporal_mode: bool = False, use_ocr: bool = False, use_asr: bool = False, top_k: int = 10, multiplier: int = 5, duration_limit: float | None = None, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
        """All chosen sources fused by rank: frames, or, temporally, one fused pool per event and sequences over it.

        Weights are by model name, "ocr" and "asr"; screen text and speech are
        asked with the untranslated query.
        """
        weights, wide = weights or {}, candidate_k(top_k, multiplier)
        said, raw = plan(self.translate(query), "semantic"), plan(query, "semantic")

        def lists(subs: list[str], text: str, text_k: int) -> list[tuple[DataFrame, str, float]]:
            out = [(self._frames_of(self._semantic(subs, top_k, wide, m), m), m, weights.get(m, 1.0)) for m in models]
            if use_ocr and self.ocr:
                out.append((self._frames_of(self.ocr_search(text, text_k), "ocr"), "ocr", weights.get("ocr", 1.0)))
            if use_asr and self.asr:
                out.append((self._frames_of(self.asr_search(text, text_k), "asr"), "asr", weights.get("asr", 1.0)))
            return out

        if not said.events:
            return self._none()
        if not temporal_mode:
            found = lists(said.sub_queries, raw.query, top_k)
            return fusion.fuse(found, k, top_k) if found else self._none()
        pools = []
        for i, event in enumerate(said.events):
            text = raw.events[i][0] if i < len(raw.events) else event[0]
            if found := lists(event, text, wide):
                pools.append(fusion.fuse(found, k, wide).select("video_id", "keyframe_id", "ts", F.lit(i).alias("event_idx"), "rrf_score"))
        if not pools:
            return self._none()
        whole = pools[0]
        for p in pools[1:]:
            whole = whole.union(p)
        return temporal.sequences(temporal.score_matrix(whole, len(said.events), "rrf_score"), len(said.events), duration_limit, top_k=top_k)
