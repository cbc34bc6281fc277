"""Toxicity by compression distance: two zstandard dictionaries, of toxic and of ordinary text, and the lengths they compress windows to.

A window is a word with a blank on either side.  The ordinary dictionary is
trained on the commonest windows of ordinary documents, the toxic one on windows
that toxic documents have far more often than chance; the latter also ends in the
former's content, so that ordinary words cost the same under both and a window's
difference is what toxic text alone explains.  Windows that a dictionary should
compress but doesn't are appended to its content, and ordinary windows that only
the toxic one compresses to the ordinary one's, for a few rounds.

A document's features are how many of its windows save 2, 3, ... bytes or more;
a logistic regression on other labelled documents calibrates them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.quality_classifier import held_out
from framewright.llm.store import small_batches, stored

#: Labelled documents learnt from at most (by order of a hash of doc_id), and of four how many calibrate.
SAMPLE, CALIBRATE = 16_000, 1
#: Least log-likelihood of a window in toxic documents against chance; windows of each dictionary at most; rounds of refinement.
LIKELIHOOD, MOST_WINDOWS, ROUNDS = 10.0, 20_000, 3
#: Bytes of the dictionaries' trained contents, and the trainer's segment and step (both in bytes).
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, STEP = 110_000, 32_768, 24, 8
LEVEL, WINDOW_BYTES = 19, 64
#: Savings in bytes that are counted; the one that refinement goes by; penalty of the regression.
SAVINGS, REFINED, RIDGE = (2, 3, 4, 5, 6), 3, 1.0
THRESHOLD = 0.3
#: Known savings of windows that a worker remembers at most; bytes of text handled at once.
REMEMBERED, SLICE = 1_000_000, 2 << 20

#: Stands after every window and at the end of every dictionary: matches that begin in a block's last bytes aren't looked for.
TAIL = b"<a window of words ends here>"
#: Before it in a dictionary, so that no window matches together with the tail.
_BREAK = b"\x00\x01\x00\x01"


def windows(column: pa.Array):
    """Bytes, starts, ends of the words of lower-cased texts (words over WINDOW_BYTES in pieces), and each row's first."""
    buf, off = W.texts(pc.utf8_lower(column))
    starts, ends, first = W.spans(buf, off, W.ALNUM)
    pieces = -(-(ends - starts) // WINDOW_BYTES)
    if len(pieces) and pieces.max() > 1:
        at = np.concatenate([[0], np.cumsum(pieces)])
        number = np.arange(at[-1]) - np.repeat(at[:-1], pieces)
        begin = np.repeat(starts, pieces) + number * WINDOW_BYTES
        starts, ends, first = begin, np.minimum(begin + WINDOW_BYTES, np.repeat(ends, pieces)), at[first]
    return buf, starts, ends, first


def _contents(dictionary: bytes) -> tuple[bytes, bytes]:
    """A trained dictionary's tables, up to the three offsets that end them, and its content."""
    end = dictionary.index(struct.pack("<III", 1, 4, 8)) + 12
    return dictionary[:end], dictionary[end:]


def _trained(samples: dict[bytes, int], size: int) -> tuple[bytes, bytes]:
    """Tables and content of a dictionary trained on windows, each as often as documents have it (50 times at most), in a fixed shuffled order."""
    every = [b" " + w + b" " for w, n in samples.items() for _ in range(min(n, 50))]
    order = np.random.default_rng(7).permutation(len(every))
    try:
        return _contents(zstandard.train_dictionary(size, [every[i] for i in order], k=SEGMENT, d=STEP).as_bytes())
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b"", b"".join(dict.fromkeys(every))[:size]


@dataclass
class Pair:
    """The two dictionaries, as bytes that can be shipped."""

    ordinary: bytes
    toxic: bytes

    def savings(self):
        """A function from windows (bytes, starts, ends) to the bytes that the toxic dictionary saves on each."""
        both = [_compressor(d) for d in (self.ordinary, self.toxic)]

        def lengths(one, data: bytes, segments: bytes, n: int) -> np.ndarray:
            out = one.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
            return np.fromiter((len(x) for x in out), np.int64, n)

        def run(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            if not len(starts):
                return np.zeros(0, np.int64)
            size = ends - starts
            whole = size + 2 + len(TAIL)
            off = np.cumsum(whole) - whole
            data = np.full(int(whole.sum()), 0x20, np.uint8)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            data[np.repeat(off + 1, size) + inner] = buf[np.repeat(starts, size) + inner]
            data[(off + size + 2)[:, None] + np.arange(len(TAIL))] = np.frombuffer(TAIL, np.uint8)
            segments = np.column_stack([off, whole]).astype(np.uint64).tobytes()
            a, b = (lengths(one, data.tobytes(), segments, len(size)) for one in both)
            return a - b

        return run


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_RAWCONTENT
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(dictionary), source_size=40, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


def fitted(counts: list[tuple[bytes, int, int]], toxic_docs: int, ordinary_docs: int) -> Pair:
    """Dictionaries from ``(window, toxic documents, ordinary documents)`` of a bounded sample."""
    words = [w for w, _, _ in counts]
    toxic, ordinary = (np.array([c[i] for c in counts], np.float64) for i in (1, 2))
    chance = toxic_docs * (ordinary + 1) / max(ordinary_docs, 1)
    likelihood = np.where(toxic > chance, toxic * np.log(np.maximum(toxic, 1e-9) / chance) - (toxic - chance), 0.0)
    marked = likelihood >= LIKELIHOOD
    best = lambda score, of: [i for i in np.lexsort((np.arange(len(words)), -score)) if of[i]][:MOST_WINDOWS]
    tables, base = _trained({words[i]: int(ordinary[i]) for i in best(ordinary, ordinary > 1)}, ORDINARY_BYTES)
    _, own = _trained({words[i]: int(toxic[i]) for i in best(likelihood, marked)}, TOXIC_BYTES)
    more: tuple[dict, dict] = ({}, {})

    def pair() -> Pair:
        first = base + b"".join(more[0])
        return Pair(tables + first + _BREAK + TAIL, tables + first + own + b"".join(more[1]) + _BREAK + TAIL)

    sizes = np.array([len(w) for w in words], np.int64)
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
    for _ in range(ROUNDS if marked.any() else 0):
        saved = pair().savings()(buf, ends - sizes, ends)
        for have, rank, wrong in ((more[0], ordinary, ~marked & (saved >= REFINED) & (ordinary > 1)), (more[1], likelihood, marked & (saved < REFINED))):
            have.update({b" " + words[i] + b" ": None for i in best(rank, wrong)[: max(0, MOST_WINDOWS - len(have))]})
    return pair()


def _distinct(batches):
    """Each document's different windows: window, and the document's label."""
    for batch in batches:
        buf, starts, ends, first = windows(batch.column("text"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        h = W.hashes(buf, starts, ends, lower=False)
        with np.errstate(over="ignore"):
            at = np.unique(W.mix(h + W.mix(row.astype(np.uint64) * W.SALTS[3])), return_index=True)[1]
        label = batch.column("label").to_numpy(zero_copy_only=False)[row[at]]
        for a in range(0, len(at), 50_000):
            some = at[a : a + 50_000]
            found = [buf[s:e].tobytes() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(label[a : a + 50_000])], names=["window", "label"])


def _fit(toxic_docs: int, ordinary_docs: int):
    def run(batches):
        counts = [c for b in batches for c in zip(*(b.column(k).to_pylist() for k in ("window", "toxic", "ordinary")), strict=True)]
        pair = fitted(counts, toxic_docs, ordinary_docs)
        yield pa.RecordBatch.from_arrays([pa.array([pair.ordinary], pa.binary()), pa.array([pair.toxic], pa.binary())], names=["ordinary", "toxic"])

    return run


class Remembered:
    """Savings of windows by their hashes, of which so many are kept."""

    def __init__(self, pair: Pair):
        self._of = pair.savings()
        self._hash, self._saved = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code, h = pd.factorize(W.hashes(buf, starts, ends, lower=False))
        at = np.zeros(len(h), np.int64)
        at[code[::-1]] = np.arange(len(starts))[::-1]
        place = np.minimum(np.searchsorted(self._hash, h), max(len(self._hash) - 1, 0))
        known = self._hash[place] == h if len(self._hash) else np.zeros(len(h), bool)
        saved = np.zeros(len(h), np.int8)
        saved[known] = self._saved[place[known]]
        new = np.flatnonzero(~known)
        saved[new] = np.clip(self._of(buf, starts[at[new]], ends[at[new]]), -100, 100)
        if len(self._hash) + len(new) <= REMEMBERED:
            every = np.concatenate([self._hash, h[new]])
            order = np.argsort(every, kind="stable")
            self._hash, self._saved = every[order], np.concatenate([self._saved, saved[new]])[order]
        return saved[code]


def _counted(shared):
    """Arrow batches with a text -> the other columns, n_windows, and how many windows save so many bytes or more."""

    def run(batches):
        saved_of = Remembered(shared.value)
        for batch in batches:
            text = batch.column("text")
            off = W.texts(text)[1]
            for a, b in W.slices(off, SLICE):
                buf, starts, ends, first = windows(text.slice(a, b - a))
                saved = saved_of(buf, starts, ends)
                above = [np.concatenate([[0], np.cumsum(saved >= s)]) for s in SAVINGS]
                counts = [c[first[1:]] - c[first[:-1]] for c in above]
                part = batch.slice(a, b - a).drop_columns(["text"])
                arrays = [*part.columns, pa.array(np.diff(first)), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "n_windows", *(f"s{s}" for s in SAVINGS)])

    return run


def features(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A constant, the logarithms of the counts, and of the counts per 100 windows."""
    share = counts / np.maximum(n, 1)[:, None]
    return np.column_stack([np.ones(len(n)), np.log1p(counts), np.log1p(100 * share)])


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, all but the constant's penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    pair: Pair
    weights: np.ndarray


def _sums(df: DataFrame, shared) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.mapInArrow(W.released(_counted(shared)), f"{kinds}, n_windows long, " + ", ".join(f"s{s} long" for s in SAVINGS))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from at most SAMPLE labelled documents, those of the smallest hashes of doc_id; a quarter of them calibrate.

    ``labels`` is ``(doc_id, toxic)``; rows with nulls are left out.  Of rows of
    one doc_id the smallest text counts.  None if the documents to learn from or
    those to calibrate with lack a class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = known.withColumn("place", F.xxhash64(F.lit(12), "doc_id")).orderBy("place", "doc_id", "label").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id", "label").agg(F.min("text").alias("text"))
    texts = stored(texts.withColumn("calibrates", F.pmod(F.xxhash64("place"), F.lit(4)) < CALIBRATE), "labelled")
    n = {(r.calibrates, r.label): r["count"] for r in texts.groupBy("calibrates", "label").count().collect()}
    if not all(n.get(k) for k in ((False, 0), (False, 1), (True, 0), (True, 1))):
        return None
    each = texts.where("not calibrates").select("text", "label").mapInArrow(W.released(_distinct), "window binary, label int")
    counts = each.groupBy("window").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")).where("toxic + ordinary > 1")
    rows = counts.repartition(1).sortWithinPartitions("window")  # windows of a bounded sample
    got = rows.mapInArrow(W.released(_fit(n[False, 1], n[False, 0])), "ordinary binary, toxic binary").collect()
    pair = Pair(bytes(got[0].ordinary), bytes(got[0].toxic))
    shared = spark.sparkContext.broadcast(pair)
    seen = _sums(texts.where("calibrates").select("place", "label", "text"), shared).orderBy("place", "label").toPandas()
    shared.destroy()
    x = features(seen["n_windows"].to_numpy(), seen[[f"s{s}" for s in SAVINGS]].to_numpy(np.float64))
    return Model(pair, calibrated(x, seen["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, score (the probability of being toxic) and n_windows.

    Null and empty texts, and all texts without a word, have no windows and the
    score of a text that saves nothing.  Texts of any length are read whole, words
    of any length in pieces of WINDOW_BYTES.  Repeated rows get equal scores,
    other columns are ignored, no rows give no rows.  Without a model every score
    is 0.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_windows"))
    counted = _sums(rows, docs.sparkSession.sparkContext.broadcast(model.pair))
    each = [F.log1p(f"s{s}") for s in SAVINGS] + [F.log1p(F.lit(100.0) * F.col(f"s{s}") / F.greatest("n_windows", F.lit(1))) for s in SAVINGS]
    total = F.lit(float(model.weights[0]))
    for w, x in zip(model.weights[1:], each, strict=True):
        total = total + F.lit(float(w)) * x
    return counted.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"), "n_windows")


__all__ = ["THRESHOLD", "Model", "Pair", "held_out", "score", "train"]
