"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of other visible characters;
features are hashed word uni- and bigrams, one that counts repeated trigrams and
a constant.  A document is its vector of counts at unit length; its score is the
logistic of a sparse dot product, computed for a slice of documents at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import small_batches

#: Bits of the feature hash; labelled rows learnt from at most (by order of a hash of doc_id); passes over them.
BITS, SAMPLE, PASSES = 18, 8_000, 2
#: The learner's step, smoothing, and penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.7

_REPEATED, _CONSTANT = 0, 1
_SYMBOL = W.SPACED & ~W.ALNUM


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every non-zero feature of the texts, ordered by row."""
    n = len(off) - 1
    parts = [W.spans(buf, off, kind)[:2] for kind in (W.ALNUM, _SYMBOL)]
    starts = np.concatenate([p[0] for p in parts])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([p[1] for p in parts])[order]
    first = np.searchsorted(starts, off)
    h = W.hashes(buf, starts, ends)
    keys = [np.arange(n, dtype=np.int64) << BITS | _CONSTANT]
    for size in (1, 2, 3):
        g, at = W.grams(h, first, size)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
        if size < 3:
            index = np.maximum((g >> np.uint64(64 - BITS)).astype(np.int64), 2)
            keys.append(row << BITS | index)
        else:
            order = np.lexsort((g, row))
            again = np.zeros(len(g), bool)
            again[1:] = (g[order][1:] == g[order][:-1]) & (row[order][1:] == row[order][:-1])
            keys.append(row[order][again] << BITS | _REPEATED)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row, value = key >> BITS, count.astype(np.float64)
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, key & ((1 << BITS) - 1), value / norm[row]


class Learner:
    """Per-coordinate follow-the-regularised-leader on single examples."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g


def _featurise(batches):
    for batch in batches:
        buf, off = W.texts(batch.column("text"))
        for a, b in W.slices(off):
            row, index, value = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("place"), part.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))],
                names=["place", "label", "i", "x"],
            )


def _learn(batches):
    examples = []
    for batch in batches:
        for label, i, x in zip(batch.column("label").to_pylist(), batch.column("i"), batch.column("x"), strict=True):
            examples.append((float(label), np.asarray(i.values), np.asarray(x.values, np.float64)))
    learner = Learner()
    for _ in range(PASSES):
        for label, i, x in examples:
            learner.learn(i, x, label)
    if examples:
        yield pa.RecordBatch.from_arrays([pa.array([learner.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from at most SAMPLE labelled documents, those of the smallest hashes of doc_id, in that order.

    ``labels`` is ``(doc_id, quality)``; rows with nulls are left out; no labels
    give weights of 0.  Of rows of one doc_id the smallest text counts, so that
    SAMPLE bounds what is learnt; texts of any length are learnt whole.
    """
    small_batches(docs.sparkSession)
    place = F.xxhash64(F.lit(3), "doc_id")
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = known.withColumn("place", place).orderBy("place", "doc_id", "label").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id", "label").agg(F.min("text").alias("text")).select("place", "label", "text")
    rows = texts.mapInArrow(W.released(_featurise), "place long, label double, i array<int>, x array<float>")
    got = rows.repartition(1).sortWithinPartitions("place", "label", "i").mapInArrow(W.released(_learn), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(1 << BITS, np.float32)


def _scorer(shared):
    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            buf, off = W.texts(batch.column(1))
            for a, b in W.slices(off):
                row, index, value = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                s = np.bincount(row, w[index] * value, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, text)`` -> doc_id and score, the probability of quality 1.

    Null and empty texts have the constant alone; texts of any length are read
    whole.  Repeated rows get equal
    scores, other columns are ignored, no rows give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(W.released(_scorer(shared)), rows.select("doc_id", F.lit(0.0).alias("score")).schema)


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from training: the remainder of crc32 of its id as text by 4 is 2 (null: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
