"""Toxicity: held-out documents, window by window against single compressions, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import toxicity as X

WORDS = [a + b + c for a in ("an", "ber", "col", "du") for b in ("ta", "vi", "ron", "le") for c in ("st", "ng", "m", "per")]
BAD = ["grobian", "nitwitted", "blockhead"]


def corpus(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 80))]
        for _ in range(toxic * rng.randrange(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice([str.upper, str])(rng.choice(BAD)))
        yield i, " ".join(words) + ".", toxic


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(list(corpus(1, 500)), "doc_id long, text string, toxic int").persist()
    return X.train(rows.select("doc_id", "text", F.lit("x").alias("label")), rows.select("doc_id", "toxic"))


def test_finds_toxic_documents(spark, model):
    other = spark.createDataFrame(list(corpus(2, 300)), "doc_id long, text string, toxic int")
    got = X.score(other, model).join(other, "doc_id").collect()
    right = np.mean([(r.score >= X.THRESHOLD) == (r.toxic == 1) for r in got])
    assert len(got) == 300 and right >= 0.98


def test_savings_are_those_of_single_compressions(model):
    text = pa.array(["A Nitwitted" + " berlest" * 3 + " " + "w" * 300, None, "", "é blockhead!"])
    buf, starts, ends, first = X.windows(text)
    assert (ends - starts).max() <= X.WINDOW_BYTES and first.tolist() == [0, 10, 10, 10, 12]
    saved = X.Remembered(model.pair)(buf, starts, ends)
    single = [X._compressor(d) for d in (model.pair.ordinary, model.pair.toxic)]
    for s, e, have in zip(starts, ends, saved, strict=True):
        a, b = (len(c.compress(b" " + buf[s:e].tobytes() + b" " + X.TAIL)) for c in single)
        assert a - b == have
    assert saved[1] >= X.REFINED and saved[-1] >= X.REFINED and saved[2] < X.REFINED


def test_memory_of_windows_changes_nothing(model, monkeypatch):
    text = pa.array([t for _, t, _ in corpus(3, 40)])
    buf, starts, ends, _ = X.windows(text)
    known = X.Remembered(model.pair)
    once, again = known(buf, starts, ends), known(buf, starts, ends)
    monkeypatch.setattr(X, "REMEMBERED", 5)
    assert (once == again).all() and (once == X.Remembered(model.pair)(buf, starts, ends)).all()


def test_odd_rows(spark, model):
    long = " ".join(WORDS * 3000) + " grobian grobian grobian"
    rows = [(1, None), (2, ""), (3, " .. "), (4, long), (5, "grobian blockhead you"), (5, "grobian blockhead you"), (None, "x")]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(7)), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].score == by[2].score == by[3].score < X.THRESHOLD and by[1].n_windows == 0
    assert by[5].score >= X.THRESHOLD and by[4].n_windows == len(WORDS) * 3000 + 3 and all(0 <= r.score <= 1 for r in got)
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, None), (None, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert X.train(docs, labels) is None
    assert [r.score for r in X.score(docs, None).collect()] == [0.0, 0.0]
