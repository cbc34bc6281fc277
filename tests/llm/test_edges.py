"""Very long texts, ties at the bounds of samples, and the classifier against a plain loop."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, mixing, near_dedup, secrets, warc
from framewright.llm import pseudo_likelihood as P
from framewright.llm import quality_classifier as C
from framewright.llm import words as W


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(90_000)}" for _ in range(150_000))
    rows = [(1, text), (2, text + " one more"), (3, "short text"), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).persist()


def test_long_texts_near_dedup(long):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(long, 2, 80).collect()}
    assert got[1][0] > 140_000 and got[1][1] == got[2][1] == 1 and got[3] == (1, 3) and got[4] == (0, 4) and got[5] == (0, 5)


def test_long_texts_mixing(long):
    got = {r.doc_id: r for r in mixing.mix(long).collect()}
    assert got[1].size == 150_000 and got[2].size == 150_002 and got[4].size == 0 and sum(r.taken for r in got.values()) == pytest.approx(got[1].target, rel=0.01)


def test_long_texts_decontamination(spark, long):
    text = long.where("doc_id = 1").collect()[0].text.split()
    items = spark.createDataFrame([(7, " ".join(text[149_000:149_012]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(long, items).collect()}
    assert got[1].n_words == 150_000 and got[1].n_hit == 12 and got[2].contaminated and not got[3].contaminated
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(long, items).collect()}
    assert len(clean[1].split()) == 150_000 - 12


def test_long_texts_warc(spark, long):
    got = warc.archived(long.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"))).collect()
    assert max(r.payload_bytes for r in got) > 800_000 and len(got) == 5


def test_long_texts_classifier_and_secrets(spark, long):
    assert C.score(long, np.zeros(1 << C.BITS, np.float32)).where("score = 0.5").count() == 5
    hidden = long.withColumn("text", F.concat("text", F.lit(" password=Xk29fa7Q!z end")))
    assert secrets.redact(hidden.where("doc_id = 1")).where("text like '%password=[SECRET] end'").count() == 1


def tokens(text):
    """Runs of letters, digits and anything beyond ASCII, and runs of other visible characters."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\x20\x09-\x0d]+", low)


def gram(words, n):
    one = lambda b: W.hashes(b, np.array([0]), np.array([len(b)]))
    h = np.concatenate([one(W.texts(pa.array([w]))[0]) for w in words])
    return int(W.grams(h, np.array([0, len(h)]), n)[0][0])


def features(text):
    """Feature -> value, by a loop over the text's words."""
    w, counts, seen = tokens(text), {C._CONSTANT: 1}, set()
    for n in (1, 2, 3):
        # fewer words than n are one gram, which for two words and three isn't repeated
        grams = [w[i : i + n] for i in range(len(w) - n + 1)] or ([w] if w else [])
        for g in grams:
            if n < 3:
                k = max(gram(g, n) >> (64 - C.BITS), 2)
                counts[k] = counts.get(k, 0) + 1
            else:
                if tuple(g) in seen:
                    counts[C._REPEATED] = counts.get(C._REPEATED, 0) + 1
                seen.add(tuple(g))
    length = math.sqrt(sum(v * v for v in counts.values()))
    return {k: v / length for k, v in counts.items()}


TEXTS = ["a b c a b c a b c", "", "Éa %% x-y\tz", "one", "one two", "THE the The", "!!! ???"]


def test_features_of_the_classifier():
    buf, off = W.texts(pa.array(TEXTS))
    row, index, value = C.features(buf, off)
    for r, text in enumerate(TEXTS):
        got = dict(zip(index[row == r].tolist(), value[row == r].tolist()))
        want = features(text)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want), text


def test_learner_follows_the_leader():
    rng = random.Random(2)
    learner, z, n = C.Learner(), {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= C.L1 else (math.copysign(C.L1, z[k]) - z[k]) / ((C.BETA + math.sqrt(n[k])) / C.ALPHA + C.L2)
    for _ in range(200):
        x = {rng.randrange(40): rng.random() for _ in range(6)}
        label = float(rng.random() < 0.3 + 0.4 * (0 in x))
        learner.learn(np.array(list(x)), np.array(list(x.values())), label)
        own = {k: weight(k) for k in x}
        p = 1 / (1 + math.exp(-sum(own[k] * v for k, v in x.items())))
        for k, v in x.items():
            g = (p - label) * v
            z[k] = z.get(k, 0) + g - (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / C.ALPHA * own[k]
            n[k] = n.get(k, 0) + g * g
    assert all(abs(learner.weights()[k] - weight(k)) < 1e-9 for k in z)


def test_ties_at_the_bound_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 6)
    docs = spark.createDataFrame([(i // 2, f"text {i} words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    a, b = C.train(docs.repartition(3), labels.repartition(5)), C.train(docs, labels)
    assert a.any() and np.array_equal(a, b)


def test_ties_at_the_bound_of_the_vocabulary(spark):
    # 6,000 words of equal counts: which are tokens is decided by their hashes
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i * 600, i * 600 + 600))) for i in range(10)], "doc_id long, text string")
    a, b = P.vocabulary(docs), P.vocabulary(docs.repartition(7))
    assert len(a.top_hashes) == P.WORDS and np.array_equal(a.top_hashes, b.top_hashes) and np.array_equal(a.hashes, b.hashes) and len(a.hashes) == 6000 - P.WORDS
