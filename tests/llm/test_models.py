import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import pseudo_likelihood as P
from framewright.llm import quality_classifier as C
from framewright.llm import queries
from framewright.llm import token_counts as K
from framewright.llm import words as W


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no provided tables here")
    got = queries.op6_quality_classifier(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("place", F.lit(1)).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    w = C.train(docs, labels)
    got = {(r.doc_id, round(r.score, 9)) for r in C.score(docs, w).collect()}
    assert len(got) == 4
    assert not C.train(docs, labels.limit(0)).any() and C.score(docs.limit(0), w).count() == 0


def test_features_have_unit_length_and_count_repeats():
    buf, off = W.texts(__import__("pyarrow").array(["a b c a b c", "", "%%% x"]))
    row, index, value = C.features(buf, off)
    assert np.allclose(np.bincount(row, value**2), 1) and (index[row == 0] == 0).any() and not (index[row == 2] == 0).any()


def greedy(text, pieces):
    longest, n, words = max(map(len, pieces)), 0, (text or "").encode().split()
    for w in words:
        w, at, own = b" " + w, 0, 0
        while at < len(w):
            k = next((k for k in range(min(longest, len(w) - at), 0, -1) if w[at : at + k] in pieces), 0)
            if not k:
                own = 1
                break
            at, own = at + k, own + 1
        n += own
    return len(words), n


@pytest.mark.parametrize("pieces", [[b" a", b" ab", b"b", b"c", b"abc", b"bcb", b"cb", b" ", b"a"], [b" a", b"bc", b" abcb", b"c"]])
def test_longest_match(spark, tmp_path, pieces):
    import base64
    import random

    path = tmp_path / "p.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    rng = random.Random(1)
    texts = [None, "", " ", "d", "a" * 700] + [" ".join("".join(rng.choice("abcd"[: 3 + (i % 9 == 0)]) for _ in range(rng.randrange(1, 9))) for _ in range(12)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in K.token_counts(df, str(path)).collect()}
    assert got == {i: greedy(t, set(pieces)) for i, t in enumerate(texts)}
    assert K.token_counts(df.limit(0), str(path)).count() == 0


def test_public_vocabulary(spark, sf):
    if not os.path.exists(K.VOCABULARY):
        pytest.skip("no tokenizers here")
    pieces = set(K.load_pieces(K.VOCABULARY))
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(40).collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in K.token_counts(df).collect()} == {r.doc_id: greedy(r.text, pieces) for r in rows}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    texts = [" ".join(f"{'the' if rng.random() < 0.5 else 'a'} {rng.choice(nouns)} {rng.choice(verbs)} ." for _ in range(rng.integers(5, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "word"), (1002, "word")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("n_tokens", F.lit("x")).repartition(3).persist()


def hashed(text):
    buf, off = W.texts(__import__("pyarrow").array([text], "string"))
    starts, ends, _ = W.spans(buf, off, W.SPACED)
    return W.hashes(buf, starts, ends)


def windows(text):
    """(left, word, right) at each place of a text."""
    w = [None, *(text or "").lower().split(), None]
    return list(zip(w, w[1:], w[2:]))


def test_scores_are_the_sums_of_masked_predictions(spark, corpus):
    rare = [(2000 + i, f"the n1 odd{i // 2} v2 . a n{i % 3} odd{i // 4} v1 . odd{i // 2}") for i in range(12)] + [(3000, "odd0 " * 50), (3000, "odd0 " * 50)]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(rare, "doc_id long, text string"))
    rows = docs.collect()
    counts = collections.Counter(w for r in rows for w in (r.text or "").lower().split())
    model = P.train(docs)
    # all words of this corpus are tokens: some of them are made other words
    number = {int(h): w for w in counts for h in hashed(w)}
    assert not len(model.hashes)
    moved = np.isin(model.top_hashes, hashed(" ".join(w for w in counts if w.startswith(("odd", "v1")))))
    n = np.array([counts[number[int(h)]] for h in model.top_hashes[moved]])
    model.hashes, model.share, model.rare, model.rare_share = model.top_hashes[moved], np.log(n / n.sum()), np.ones(len(n), bool), 0.0
    model.top_hashes, model.top_tokens = model.top_hashes[~moved], model.top_tokens[~moved]
    net = P.Network(model.weights)
    among = collections.Counter()  # (window, word) and window, for each row and over all, of rare words
    own = []
    by_hash = {number[int(h)]: (int(t), 0.0, False) for h, t in zip(model.top_hashes, model.top_tokens)} | {number[int(h)]: (P.OTHER, float(s), True) for h, s in zip(model.hashes, model.share)}
    for r in rows:
        mine = collections.Counter()
        for x, w, y in windows(r.text):
            if by_hash[w][2]:
                mine[x, y] += 1
                mine[(x, y), w] += 1
        own.append(mine)
        among += mine
    got = {}
    for r in P.score(docs.repartition(5), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r, mine in zip(rows, own):
        if r.doc_id % 37 and r.doc_id < 1000:
            continue
        ids = [by_hash[w][0] for _, w, _ in windows(r.text)]
        expected = 0.0
        for p, (x, w, y) in enumerate(windows(r.text)):
            h = np.tanh(sum(net.inner[k][ids[p + d] if 0 <= p + d < len(ids) else P.EDGE].astype(float) for k, d in enumerate(P.WINDOW)))
            g, m = divmod(ids[p], P.MEMBERS)
            for z, at in [(h @ net.top + net.top_bias, g)] + ([(h @ net.outer[g] + net.bias[g], m)] if ids[p] < P.OTHER else []):
                expected += z[at] - np.log(np.exp(z).sum())
            _, share, is_rare = by_hash[w]
            if is_rare:
                k = (x, y)
                expected += np.log((among[k, w] - mine[k, w] + P.PRIOR * np.exp(share)) / (among[k] - mine[k] + P.PRIOR))
            else:
                expected += share
        for found in got[r.doc_id]:
            assert found.n_tokens == len(ids) and abs(found.log_likelihood - expected) < 1e-3 * max(1, len(ids))
    assert got[1000][0].log_likelihood == 0 and got[1000][0].mean_log_likelihood is None and len(got[3000]) == 2


def test_training_beats_frequencies(spark, corpus):
    model = P.train(corpus)
    assert model.counts.sum() == sum(len((r.text or "").split()) for r in corpus.collect())
    total = lambda: P.score(corpus, model).agg(F.sum("log_likelihood")).collect()[0][0]
    trained = total()
    model.weights = P.Network.fresh(model.counts).data
    assert trained > 0.95 * total()


def test_the_split_of_the_rows_does_not_count(spark, corpus, monkeypatch):
    monkeypatch.setattr(P, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(P, "MERGE", 2)
    a, b = P.train(corpus.repartition(2)), P.train(corpus.repartition(16))
    assert a.counts.sum() > 3 * 3000 and np.array_equal(a.weights, b.weights) and np.array_equal(a.top_hashes, b.top_hashes)
    assert not np.array_equal(a.weights, P.Network.fresh(a.counts).data)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    net = P.Network(rng.normal(0, 0.5, P._SIZE).astype(np.float32))
    around = np.repeat(rng.integers(0, P.EDGE + 1, (2, len(P.WINDOW))), P.OTHER + 1, axis=0)
    p = np.exp(net.log_probability(around, np.tile(np.arange(P.OTHER + 1), 2)))
    assert np.allclose(p.reshape(2, -1).sum(axis=1), 1, atol=1e-4)


def test_other_words_share_a_token(spark, monkeypatch):
    monkeypatch.setattr(P, "NAMED", 4500)
    monkeypatch.setattr(P, "RARE", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(5000) if i < 1 + (5000 - k) // 500)) for i in range(8)], "doc_id long, text string")
    model = P.vocabulary(docs)
    h = np.concatenate([hashed(f"w{k}") for k in range(5000)])
    token = model.tokens(h)
    share, rare = model.shares(h, token)
    assert len(model.hashes) + P.WORDS <= 4500 and np.bincount(token)[: P.WORDS].max() == 1 and rare.any() and not rare.all()
    assert abs(np.exp(share[token == P.OTHER]).sum() - 1) < 1e-4 and not share[token < P.OTHER].any()
    assert abs(np.exp(share[rare]).sum() - np.exp(model.rare_share)) < 1e-4


def test_rounds_together_take_every_position_once(monkeypatch):
    taken = []
    monkeypatch.setattr(P.Network, "train", lambda net, around, token, seen: taken.append((around.copy(), token.copy())))
    monkeypatch.setattr(P, "STEP_ROWS", 7)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in (1, 2, 5, 33, 1, 80)]
    streams = [np.concatenate([[P.EDGE] * 2, t]).astype(np.int32) for t in texts]
    weights = np.zeros(P._SIZE, np.float32)
    seen = {}
    for cut in (1, 2, 6):
        taken.clear()
        total = 0
        for turn in range(P.ROUNDS):
            learner = P.Learner(weights, turn)
            for a in range(0, len(streams), cut):
                learner.add(streams[a : a + cut])
            learner.add([], last=True)
            total += learner.total
        assert total == sum(map(len, texts))
        seen[cut] = [(a.tolist(), t.tolist()) for a, t in taken]
    assert seen[1] == seen[2] == seen[6]
    expected = []
    for t in texts:
        padded = [P.EDGE] * 2 + t.tolist() + [P.EDGE] * 2
        expected += [([padded[i + 2 + d] for d in P.WINDOW], padded[i + 2]) for i in range(len(t))]
    assert sorted((w, t) for a, b in seen[1] for w, t in zip(a, b)) == sorted(expected)


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(4)
    net, want = P.Network.fresh(np.ones(P.OTHER + 1)), P.Network.fresh(np.ones(P.OTHER + 1))
    around, token = rng.integers(0, P.EDGE + 1, (50, len(P.WINDOW))), rng.integers(0, P.WORDS, 50)
    around[:9], token[:9], token[9:12] = around[0], token[0], P.OTHER
    net.train(around, token, P.Network(np.full(P._SIZE, 1e-3, np.float32)))
    grads = P.Network(np.zeros(P._SIZE))
    for w, t in zip(around, token):
        h = np.tanh(sum(want.inner[k][w[k]].astype(float) for k in range(len(P.WINDOW))))
        g, m = divmod(int(t), P.MEMBERS)
        back = np.zeros(P.UNITS)
        levels = [(want.top, want.top_bias, g, grads.top, grads.top_bias)]
        if t < P.OTHER:
            levels.append((want.outer[g], want.bias[g], m, grads.outer[g], grads.bias[g]))
        for matrix, bias, at, dm, db in levels:
            e = np.exp(h @ matrix.astype(float) + bias)
            e /= e.sum()
            e[at] -= 1
            e /= 50
            dm += np.outer(h, e)
            db += e
            back += matrix @ e
        for k in range(len(P.WINDOW)):
            grads.inner[k][w[k]] += back * (1 - h * h)
    assert np.allclose(net.data, want.data - P.RATE * grads.data / (np.sqrt(1e-3 + grads.data**2) + 1e-6), atol=1e-5)


def test_untrained_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = P.train(empty)
    assert len(model.top_hashes) == len(model.hashes) == 0 and P.score(empty, model).count() == 0
    assert P.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()[0].n_tokens == 2
    long = spark.createDataFrame([(1, "so long " * 60_000), (2, None)], "doc_id long, text string")
    assert {r.n_tokens for r in P.score(long, P.train(long)).collect()} == {0, 120_000}
