"""Collocations and vector codes against plain loops, and the defined results of odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import collocations as C
from framewright.llm import vector_codes as V


def plain_phrases(rows, least, top):
    """(lang, text) -> the rows of the contract, by counting every phrase."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, count[lang, p[:k]], count[lang, p[k:]])
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for lang in {x[0] for x in found}:
        own = {p: v for (at, p), v in found.items() if at == lang}
        kept = [p for p in own if not any(len(q) > len(p) and inside(p, q) and 100 * own[q][1] >= 80 * own[p][1] for q in own)]
        kept.sort(key=lambda p: (-own[p][0], -own[p][1], " ".join(p).encode()))
        out += [(lang, i + 1, " ".join(p), own[p][1], own[p][2], own[p][3], total[lang], own[p][0]) for i, p in enumerate(kept[:top])]
    return sorted(out)


def drawn(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "é", "x\x00y", "ß", "\U0001f600", "of", "no-one", "\x1c", "(", "the)"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "!", " :", "\r\n"]
    for _ in range(n):
        yield rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize(("seed", "group", "shard"), [(1, 50_000, 1 << 20), (2, 7, 300), (3, 200, 1)])
def test_phrases_as_by_counting(spark, monkeypatch, seed, group, shard):
    monkeypatch.setattr(C, "GROUP", group)
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    rows = [*drawn(seed, 150), ("en", None), (None, None), ("de", ""), ("xx", " .;, "), ("en", "the of " * 3000)]
    rows += [("en", "twice the same row")] * 20
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, least=5, top=40).collect())
    assert got == plain_phrases(rows, 5, 40)
    assert any(" " in r[2] and len(r[2].split(" ")) == 4 for r in got)


def test_no_phrase_crosses_pieces_or_rows(spark):
    rows = [("en", "one two")] * 40 + [("en", "three. four")] * 40
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("one two", 40, 40, 40, 160, 1_000_000)]


def test_empty_and_rare(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "just once here"), ("en", None)], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 1 << 60
    every = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big - 1, 1), ("en", "a b", big - 2, 2)], "lang string, phrase string, n long, words int")
    assert [r.score for r in C.scored(every).collect()] == [2_000_000 * (big - 2) // (2 * big - 1)]


def test_full_filters_only_cost_time(spark, monkeypatch):
    """A filter that lets everything through gives the same phrases."""
    monkeypatch.setattr(C, "MOST_FILTER_BITS", 1)
    rows = list(drawn(5, 150))
    got = sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5, top=40).collect())
    assert got == plain_phrases(rows, 5, 40)


def plain_codes(rows):
    """(vec_id, label, vector) -> vec_id -> (code, error, label_error), and the digest."""
    usable = lambda v: v is not None and len(v) > 0 and len(v) % 4 == 0 and all(c is not None and math.isfinite(c) and abs(c) < V.LIMIT for c in v)
    kept = sorted([r for r in rows if usable(r[2])], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // 4
    parts = [[[math.floor(1024 * c) for c in r[2][p * width : (p + 1) * width]] for r in kept] for p in range(4)]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    books, found = [own[:256] for own in parts], []
    for p in range(4):
        for k in range(5):
            at = [min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e)) for x in parts[p]]
            if k < 4:
                books[p] = [[sum(v) // len(v) for v in zip(*own, strict=True)] if (own := [x for x, i in zip(parts[p], at, strict=True) if i == e]) else b for e, b in enumerate(books[p])]
        found.append([(e, distance(x, books[p][e])) for x, e in zip(parts[p], at, strict=True)])
    code = ["".join(f"{found[p][i][0]:02x}" for p in range(4)) for i in range(len(kept))]
    error = [sum(found[p][i][1] for p in range(4)) for i in range(len(kept))]
    of_label = Counter()
    for r, e in zip(kept, error, strict=True):
        of_label[r[1]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0] if r[0] is not None else -1, c, e, of_label[r[1]]) for r, c, e in zip(kept, code, error, strict=True)), digest


@pytest.mark.parametrize(("n", "width", "spread"), [(700, 8, 1.0), (300, 12, 0.002), (20, 4, 50_000.0)])
def test_codes_as_by_plain_loops(spark, n, width, spread):
    rng = random.Random(n)
    rows = [(i * 3 % n, rng.choice([0, 1, None]), [rng.gauss(0, spread / 4) for _ in range(width)]) for i in range(n)]
    rows += [(n + 1, 0, None), (n + 2, 0, [0.0] * (width - 1) + [None]), (n + 3, 0, [math.nan] * width), (n + 4, 1, [math.inf] * width), (n + 5, 1, []), (n + 6, 1, [0.5] * (width + 4)), (n + 7, 1, [1e30] * width)]
    rows += [rows[0]] * 3 + [(None, None, rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("x")).repartition(3)
    got = V.encode(df).collect()
    expected, digest = plain_codes(rows)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == expected
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_equal_vectors_and_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert V.encode(spark.createDataFrame([], kind)).count() == 0
    assert V.encode(spark.createDataFrame([(1, 1, [0.1, 0.2])], kind)).count() == 0
    same = V.encode(spark.createDataFrame([(i, None, [0.25, -0.25, 0.0, 1.0]) for i in range(600)], kind)).collect()
    assert {(r.code, r.error, r.label_error) for r in same} == {("00000000", 0, 0)} and len(same) == 600


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 128, (3000, 16))).astype(np.int64)
    cells = V.Cells(x[:256])
    exact = ((x[:, None] - x[None, :256]) ** 2).sum(axis=2)
    least, most = cells.bounds(x)
    assert (least <= exact).all() and (exact <= most).all()
    assert (least <= most.min(axis=1, keepdims=True)).mean() < 0.2  # of 256 entries few are compared
    entry, distance = cells.nearest(x)
    assert (entry == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
