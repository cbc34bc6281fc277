"""Pairs of words, counted in Arrow batches, against plain loops."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from framewright.operators import vocab

TEXTS = ["a b a  b", None, "", "A\tb\x0bA\r\nb\fa", " \t lone ", "b", "a b", "x\x1cy z\x85    w z\x85", "\x0b\x0b É È é è", "a b a b"]


def expected():
    counts = Counter()
    for t in TEXTS:
        words = re.findall(r"[^\x09-\x0d\x20]+", (t or "").lower())
        counts.update(zip(words, words[1:], strict=False))
    return counts


def test_bigrams_by_plain_loops(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    got = vocab.bigrams(docs, "doc_id", "text")
    # pairs aren't rows, nor gathered in a table, before they are dealt out
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan[plan.index("Exchange") :]
    rows = got.collect()
    assert {(r.w1, r.w2): r.n for r in rows} == expected() and len(rows) == len(expected()) and got.columns == ["w1", "w2", "n"]


@pytest.mark.parametrize("size, most, rows", [(1, 1, 1), (2, 40, 3), (10, 1 << 20, 2), (3, 1 << 20, 100)])
def test_pairs_of_batches(monkeypatch, size, most, rows):
    monkeypatch.setattr(vocab, "TEXTS", most)
    monkeypatch.setattr(vocab, "ROWS", rows)
    table = pa.table({"text": pa.array([t and t.lower() for t in TEXTS])})
    got = Counter()
    for batch in vocab._pairs(iter(table.to_batches(max_chunksize=size))):
        assert 0 < batch.num_rows <= rows
        for r in batch.to_pylist():
            got[tuple(r["pair"].split("\t"))] += r["n"]
    assert got == expected()
    assert list(vocab._pairs(iter([]))) == []
