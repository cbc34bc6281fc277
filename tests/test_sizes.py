"""Steps that must stay small on large tables: their results against plain loops, and how many rows they keep."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.operators import fulltext, vocab


def _kept(monkeypatch, module, rows):
    real = module.stored

    def stored(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(module, "stored", stored)


@pytest.mark.parametrize("counted", [True, False])
def test_replacements_keep_few_places(spark, monkeypatch, counted):
    places = [(f"b{i % 97}", "teh" if i % 3 else "form", f"a{i % 89}") for i in range(3000)] + [("in", "teh", "end"), (None, "form", "of"), ("in", "form", None), ("on", "form", "of"), ("up", "teh", None)]
    table = Counter((x, y) for b, t, a in places for x, y in ((b, t), (t, a)) if x and y) if counted else Counter({("in", "form"): 1})
    table.update({("in", "the"): 40, ("the", "end"): 5, ("from", "of"): 31, ("in", "from"): 9, ("the", "a7"): 3, ("for", "of"): 31, ("up", "the"): 16})
    candidates = [("teh", "the"), ("form", "from"), ("form", "for"), ("teh", "ten")]

    def evidence(b, t, a):
        return table.get((b, t), 0) + table.get((t, a), 0)

    want = set()
    for b, t, a in set(places):
        own = evidence(b, t, a)
        n, w = min((-evidence(b, w, a), w) for x, w in candidates if x == t)
        if -n >= 8 and -n >= (own + 1) * 2.5:
            want.add((b, t, a, w, -n, own))
    rows = {}
    _kept(monkeypatch, vocab, rows)
    got = vocab.replacements(spark.createDataFrame(places, "before string, token string, after string"), spark.createDataFrame(candidates, "token string, word string"), spark.createDataFrame([(*k, n) for k, n in table.items()], "w1 string, w2 string, n long"), 8, 2.5, counted)
    assert {tuple(r) for r in got.collect()} == want and len(want) >= 3
    # of the distinct places hardly more than those with a stronger word on a side are shuffled and counted
    assert rows["places"] <= 60 and rows["words"] <= 60


def test_postings_take_no_shuffle(spark):
    docs = {1: "b a b", 2: "A b-a, c a", 3: "", 4: None, 5: "..."}
    want = set()
    for k, text in docs.items():
        words = fulltext.terms_of(text or "")
        for t in set(words):
            places = tuple(i for i, w in enumerate(words) if w == t)
            want.add((k, t, len(places), places, len(words)))
    index = fulltext.postings(spark.createDataFrame(list(docs.items()), "id int, text string"), "id", "text")
    assert {(r.id, r.term, r.tf, tuple(r.positions), r.dl) for r in index.collect()} == want
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    lists = spark.createDataFrame([(1, ["x y", None, "y"])], "id int, text array<string>")
    assert {(r.term, tuple(r.positions)) for r in fulltext.postings(lists, "id", "text").collect()} == {("x", (0,)), ("y", (1, 2 + 2 * fulltext.GAP))}


def test_postings_are_made_of_slices_of_words(spark, monkeypatch):
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "a"), (5, "c c a b")], "id int, text string")
    made = fulltext.postings(docs, "id", "text")
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    words = [["b", "a", "b"], None, [], ["a"], ["c", "c", "a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5], pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["id", "words"])
    want = {tuple(map(str, r)) for r in made.select("id", "term", "tf", "positions", "dl").collect()}
    for most in (1, 3, 5, 100):
        monkeypatch.setattr(fulltext, "WORDS", most)
        out = list(fulltext._grouped(iter([batch])))
        assert {tuple(map(str, r.values())) for b in out for r in b.to_pylist()} == want and len(want) == 6
        assert len(out) > 1 or most > 8


def test_only_rows_with_all_terms_are_passed(spark):
    """A row without a term has no match; its plan asks for that before it merges occurrences."""
    rows = spark.createDataFrame([([1, 5], None), ([1, 5], [2]), (None, [2])], "p0 array<int>, p1 array<int>")
    spread = rows.select(fulltext.spreads(["x", "y"]).alias("w"))
    got = [r.w for r in spread.collect()]
    assert got[0] == got[2] == [] and got[1][0] == 0
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("isnull(p") < plan.index("aggregate(")


def test_deletions_are_made_once(spark):
    def left(word, n):
        return {word} | ({x for i in range(len(word)) for x in left(word[:i] + word[i + 1 :], n - 1)} if n else set())

    words = ["", "a", "ab", "aab", "banana", "năng"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", vocab.deletions(F.col("w"), 2).alias("two"), vocab.deletions(F.col("w"), 1).alias("one")).collect()
    for r in rows:
        assert set(r.two) == left(r.w, 2) and len(r.two) == len(set(r.two)) and set(r.one) == left(r.w, 1)


def test_the_resolver_reads_its_tokens_once(spark, monkeypatch):
    rows = {}
    _kept(monkeypatch, vocab, rows)
    tokens = spark.createDataFrame([("helo",), ("helo",), ("20/07",)], "token string")
    words = spark.createDataFrame([("hello", 4)], "token string, df long")
    got = {r.token: (r.corrected, r.source) for r in vocab.resolved(tokens, words, words.where("false")).collect()}
    assert got == {"helo": ("hello", "dict_suggest"), "20/07": ("20/07", "regex")} and rows["tokens"] == rows["looked_up"] == 2
