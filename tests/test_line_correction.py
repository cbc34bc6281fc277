"""Correction of lines: results by hand, and that only words that may change leave their lines."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from framewright.functions import text as T
from framewright.operators import lines as L
from framewright.operators import vocab


@pytest.mark.parametrize("counted", [True, False])
def test_only_words_that_may_change_leave_their_lines(spark, monkeypatch, counted):
    lines = [(1, "the nha (big) thee"), (2, "big cat 037 GNT"), (3, "  Bá\tNá samsung"), (4, ""), (5, None), (6, "big cat"), (6, "the thee"), (7, "thee nha"), (8, "Nha THE"), (None, "thee"), *[(k, "the big car") for k in range(100, 600)]]
    words = [("nha", 9), ("nhà", 9), ("the", 9), ("big", 9), ("cat", 9), ("car", 9)]
    table = Counter({("the", "nhà"): 40, ("big", "car"): 400})
    for _, text in lines:
        w = (text or "").lower().split()
        table.update(zip(w, w[1:], strict=False))
    rows, real = {}, vocab.stored

    def stored(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(vocab, "stored", stored)
    frame = spark.createDataFrame(lines, "id int, line string").repartition(3)
    dictionary, none = spark.createDataFrame(words, "token string, df long"), spark.createDataFrame([], "token string, df long")
    got = vocab.corrected_lines(frame, "id", "line", dictionary, none, spark.createDataFrame([(*k, n) for k, n in table.items()], "w1 string, w2 string, n long"), counted)
    assert got.columns == ["id", "corrected", "flags"]
    result = {r.id: (r.corrected, r.flags) for r in got.collect()}
    assert {k: v for k, v in result.items() if k is None or k < 100} == {
        1: ("the nhà big the", 0), 2: ("big cat 037 GNT", 1), 3: ("Bà Nà samsung", 0), 4: ("", 0), 5: ("", 0), 6: ("big the cat the", 1), 7: ("the nha", 0), 8: ("Nha THE", 0), None: ("the", 0),
    }
    assert len(result) == 509 and all(result[k] == ("the big car", 0) for k in range(100, 600))
    # 1,500 words of the copies stay where they are
    assert rows.pop("spelt") == len(lines) and max(rows.values()) <= 120


def test_lines_are_split_as_by_spark(spark):
    texts = ["a  b", "\ta\x0bb\x0c", "", "   ", "x\x1cy z\x85 w", "é  É\r\n", "   a"]
    want = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.words("t").alias("w")).orderBy("i").collect()]
    each, counts = L.words(pa.array(texts))
    ends = np.cumsum(counts)
    assert [each[e - n : e].to_pylist() for e, n in zip(ends, counts, strict=True)] == want


def test_protected_lines_are_found():
    held = ["Bà Nà", "đi ba\tnà về", "BÁ  NẠ", "SamSung", "x\tApple", "37\x0bVTV\x0b", "\x0bsony\x0b", "cần\x0bthơ", "37 GNT", "٣ ABCD", "bà rịa - vũng tàu", "CẦN THƠ", "K honda", "x y lÂm đồng"]
    for line in [*held, "samsungs", "37 GNTAB", "ba", "na ba", "37GNT", "the cat", ""]:
        found = pc.match_substring_regex(pa.array([line]), T.MAY_BE_PROTECTED)[0].as_py()
        assert found >= any(T.protect(line.split())) and found >= (line in held)
    assert T.protect(["Bá", "Ná", "37", "GNT", "x"]) == ["Bà", "Nà", "", "GNT", ""]
    batch = pa.RecordBatch.from_pydict({"text": ["x", "đi Bá Ná", "the 37 cats"]})
    assert next(L.with_kept(iter([batch])))["kept"].to_pylist() == [None, ["", "Bà", "Nà"], None]


@pytest.mark.parametrize("edits", [1, 2])
def test_hashes_of_shortened_words(monkeypatch, edits):
    def left(word, n):
        return {word} | ({x for i in range(len(word)) for x in left(word[:i] + word[i + 1 :], n - 1)} if n else set())

    words = ["", "a", "ab", "ba", "aab", "banana", "năng", "nặng", "b😀b", "bandana"]
    batch = pa.RecordBatch.from_pydict({"token": words})
    got = {r["word"]: r["left_over"] for b in vocab._shortened(edits)(iter([batch])) for r in b.to_pylist()}
    assert set(got) == set(words)
    names = {}
    for w in words:
        assert len(got[w]) == len(set(got[w])) == len(left(w, edits))
        for other in words:
            assert len(set(got[w]) & set(got[other])) == len(left(w, edits) & left(other, edits))
        names[w] = sorted(got[w])
    monkeypatch.setattr(vocab, "HASHES", 1)
    assert {r["word"]: sorted(r["left_over"]) for b in vocab._shortened(edits)(iter([batch])) for r in b.to_pylist()} == names
    bits = np.zeros(vocab.CELLS, np.uint64)
    for h in got["banana"]:
        bits[h & (vocab.CELLS - 1)] |= np.uint64(1) << np.uint64((h >> vocab.CELL_BITS) & 63)
    some = {r["word"]: sorted(r["left_over"]) for b in vocab._shortened(edits, SimpleNamespace(value=bits))(iter([batch])) for r in b.to_pylist()}
    assert some == {w: sorted(set(got[w]) & set(got["banana"])) for w in words}


def test_the_best_suggestion_is_the_first(spark):
    words = spark.createDataFrame([("hello", 4), ("help", 9), ("hell", 9), ("yellow", 1), ("held", 9), ("shell", 2), ("", 5)], "token string, df long")
    tokens = spark.createDataFrame([(t,) for t in ("helo", "elow", "helo", "hell", "zzzz", "shel", "")], "token string")
    best = {(r.token, r.word) for r in vocab.best_suggestions(tokens, words).collect()}
    assert best == {(r.token, r.word) for r in vocab.suggestions(tokens, words).where("k = 1").collect()} and ("helo", "held") in best


@pytest.mark.parametrize("few", [64, 2])
def test_units_of_words_by_plain_loops(spark, monkeypatch, few):
    monkeypatch.setattr(vocab, "FEW", few)
    docs = [(1, "a b A"), (1, "b c"), (None, "a"), (None, "a d"), (2, None), (3, "  "), (3, "c\td a")]
    want = Counter(w for _, w in {(u, w) for u, t in docs for w in (t or "").lower().split()})
    for kind in ("int", "string"):
        frame = spark.createDataFrame([(u if u is None or kind == "int" else str(u), t) for u, t in docs], f"u {kind}, t string").repartition(3)
        assert {r.token: r.df for r in vocab.document_frequency(frame, "u", "t").collect()} == want
    assert vocab.document_frequency(frame.where("false"), "u", "t").count() == 0


def test_bigrams_of_some_words(spark):
    texts = ["a b a  b c", None, "", "c d e b", "d e d e", "E b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    every = {(r.w1, r.w2): r.n for r in vocab.bigrams(docs, "doc_id", "text").collect()}
    some = {(r.w1, r.w2): r.n for r in vocab.bigrams(docs, "doc_id", "text", spark.createDataFrame([("b",), ("zz",)], "token string")).collect()}
    assert some == {k: n for k, n in every.items() if "b" in k} and 0 < len(some) < len(every)
