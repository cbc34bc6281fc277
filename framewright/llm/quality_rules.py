"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document, inside its row, from measurements of
the whole text; the result is the measurements and one integer whose bit k is
set if rule k fails.  Policies are named masks over those bits, so that a change
of policy, and the ablation of each rule, costs bitwise operations on the ledger
and no second look at any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, and the symbols counted by n_symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule names by bit. The first two are the base rules.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")

#: Versions of the policy: the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": RULES,
}


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _repeated(words: Column, n: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows are compared by 64-bit hashes within one text: for a text of a
    million words, some two of them clash with a probability of 3e-8.
    """
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        """A window covers 3 words, less what the one before covered; places ascend."""
        return F.aggregate(places, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")), lambda acc: acc["n"])

    def searched(windows: Column, twice: Column) -> Column:
        hits = F.transform(windows, lambda w, i: F.when(F.array_contains(twice, w), i))
        return covered(F.filter(hits, lambda i: i.isNotNull()))

    def merged(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["w"] == e["w"], F.lit(False))
        hits = _let(placed, lambda s: F.transform(s, lambda e, i: F.when(same(s, e, i - 1) | same(s, e, i + 1), e["i"])))
        return covered(F.sort_array(F.filter(hits, lambda i: i.isNotNull())))

    def counted(windows: Column) -> Column:
        twice = _let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        # few windows occur twice: look each up in their list; else sort all with their places
        return _let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 64, searched(windows, d)).otherwise(merged(windows)))

    return _let(windows, counted)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _measures(text: Column) -> Column:
    """The measurements of a text as a struct of longs; null counts as empty."""

    def of(t: Column, words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        values = {
            "n_words": n,
            "word_chars": F.length(F.translate(t, SPACE, "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_lines": F.size(lines),
            "n_repeat_words": _repeated(words, n),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    words = lambda t: F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: of(t, w)))


def _failures(m: Column) -> Column:
    """The bits of the rules that measurements m fail."""
    fails = (
        m["n_words"] < 50,
        100 * m["n_repeat_words"] > 50 * m["n_words"],
        10 * m["n_symbols"] > 3 * m["n_words"],
        100 * m["n_dup_lines"] > 50 * m["n_lines"],
        m["word_chars"] < 2 * m["n_words"],
        m["word_chars"] > 20 * m["n_words"],
    )
    bits = F.lit(0).cast("long")
    for k, failed in enumerate(fails):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, the measurements (long) and ``failures``, the bits of the rules the document fails.

    Nulls, empty and blank texts have measurements of 0 and fail the rule on few
    words; the ratios of an empty text fail nothing.  Repeated rows get equal
    rows, columns but doc_id and text are ignored, no rows give no rows.
    """
    kept = _let(_measures(F.col("text")), lambda m: F.struct(m.alias("m"), _failures(m).alias("failures")))
    return docs.select("doc_id", kept.alias("kept")).select("doc_id", "kept.m.*", "kept.failures")


def apply_policy(ledger: DataFrame, version: str) -> DataFrame:
    """kept: no rule of that version of the policy fails."""
    return ledger.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents that fail it, that fail nothing else, and that the policy keeps without it.

    The ledger is first counted by failure bits, which are at most 2^rules rows.
    """
    spark = ledger.sparkSession
    counts = ledger.groupBy("failures").agg(F.count("*").alias("n"))
    cases = spark.createDataFrame([(v, r, mask(rules), 1 << RULES.index(r)) for v, rules in POLICIES.items() for r in rules], "policy string, rule string, mask long, bit long")
    failing = F.col("failures").bitwiseAND(F.col("mask"))
    n = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    of = counts.join(F.broadcast(cases))  # at most 2^rules rows by a fixed list
    return of.groupBy("policy", "rule").agg(n(failing.bitwiseAND(F.col("bit")) != 0, "fails"), n(failing == F.col("bit"), "fails_alone"), n(failing.bitwiseOR(F.col("bit")) == F.col("bit"), "kept_without"))


def passing(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns: nulls, empty and blank texts go as having few words, repeated rows stay or go alike."""
    failures = _let(_measures(F.col("text")), _failures)
    return docs.where(failures.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)
