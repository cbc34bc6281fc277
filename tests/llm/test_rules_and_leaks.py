import collections
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import decontaminate, quality_rules

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w = SPACED.findall(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(lines), len(covered)


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a a a a", "é#|\n\né#|\n x\x0by", "w " * 40_000, " ".join(f"r{rng.randrange(40)}" for _ in range(5000)), " ".join(f"r{rng.randrange(9)}" for _ in range(900))]
    texts += ["".join(rng.choice("ab \n\t#é|") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [" ".join(f"p{i}" for i in range(300)) + " " + " ".join(f"p{i}" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("failures", F.lit("x")).withColumn("m", F.lit(0))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.ledger(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}
    assert quality_rules.passing(df).columns == df.columns
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(df), "v2").where("kept").collect()}
    assert {r.doc_id for r in quality_rules.passing(df).collect()} == kept
    assert quality_rules.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    rows = [(i, f) for i, f in enumerate([0, 0, 1, 3, 2, 4, 8, 12, 6])]
    ledger = spark.createDataFrame(rows, "doc_id long, failures long")
    for name, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask(rules)
        assert quality_rules.apply_policy(ledger, name).where("kept").count() == sum(not f & mask for _, f in rows)
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.mask(quality_rules.POLICIES[r.policy]), 1 << quality_rules.RULES.index(r.rule)
        assert (r.fails, r.fails_alone, r.kept_without) == (sum(bool(f & bit) for _, f in rows), sum(f & mask == bit for _, f in rows), sum(not f & mask & ~bit for _, f in rows))


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(t):
    return ALNUM.findall((t or "").translate(LOWER))


def leaks(text, items, window):
    w, hit, names = split(text), set(), set()
    for name, t in items:
        seq = split(t)
        n = min(len(seq), window)
        for k in range(len(seq) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == seq[k : k + n]:
                    hit.update(range(p, p + n))
                    names.add("null" if name is None else str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=25), st.integers(1, 4))
def test_automaton(items, doc, window):
    named = [(str(i), decontaminate.split_words(" ".join(x))) for i, x in enumerate(items)]
    machine = decontaminate.Automaton(named, window)
    expected = leaks(" ".join(doc), [(i, " ".join(x)) for i, x in enumerate(items)], window)
    import numpy as np

    data = " ".join(doc).encode()
    *_, rows = machine.batch(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    found, names = rows.get(0, ([], set()))
    covered = set().union(*(range(a, b) for a, b in found)) if found else set()
    assert (len(covered), len(names)) == expected[1:3]


@pytest.mark.parametrize("most", [200_000, 12])
def test_report_and_removal(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", most)
    rng = random.Random(2)
    word = lambda: rng.choice(["Sí", "la", "los", "x1", "Öl", "the"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 6, 9])))) for i in range(8)] + [(None, "q w e r t y"), (8, None), (3, "q q q q")]
    items = [x for x in items if len(split(x[1])) not in (1, 2)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (62, "--- ..."), (63, "start Q, w! E r\nt y end"), (64, "q w e r t y"), (65, "q w e q w e r t y r t y z z z z z z z z")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("n_chars", F.length("text").cast("long"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.report(d, b, window=5).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == leaks(t, items, 5) and r.contaminated == (r.n_hit > 0)
    clean = decontaminate.decontaminate(d, b, window=5, coverage=0.8)
    assert clean.columns == d.columns
    left = {r.doc_id: r for r in clean.collect()}
    for i, t in docs:
        n, hit, *_ = leaks(t, items, 5)
        assert (i in left) == (not n or hit <= 0.8 * n)
        if i in left and not hit:
            assert left[i].text == t
        if i in left:
            assert leaks(left[i].text, items, 5)[1] == 0
            assert left[i].text is None or left[i].n_chars == len(left[i].text)
    assert left[63].text == "start  end"


def test_blocks_clean_as_one_automaton(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"{'abcd'[i]}{k}" for k in range(14))) for i in range(4)]
    part = lambda i, a, b: " ".join(f"{'abcd'[i]}{k}" for k in range(a, b))
    other = lambda n: " ".join(f"z{rng.randrange(99)}" for _ in range(n))
    docs = [
        (1, f"{part(0, 0, 14)} {part(1, 0, 10)} {other(4)}"),  # 24 of 28 hit, 14 by the first block
        (2, f"{part(0, 0, 5)} {part(1, 0, 5)} {part(2, 0, 14)} {part(1, 5, 14)} {part(0, 5, 14)} {other(40)}"),  # windows of earlier blocks formed by later cuts
        (3, f"{other(9)} {part(3, 2, 13)} {other(9)}"), (4, None), (5, ""), (6, other(30)), (6, other(30)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ranges", F.lit("mine"))
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    key = lambda r: (r.doc_id, r.text or "")
    clean = lambda: sorted(decontaminate.decontaminate(d, b, window=5, coverage=0.8).collect(), key=key)
    one = clean()
    assert len(list(decontaminate.automata(b, 5))) == 1
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 14)
    assert len(list(decontaminate.automata(b, 5))) == 4
    assert clean() == one
    assert {r.doc_id for r in one} == {2, 3, 4, 5, 6} and all(leaks(r.text, items, 5)[1] == 0 for r in one)


def test_no_items_and_no_documents(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(d, b).collect()[0].n_hit == 0 and decontaminate.report(d.limit(0), b).count() == 0
