import random

from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import decontaminate, mixing, quality_rules, secrets

from .test_near_dedup import brute, family
from .test_rules_and_leaks import leaks, measures
from .test_secrets_and_mixing import shared


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    good = [(i, " ".join(f"g{rng.randrange(5000)}" for _ in range(90))) for i in range(120)]
    item = " ".join(f"bench{i}" for i in range(14))
    token = "0b9b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = good + [r for f in range(3) for r in family(rng, 8, 1000 + 100 * f, 120)]
    rows += [(2000, good[3][1].replace(" ", "  ").upper()), (2001, "few words"), (2002, "a b c " * 40), (2003, " ".join(f"s{i}###" for i in range(80)))]
    rows += [(2004, f"{good[5][1][:300]} {item} {good[6][1][:300]}"), (2005, f'{good[7][1][::-1]} token = "{token}" end'), (2006, None), (2007, ""), (None, good[9][1][::-1]), (2008, good[11][1][::-1]), (2008, good[11][1][::-1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if (i or 1) % 9 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("kept", F.lit("mine")).withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            columns = columns or now.columns
            assert now.columns == columns == [*docs.columns, "kept", "label"]
        tables.append(now.collect())
    rules, single, clean, masked, mix = tables
    passes = lambda t: (lambda m: not (m[0] < 50 or 2 * m[5] > m[0] or 10 * m[2] > 3 * m[0] or 2 * m[3] > m[4]))(measures(t))
    key = lambda x: (-1 if x[0] is None else x[0], x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in rules), key=key) == sorted((x for x in rows if passes(x[1])), key=key)
    groups = brute([(r.doc_id, r.text) for r in rules], 5)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in single) == sorted({i for i, c in groups.items() if i == c} | {-1})
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} and all(leaks(r.text, [(0, item)], 10)[1] == 0 for r in clean)
    assert all(a.text == b.text for a, b in zip(sorted(single, key=key), sorted(clean, key=key), strict=True) if not leaks(a.text, [(0, item)], 10)[1])
    assert not any(token in r.text for r in masked) and sum("[SECRET]" in r.text for r in masked) == 1 and len(masked) == len(clean)
    sizes = {}
    for r in masked:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    expected = shared(sizes)
    assert len(mix) == len(masked) and all(r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size for r in mix)
    for s in sizes:
        assert abs(sum(r.taken for r in mix if r.source == s) - expected[s]) <= 0.03 * expected[s]


def test_run_on_the_provided_tables(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and {"doc_id", "source", "size", "target", "taken"} <= set(got.columns)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_policies_are_those_of_the_stages():
    assert quality_rules.mask(quality_rules.POLICIES["v2"]) == 63 and mixing.MOST_TIMES == 3 and secrets.MASK and decontaminate.MOST_WORDS
