import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import near_dedup
from framewright.llm.components import components


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        out.setdefault(i, []).append(frozenset(s))
    return out


def brute(rows, n, percent=80):
    """Component of each doc_id by comparing all pairs of sets."""
    own = sets_of([r for r in rows if r[0] is not None], n)
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in own[a] for y in own[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def family(rng, size, start, words=60, most=9):
    """An original and copies with a few words changed; copies of copies as well."""
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = [(start, " ".join(base))]
    for k in range(1, size):
        w = (base if rng.random() < 0.7 else out[rng.randrange(len(out))][1].split())[:]
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("n", [2, 5])
def test_groups_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [r for f in range(6) for r in family(rng, 25, 1000 * f, 80)] + [(9000 + i, " ".join(f"u{rng.randrange(200)}" for _ in range(30))) for i in range(60)]
    rows += [(9500, "one"), (9501, "ONE"), (9502, "a b"), (9503, "A  b\n"), (9504, ""), (9505, None), (9506, " \t"), (9507, "One two three four"), (9508, "one two three four")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in near_dedup.near_groups(frame(spark, rows), n).collect()}
    expected, own = brute(rows, n), sets_of(rows, n)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.n_shingles == len(own[i][0]) and r.kept == (expected[i] == i) for i, r in got.items())


def test_repeated_ids_null_ids_and_other_columns(spark):
    text = " ".join(f"k{i}" for i in range(40))
    other = " ".join(f"m{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, other), (3, other + " z"), (7, text), (None, text), (None, None)]
    df = frame(spark, rows).withColumn("kept", F.lit("x")).withColumn("vid", F.lit(1)).withColumn("component_id", F.lit(2))
    got = near_dedup.near_groups(df, 2).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got) == sorted([(False, 5, 3, False)] * 3 + [(False, 3, 3, True), (False, 7, 3, False), (True, 0, None, True), (True, 0, None, True)], key=lambda x: (x[0], x[1]))
    stay = near_dedup.deduplicated(df, 2)
    assert stay.columns == df.columns and sorted((r.doc_id or 0, r.kept) for r in stay.collect()) == [(0, "x"), (0, "x"), (3, "x")]


def test_repeated_rows_of_a_kept_document_stay_once(spark):
    df = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words in here now")])
    assert sorted(r.doc_id for r in near_dedup.deduplicated(df).collect()) == [1, 2]


def test_empty_table(spark):
    assert near_dedup.near_groups(frame(spark, []), 2).count() == 0
    assert near_dedup.deduplicated(frame(spark, [])).count() == 0


def test_threshold_is_exact(spark):
    """Single-word sequences make sets of known size: 8 of 10 is linked, 79 of 100 isn't."""
    words = [f"t{i}" for i in range(200)]
    eight = [(1, " ".join(words[:10])), (2, " ".join(words[:9]))]  # 8 of 9 pairs
    seventy_nine = [(3, " ".join(words[100:190])), (4, " ".join(words[100:172]))]  # 71 of 89 pairs
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, eight + seventy_nine), 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    with pytest.raises(ValueError):
        near_dedup.near_groups(frame(spark, eight), 2, 70)


def test_bit_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            common, rest = int(400 * j), 400 - int(400 * j)
            x = rng.integers(1, 1 << 62, common + rest, dtype=np.uint64)
            a, b = x[: common + rest // 2], np.concatenate([x[:common], x[common + rest // 2 :]])
            m = near_dedup.packed(near_dedup.minima(np.concatenate([a, b]), np.array([0, len(a)]))).view(np.uint64)
            differ = sum(int(((m[0, i] ^ m[1, i]) | (m[0, i + 3] ^ m[1, i + 3])).bit_count()) for i in range(3))
            errors.append(near_dedup.similarity(differ) - j)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.18


def test_components_of_chains_and_stars(spark):
    ids = np.random.default_rng(1).permutation(10**6)[:400].tolist()
    edges = [(ids[i], ids[i + 1]) for i in range(100)] + [(ids[200], x) for x in ids[201:300]] + [(ids[300], ids[300])]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[x] for x in ids[:101]}) == 1 and len({got[x] for x in ids[200:300]}) == 1 and len(set(got.values())) == 2 and ids[300] not in got
