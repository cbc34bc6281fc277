"""A task's search keeps k rows a query, however many slices its vectors are cut into."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from framewright.operators import vector


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("probed", [False, True])
def test_a_task_gives_k_rows_a_query(monkeypatch, metric, probed):
    rng = np.random.default_rng(5)
    queries, vectors = rng.integers(-3, 4, (7, 4)).astype(float), rng.integers(-3, 4, (90, 4)).astype(np.float32)
    ids, cells = rng.permutation(90), rng.integers(0, 3, 90)
    probes = rng.random((7, 3)) < 0.6 if probed else None
    monkeypatch.setattr(vector, "SCORES", 7 * 11)
    batches = []
    for a in range(0, 90, 25):
        b = slice(a, a + 25)
        columns = [pa.array(ids[b]), pa.array(list(vectors[b]), pa.list_(pa.float32())), pa.array(cells[b])]
        batches.append(pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "cell"]))
    out = list(vector._searcher(SimpleNamespace(value=(queries, probes)), 5, metric)(iter(batches)))
    got = sorted((r["q"], -r["score"], r["vec_id"]) for b in out for r in b.to_pylist())
    want = []
    for i, q in enumerate(queries):
        score = vectors @ q if metric == "cosine" else -((vectors - q) ** 2).sum(1)
        seen = [j for j in range(90) if probes is None or probes[i, cells[j]]]
        want += [(i, *x) for x in sorted((-float(score[j]), int(ids[j])) for j in seen)[:5]]
    assert got == want
