"""Versions of stored indexes: removals, replacements, writes that die, compaction."""

import numpy as np
import pytest

from framewright.operators import fulltext
from framewright.sources import sinks


def same_as_anew(index, docs, query="w3 fox"):
    """The index's search and counts are those of an index of these documents alone."""
    fresh = fulltext.search(fulltext.postings(docs, "id", "text"), "id", query, 10)
    assert [tuple(r) for r in index.search(query, 10).collect()] == [tuple(r) for r in fresh.collect()]
    assert index.count() == docs.count() == index.documents().count()


def test_removed_and_replaced_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} and w{i % 5} fox" + " old" * (i % 3)) for i in range(60)], "id int, text string")
    index = sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text")
    index.create(docs.where("id < 40"))
    index.insert(docs)
    assert index.remove(docs.where("id % 4 = 0")) == 15 and index.remove(docs.where("id % 4 = 0")) == 0
    same_as_anew(index, docs.where("id % 4 <> 0"))
    # a term of removed documents alone is gone
    assert index.terms(["ol"]).collect()[0].df == docs.where("id % 4 <> 0 and text like '%old%'").count()
    changed = docs.where("id in (1, 8, 50)").selectExpr("id", "concat('new w3 ', text) as text")
    index.bulk(changed, docs.where("id = 2"))
    live = docs.where("id % 4 <> 0 and id not in (1, 2, 50)").union(changed)
    same_as_anew(index, live)
    same_as_anew(index, live, "new fox")
    version = index.manifest()["version"]
    index.compact()
    assert index.manifest()["version"] == version + 1 and len(index.manifest()["segments"]) == 1
    same_as_anew(index, live, "new fox")
    assert len(index.vacuum()) == 5 and index.vacuum() == []
    same_as_anew(sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text"), live)


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    """No copy of a segment's postings is stored before it; texts without words aren't counted, and a segment may have no rows."""
    names = []
    stored = sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda rows, name: names.append(name) or stored(rows, name))
    docs = spark.createDataFrame([(1, "red fox"), (2, None), (3, "..."), (4, "fox fox"), (5, "")], "id int, text string")
    index = sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text")
    index.create(docs.where("id < 4"))
    index.insert(docs)
    index.bulk(docs.where("id = 3"))
    assert "postings" not in names
    assert sorted(tuple(r) for r in index.documents().select("id", "dl").collect()) == [(1, 2), (4, 2)] and index.count() == 2
    assert sorted((r.id, r.term, r.tf, list(r.positions)) for r in index.postings().collect()) == [(1, "fox", 1, [1]), (1, "red", 1, [0]), (4, "fox", 2, [0, 1])]
    same_as_anew(index, docs.where("id in (1, 4)"), "red fox")


def test_a_write_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} fox") for i in range(30)], "id int, text string")
    index = sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text")
    index.create(docs.where("id < 20"))

    def dies(*_):
        raise OSError("no more")

    for write in (lambda: index.insert(docs), lambda: index.remove(docs.where("id = 3")), lambda: index.bulk(docs), lambda: index.compact(), lambda: index.create(docs)):
        with monkeypatch.context() as m:
            m.setattr(sinks.FullTextIndex, "_commit", dies)
            with pytest.raises(OSError, match="no more"):
                write()
        same_as_anew(index, docs.where("id < 20"))
    index.insert(docs)
    same_as_anew(index, docs)
    assert index.vacuum()


def test_two_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a fox"), (2, "b fox")], "id int, text string")
    index = sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text")
    index.create(docs)
    before = index.manifest()
    index.remove(docs.where("id = 1"))
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(before, before["segments"])
    same_as_anew(index, docs.where("id = 2"))


def test_vectors_removed_and_written_again(spark, tmp_path):
    r = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(100)], "vec_id long, embedding array<float>")
    index = sinks.VectorIndex(spark, str(tmp_path / "v"), 4)
    index.create(v.where("vec_id < 80"))
    ids = lambda: sorted(x.vec_id for x in index.table().collect())
    assert index.remove(v.where("vec_id % 3 = 0")) == 27 and ids() == [i for i in range(80) if i % 3]
    index.insert(v.where("vec_id % 6 = 0"))
    live = sorted({i for i in range(80) if i % 3} | {i for i in range(100) if i % 6 == 0})
    assert ids() == live
    index.compact()
    assert ids() == live and len(index.vacuum()) == 3 and index.centers().shape == (4, 8)


def test_large_buckets_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.FullTextIndex, "FILE_ROWS", 10)
    monkeypatch.setattr(sinks.FullTextIndex, "BUCKETS", 4)
    docs = spark.createDataFrame([(i, "one fox") for i in range(300)], "id int, text string")
    index = sinks.FullTextIndex(spark, str(tmp_path / "ix"), "id", "text")
    index.create(docs)
    assert len(index.postings(["fox"]).inputFiles()) >= 5 and index.postings(["fox"]).count() == 300


def test_cells_grow_with_the_vectors(spark, tmp_path):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(1100)], "vec_id long, embedding array<float>")
    index = sinks.VectorIndex(spark, str(tmp_path / "v"))
    index.create(v)
    assert len(index.centers()) == 33 and index.table().select("cell").distinct().count() > 20 and index.count() == 1100
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    best = {(x.query_id, x.vec_id) for x in index.search(q, 5).collect()}
    near = {(x.query_id, x.vec_id) for x in index.search(q, 5, probes=8).collect()}
    assert len(best & near) >= 0.9 * len(best)
