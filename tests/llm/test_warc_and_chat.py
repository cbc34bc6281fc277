import base64
import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import chat_views, store, warc


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([iter(sorted(r)) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


ROWS = [
    (4, "http://b.Example.com/x", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b.example.com/x", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (9, None, None), (7, "no scheme", ""), (1, "https://a.org?q=1", "big " * 50_000),
    (11, "http://a.org/\r\nnext", "x"), (12, "http://a.org/", "x"), (12, "http://a.org/", "x"), (None, "http://z.org/", "only"), (None, "http://z.org/", "x"),
]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("record_type", F.lit("mine")).withColumn("first", F.lit(0)).withColumn("sha1", F.lit(""))
    got = warc.archived(df.repartition(3), least).collect()
    payload = lambda h: (h or "").encode()
    expected = []
    for i, _, h in ROWS:
        same = [j for j, _, g in ROWS if payload(g) == payload(h) and j is not None]
        first = min(same) if same and len(payload(h)) >= least else None
        again = first is not None and i != first
        expected.append((i, len(payload(h)), base64.b32encode(hashlib.sha1(payload(h)).digest()).decode(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected, key=key)
    order = [(r.urlkey, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)
    assert warc.archived(df.limit(0)).count() == 0


def test_records_are_fetched_by_the_index(spark, monkeypatch):
    path = store.new_path(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, path)
    local = path.removeprefix("file://")
    rows = warc.index(spark, path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        with open(f"{local}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            head, block = warc.parsed(gzip.decompress(f.read(r.length)))
        assert warc.capture(head, block)[0] == r.page_id and head["WARC-Type"] == r.record_type
        if r.record_type == "response":
            assert block.partition(b"\r\n\r\n")[2] in {(h or "").encode() for i, _, h in ROWS if i == r.page_id}
    whole = gzip.open(f"{local}/{rows[0].archive}").read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(ROWS)
    with pytest.raises(ValueError):
        warc.capture(head | {"WARC-Type": "response"}, block + b"!")
    assert warc.url_key("HTTP://www.A.b/P?q") == "b,a,www)/p?q" and warc.url_key(None) == ""


def test_archives_are_bounded(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
    monkeypatch.setattr(warc, "RECORDS", 7)
    monkeypatch.setattr(warc.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    rng = random.Random(1)
    records = [rng.randbytes(rng.choice([10, 100, 3_000])) for _ in range(200)]
    batch = pa.record_batch([pa.array(records, pa.binary())], names=["record"])
    sizes = {}
    for out in warc._packer([batch.slice(0, 90), batch.slice(90)]):
        for name, member in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            sizes.setdefault(name, []).append(member)
    assert [gzip.decompress(m) for name in sorted(sizes) for m in sizes[name]] == records
    assert all(len(m) <= 7 and sum(map(len, m[:-1])) < 5_000 for m in sizes.values()) and len(sizes) > 20
    data = warc.EMPTY_MEMBER.join(gzip.compress(r) for r in records) + warc.EMPTY_MEMBER
    assert [(data[a : a + n], c) for a, n, c in warc.members(data)] == [(data[a : a + n], gzip.decompress(data[a : a + n])) for a, n, _ in warc.members(data)] and [c for *_, c in warc.members(data)] == records
    with pytest.raises(ValueError):
        list(warc.members(data[:-25]))


def test_payloads_of_many_rows_are_joined_alike(spark, monkeypatch):
    rows = [(i, f"u{i}", "hot" if i % 3 else f"cold {i // 9}") for i in range(90)] + [(100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = lambda: sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    one = found()
    monkeypatch.setattr(warc, "MOST_BROADCAST", 3)
    assert found() == one and sum(t == "revisit" for _, t, _ in one) == 59 + 20


def test_base32(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)], "t string").select("t", warc.base32(F.sha1(F.col("t").cast("binary"))).alias("b"))
    assert all(r.b == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in df.collect())


def test_views(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "zoe", None]), rng.choice(["hi", "", None, "ça va\n"])) for c in [1, 2, None] for t in range(9)]
    rows += [(3, 0, "system", "only")] + [(4, 0, "a", "x")] * 3 + [(5, k, "a" if k % 3 else "b", "m" * k) for k in range(300)] + [(6, None, "a", "x"), (6, 1, "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("mine")).withColumn("before", F.lit(1)).repartition(5)
    got = {}
    for r in chat_views.views(df).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    null_first = lambda x: (x is not None, x)
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "unknown", x or "") for k, t, r, x in rows if k == c), key=lambda m: (null_first(m[0]), m[1], m[2]))
        for p in {m[1] for m in own} - {"system"}:
            text, masks = "", []
            for _, who, x in own:
                role = "system" if who == "system" else "assistant" if who == p else "user"
                text += f"<|{role}|>{' ' + who if role == 'user' else ''}\n"
                if role == "assistant":
                    masks.append((len(text), len(text) + len(x) + len(chat_views.END)))
                text += x + chat_views.END
            expected[c, p] = (text, masks)
    assert got.keys() == expected.keys()
    for k, views in got.items():
        views.sort(key=lambda r: r.place)
        assert [r.place for r in views] == list(range(len(views)))
        assert "".join(r.rendered for r in views) == expected[k][0]
        assert [(r.mask_start, r.mask_stop) for r in views if r.mask_start < r.mask_stop] == expected[k][1]
        assert all(expected[k][0][r.start : r.stop] == r.rendered for r in views)
    assert chat_views.views(df.limit(0)).count() == 0
