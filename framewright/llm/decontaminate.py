"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items of at most MOST_WORDS words together form one automaton, which is built,
broadcast and let go before the next one; a larger benchmark is taken in as many
passes over the documents, with the same results.  A document's words stream through
the automaton; the state and length of the longest match that ends at each word
tell which windows of which items end there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import small_batches, stored

#: Words of one automaton, about 300 bytes each.
MOST_WORDS = 200_000

_FOUND = "array<struct<a:int,b:int>>"


def split_words(text: str | None) -> list[int]:
    """The word hashes of one text."""
    buf, off = W.texts(pa.array([text], pa.string()))
    starts, ends, _ = W.spans(buf, off, W.ALNUM)
    return W.hashes(buf, starts, ends).tolist()


class Automaton:
    """A suffix automaton of several word sequences; next, link and length by state, items by state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.vocabulary = np.array(sorted({w for _, seq in items for w in seq}), np.uint64)
        number = {w: i for i, w in enumerate(self.vocabulary.tolist())}
        items = [(name, [number[w] for w in seq]) for name, seq in items if seq]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            at = 0
            for c in seq:
                at = self._extend(at, c)
        self.shortest = min((min(len(seq), window) for _, seq in items), default=0)
        self._mark(items)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly the longest string of p followed by c, made if c leads to a longer one."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._copy(q, self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, at: int, c: int) -> int:
        if c in self.next[at]:
            return self._split(at, c)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[at] + 1)
        new, p = len(self.length) - 1, at
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _mark(self, items: list[tuple[str, list[int]]]) -> None:
        """Which items hold each state's strings; the state of the last `window` words; the short items that end there."""
        holds: list[set[str]] = [set() for _ in self.length]
        whole: dict[int, set[str]] = {}
        for name, seq in items:
            state = 0
            for c in seq:
                state = self.next[state][c]
                v = state
                while v > 0 and name not in holds[v]:
                    holds[v].add(name)
                    v = self.link[v]
            if len(seq) < self.window:
                whole.setdefault(state, set()).add((len(seq), name))
        self.items = [tuple(x) for x in holds]
        self.last = [-1] * len(self.length)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= self.window:
                self.last[v] = v if self.length[up] < self.window else self.last[up]
            self.short[v] = self.short[up] + tuple(sorted(whole.get(v, ())))

    def hits(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) ranges of the sequence inside a window's occurrence, and the items of those windows."""
        follow, link, length, window = self.next, self.link, self.length, self.window
        found: list[tuple[int, int]] = []
        names: set[str] = set()
        state = matched = 0

        def add(a: int, b: int) -> None:
            while found and found[-1][1] >= a:
                a = min(a, found.pop()[0])
            found.append((a, b))

        for p, c in enumerate(sequence):
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c not in follow[state]:
                continue
            state = follow[state][c]
            matched += 1
            if matched >= window:
                add(p + 1 - window, p + 1)
                names.update(self.items[self.last[state]])
            for n, name in self.short[state]:
                if n <= matched:
                    add(p + 1 - n, p + 1)
                    names.add(name)
        return found, names

    def batch(self, buf: np.ndarray, off: np.ndarray):
        """Word starts, ends and first words of the rows, and for each row with hits its word ranges and items."""
        starts, ends, first = W.spans(buf, off, W.ALNUM)
        rows: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if self.shortest and len(starts):
            h = W.hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == h
            before = np.zeros(len(h), bool)
            before[1:] = known[:-1]
            before[first[:-1][first[:-1] < len(h)]] = False
            begin = np.flatnonzero(known & ~before)
            stop = np.zeros(len(h), bool)
            stop[:-1] = known[1:]
            stop[first[1:][first[1:] > 0] - 1] = False
            end = np.flatnonzero(known & ~stop) + 1
            far = end - begin >= self.shortest
            begin, end = begin[far], end[far]
            for a, b, r in zip(begin.tolist(), end.tolist(), (np.searchsorted(first, begin, "right") - 1).tolist(), strict=True):
                found, names = self.hits(at[a:b].tolist())
                if found:
                    have = rows.setdefault(r, ([], set()))
                    have[0].extend((a + x - int(first[r]), a + y - int(first[r])) for x, y in found)
                    have[1].update(names)
        return starts, ends, first, rows


def automata(benchmark: DataFrame, window: int) -> Iterator[Automaton]:
    """One automaton for each block of at most MOST_WORDS words of the items, read block by block; null texts have none."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    sized = items.withColumn("n", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))
    block, n = [], 0
    for row in sized.toLocalIterator():
        if block and n + row["n"] > MOST_WORDS:
            yield Automaton(block, window)
            block, n = [], 0
        block.append((row["item"], split_words(row["text"])))
        n += row["n"]
    yield Automaton(block, window)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matcher(shared):
    def run(batches):
        machine: Automaton = shared.value
        for batch in batches:
            buf, off = W.texts(batch.column(1))
            for a, b in W.slices(off):
                part = batch.slice(a, b - a)
                _, _, first, rows = machine.batch(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                ranges, names = part.column(3).to_pylist(), part.column(4).to_pylist()
                for r, (found, items) in rows.items():
                    ranges[r] = [{"a": x, "b": y} for x, y in _merged([*((q["a"], q["b"]) for q in ranges[r]), *found])]
                    names[r] = sorted({*names[r], *items})
                kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(ranges, kind), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "ranges", "items"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_id, text)`` and ``(item_id, text)`` -> a row per document: doc_id, n_words, ranges of hit words, ids of the items.

    A window is so many consecutive words of an item, or all words of a shorter
    one; a word of a document is hit inside any occurrence of a window.  Null,
    empty and wordless texts have no words and no hits; items without words have
    no windows; null item ids read "null"; repeated items count once.  Repeated
    documents get equal rows, other columns are ignored, empty tables give no
    rows or no hits.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(_FOUND).alias("ranges"), F.array().cast("array<string>").alias("items"))
    shared = None
    for machine in automata(benchmark, window):
        if shared is not None:
            rows = stored(rows, "matched")
            shared.destroy()
        shared = spark.sparkContext.broadcast(machine)
        rows = rows.mapInArrow(W.released(_matcher(shared)), rows.schema)
    return rows.drop("text")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """matches() as counts, with a digest of the sorted, comma-joined item ids (of no ids: of the empty string)."""
    found = matches(docs, benchmark, window)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _cut(data: bytes, starts: np.ndarray, ends: np.ndarray, ranges: list[tuple[int, int]]) -> bytes:
    """data without the words in the merged ranges."""
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, data[at:]])


def _cleaned(data: bytes, machine: Automaton, coverage: float) -> bytes | None:
    """data without its hit words; None if more than that share of its words is hit."""
    words = hit = None
    while True:
        buf, off = np.frombuffer(data, np.uint8), np.array([0, len(data)])
        starts, ends, _, rows = machine.batch(buf, off)
        if 0 not in rows:
            return data
        ranges = _merged(rows[0][0])
        if words is None:
            words, hit = len(starts), sum(b - a for a, b in ranges)
            if hit > coverage * words:
                return None
        data = _cut(data, starts, ends, ranges)


def _replaced(batch: pa.RecordBatch, column: int, changed: dict[int, bytes | None]) -> pa.RecordBatch:
    """batch with other texts in the rows of changed, without the rows that are None there."""
    if not changed:
        return batch
    texts = batch.column(column)
    order = sorted(changed)
    flag = np.zeros(len(texts), bool)
    flag[order] = True
    new = pa.array([None if changed[r] is None else changed[r].decode() for r in order], pa.string()).cast(texts.type)
    texts = pc.replace_with_mask(texts, pa.array(flag), new)
    gone = np.zeros(len(texts), bool)
    gone[[r for r in order if changed[r] is None]] = True
    return batch.set_column(column, batch.schema.field(column), texts).filter(pa.array(~gone))


def _cleaner(shared, column: int, coverage: float):
    def run(batches):
        machine: Automaton = shared.value
        for batch in batches:
            buf, off = W.texts(batch.column(column))
            changed: dict[int, bytes | None] = {}
            for a, b in W.slices(off):
                own = buf[off[a] : off[b]]
                _, _, _, rows = machine.batch(own, off[a : b + 1] - off[a])
                for r in rows:
                    changed[a + r] = _cleaned(buf[off[a + r] : off[a + r + 1]].tobytes(), machine, coverage)
            yield _replaced(batch, column, changed)

    return run


def _ranger(shared, column: int):
    """Adds an automaton's hits to the merged ranges in the last column."""

    def run(batches):
        machine: Automaton = shared.value
        for batch in batches:
            buf, off = W.texts(batch.column(column))
            last = batch.num_columns - 1
            ranges = batch.column(last).to_pylist()
            for a, b in W.slices(off):
                *_, rows = machine.batch(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                for r, (found, _) in rows.items():
                    ranges[a + r] = [{"a": x, "b": y} for x, y in _merged([*((q["a"], q["b"]) for q in ranges[a + r]), *found])]
            yield batch.set_column(last, batch.schema.field(last), pa.array(ranges, batch.schema.field(last).type))

    return run


def _cutter(column: int, coverage: float):
    """Cuts the ranges in the last column out; texts of which more than that share of words is hit go."""

    def run(batches):
        for batch in batches:
            buf, off = W.texts(batch.column(column))
            changed: dict[int, bytes | None] = {}
            for r, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ranges = [(q["a"], q["b"]) for q in found]
                own = buf[off[r] : off[r + 1]]
                starts, ends, _ = W.spans(own, np.array([0, len(own)]), W.ALNUM)
                gone = sum(b - a for a, b in ranges) > coverage * len(starts)
                changed[r] = None if gone else _cut(own.tobytes(), starts, ends, ranges)
            yield _replaced(batch, column, changed)

    return run


def _by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """As one automaton of all blocks would clean: the hits of all blocks are gathered before a cut, until none hits."""
    spark, column = docs.sparkSession, docs.columns.index("text")
    mark = "ranges"
    while mark in docs.columns:
        mark += "_"
    out, rows = None, docs
    while True:
        rows = rows.withColumn(mark, F.array().cast(_FOUND))
        for machine in automata(benchmark, window):
            shared = spark.sparkContext.broadcast(machine)
            rows = stored(rows.mapInArrow(W.released(_ranger(shared, column)), rows.schema), "matched")
            shared.destroy()
        done, hit = rows.where(F.size(mark) == 0).drop(mark), rows.where(F.size(mark) > 0)
        out = done if out is None else out.unionAll(done)
        if hit.isEmpty():
            return out
        rows = stored(hit.mapInArrow(W.released(_cutter(column, coverage)), rows.schema).drop(mark), "cut")
        coverage = 1.0  # decided on the whole text


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.8) -> DataFrame:
    """docs without the hit words of their texts, and without documents of which more than that share of words is hit.

    A cut joins what stands on its sides, punctuation and white space included;
    it is repeated until no window occurs.  A benchmark of several blocks gives
    what one automaton of all its items would.  All columns pass, n_chars is
    brought up to date where it exists.  Null and empty texts stay as they are,
    texts of any length are read whole, repeated rows stay or go alike, and empty
    tables give no rows or take nothing out.
    """
    machines = automata(benchmark, window)
    first = next(machines)
    if next(machines, None):
        return with_chars(_by_blocks(docs, benchmark, window, coverage))
    shared = docs.sparkSession.sparkContext.broadcast(first)
    return with_chars(docs.mapInArrow(W.released(_cleaner(shared, docs.columns.index("text"), coverage)), docs.schema))


def with_chars(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a number, equal to the length of the text."""
    kind = dict(docs.dtypes).get("n_chars")
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))) if kind in ("int", "bigint") else docs

