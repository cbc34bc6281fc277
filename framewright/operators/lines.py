"""Words of lines in Arrow batches: the distinct ones, those that stand in given pairs, and lines put together again.

Lines have an id, a part (a number that rows of one key share) and ``kept``: null,
or what each word is to be, "" where it is free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from framewright.functions import text as T

#: Bytes of lines that are split into words at once, and where words are counted; rows of an Arrow batch of words.
TEXTS, MANY_TEXTS, ROWS = 1 << 23, 1 << 25, 50_000
#: Which word of a pair may be another one: the second or the first.
SECOND, FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts without nulls, and how many each text has; white space as in T.words(): x09 to x0d and blanks."""
    lists = pc.ascii_split_whitespace(texts)
    each, text = lists.flatten(), pc.list_parent_indices(lists)
    filled = pc.not_equal(each, "")
    return each.filter(filled), np.bincount(text.filter(filled).to_numpy(), minlength=len(texts))


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """The batches, as many together as their column has so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b[column].nbytes for b in held) >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def _free(kept: pa.Array, counts: np.ndarray) -> np.ndarray:
    free, ends = np.ones(counts.sum(), bool), np.cumsum(counts)
    for i in np.flatnonzero(kept.is_valid().to_numpy(zero_copy_only=False)).tolist():
        free[ends[i] - counts[i] : ends[i]] = [w == "" for w in kept[i].as_py()]
    return free


def _sliced(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=ROWS)


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (part, text, kept) the free words of each part as (part, token); one may come again after TEXTS bytes."""
    for table in gathered(batches, "text", TEXTS):
        each, counts = words(_column(table, "text"))
        coded = each.dictionary_encode()
        parts, part = np.unique(_column(table, "part").to_numpy(), return_inverse=True)
        size = max(1, len(coded.dictionary))
        both = np.unique((np.repeat(part, counts) * size + coded.indices.to_numpy())[_free(_column(table, "kept"), counts)])
        yield from _sliced(pa.table({"part": pa.array(parts[both // size]), "token": coded.dictionary.take(pa.array(both % size))}))


def units_of(numbers: dict):
    """A function of (unit, text) that gives (token, units): of each word the bits of the units that have it, numbered as given;
    one may come again after MANY_TEXTS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", MANY_TEXTS):
            each, counts = words(_column(table, "text"))
            coded, units = each.dictionary_encode(), _column(table, "unit").dictionary_encode(null_encoding="encode")
            number = np.array([numbers[u] for u in units.dictionary.to_pylist()], np.int64)[units.indices.to_numpy()]
            both = np.unique(coded.indices.to_numpy().astype(np.int64) * 64 + np.repeat(number, counts))
            first = np.flatnonzero(np.append(True, both[1:] // 64 != both[:-1] // 64)[: len(both)])
            bits = np.bitwise_or.reduceat(np.int64(1) << (both % 64), first) if len(both) else both
            yield from _sliced(pa.table({"token": coded.dictionary.take(pa.array(both[first] // 64)), "units": pa.array(bits)}))

    return run


def with_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with a column kept; only those with the beginnings of a protected place are gone through word by word."""
    for b in batches:
        kept: list = [None] * b.num_rows
        for i in np.flatnonzero(pc.match_substring_regex(b["text"], T.MAY_BE_PROTECTED).to_numpy(zero_copy_only=False)).tolist():
            held = T.protect(re.findall(r"[^\x09-\x0d\x20]+", b["text"][i].as_py()))
            kept[i] = held if any(held) else None
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.list_(pa.string()))], names=[*b.schema.names, "kept"])


def hashes(each: pa.Array) -> np.ndarray:
    """64 bits for each string."""
    return pd.util.hash_array(each.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(each) else np.zeros(0, np.uint64)


def _of_pairs(first: np.ndarray, second: np.ndarray, which: np.uint64) -> np.ndarray:
    h = first * which + second
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def among(h: np.ndarray, cells: np.ndarray, cell_bits: int) -> np.ndarray:
    """Which hashes are, but for chance, among those whose bits are set: cells of 64 bits by the low bits of a hash, bits by the next ones."""
    kind = h.dtype.type
    bit = ((h >> kind(cell_bits)) & kind(63)).astype(np.uint64)
    return (cells[h & kind(len(cells) - 1)] >> bit) & np.uint64(1) == 1


def word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hashes(b[0]).view(np.int64))], names=["__h"])


def pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (w1, w2, second) the hash of the pair; second says which of its words may be another."""
    for b in batches:
        first, second = hashes(b["w1"]), hashes(b["w2"])
        h = np.where(b["second"].to_numpy(zero_copy_only=False), _of_pairs(first, second, SECOND), _of_pairs(first, second, FIRST))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["__h"])


def places_of(shared, cell_bits: int):
    """A function of (part, id, low, kept) that gives (part, id, pos, before, token, after) of the free words that, with a
    neighbour, make a pair whose hash is, but for chance, among the shared cells of 64 bits."""

    def run(batches):
        for table in gathered(batches, "low", TEXTS):
            each, counts = words(_column(table, "low"))
            coded, row = each.dictionary_encode(), np.repeat(np.arange(table.num_rows), counts)
            h, same = hashes(coded.dictionary)[coded.indices.to_numpy()], row[1:] == row[:-1]
            some, after = np.zeros(len(row), bool), np.zeros(len(row), bool)
            after[:-1] = same
            some[1:] |= same & among(_of_pairs(h[:-1], h[1:], SECOND), shared.value, cell_bits)
            some[:-1] |= same & among(_of_pairs(h[:-1], h[1:], FIRST), shared.value, cell_bits)
            at = np.flatnonzero(some & _free(_column(table, "kept"), counts))
            before = np.append(False, same)[: len(row)]
            word = lambda i, there: coded.dictionary.take(coded.indices.take(pa.array(i, mask=~there)))
            pos = at - (np.cumsum(counts) - counts)[row[at]]
            of = [_column(table, c).take(pa.array(row[at])) for c in ("part", "id")]
            all_there = np.ones(len(at), bool)
            yield from _sliced(pa.table({"part": of[0], "id": of[1], "pos": pa.array(pos, pa.int64()), "before": word(at - 1, before[at]), "token": word(at, all_there), "after": word(at + 1, after[at])}))

    return run


def put_together(key: str):
    """A function of the lines (id, key, text, kept) of a part and of its changes: the spellings (token, corrected) of words
    wherever they are free, and places (id, pos) with an accent or a flag.  It gives key, corrected, flags; rows that share a
    key are one, word by word."""

    def run(lines: pa.Table, changes: pa.Table) -> pa.Table:
        each, counts = words(_column(lines, "text"))
        starts, kept = np.cumsum(counts) - counts, _column(lines, "kept")
        spelt = changes.filter(changes["token"].is_valid())
        coded = each.dictionary_encode()
        now = pc.coalesce(_column(spelt, "corrected").take(pc.index_in(coded.dictionary, _column(spelt, "token"))), coded.dictionary).take(coded.indices)
        other = {}
        for i in np.flatnonzero(kept.is_valid().to_numpy(zero_copy_only=False)).tolist():
            other |= {int(starts[i]) + pos: w for pos, w in enumerate(kept[i].as_py()) if w != ""}
        ids, flags = _column(lines, "id").to_numpy(), np.zeros(lines.num_rows, np.int64)
        order = np.argsort(ids)
        met = changes.filter(changes["id"].is_valid())
        row = order[np.searchsorted(ids[order], _column(met, "id").to_numpy())]
        for i, pos, accent in zip(row.tolist(), met["pos"].to_pylist(), met["accent"].to_pylist(), strict=True):
            if accent is None:
                flags[i] += 1
            else:
                other[int(starts[i]) + pos] = accent
        if other:
            mask, places = np.zeros(len(now), bool), sorted(other)
            mask[places] = True
            now = pc.replace_with_mask(now, pa.array(mask), pa.array([other[p] for p in places], now.type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), now)
        out = pa.table({key: _column(lines, key), "corrected": pc.binary_join(lists, " "), "flags": pa.array(flags)})
        return _merged(out, lists, key)

    return run


def _merged(out: pa.Table, lists: pa.ListArray, key: str) -> pa.Table:
    codes = _column(out, key).dictionary_encode(null_encoding="encode").indices.to_numpy()
    if len(np.unique(codes)) == len(codes):
        return out
    rows = pd.Series(range(len(codes))).groupby(codes).agg(list)
    text, flags = out["corrected"].to_pylist(), out["flags"].to_numpy()
    corrected = [text[of[0]] if len(of) == 1 else " ".join(w for _, w in sorted(x for i in of for x in enumerate(lists[i].as_py()))) for of in rows]
    return pa.table({key: _column(out, key).take(pa.array([of[0] for of in rows])), "corrected": pa.array(corrected, pa.string()), "flags": pa.array([int(flags[of].sum()) for of in rows])})
