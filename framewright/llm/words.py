"""Words and word hashes of whole Arrow batches, without a Python object per word.

A text column's UTF-8 buffer is classified byte by byte with lookup tables.
Every byte of a multi-byte character is 0x80 or above, so rules on ASCII
characters hold on bytes.  A word's 64-bit hash is a polynomial over a random
value per byte, taken from one cumulative sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SALTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of every byte that is not ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM[_a:_b] = True

_powers: dict[str, np.ndarray] = {}


def _table(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[kind] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def released(run: Callable) -> Callable:
    """run, a function of Arrow batches, that gives its memory back to the system at the end of a partition: idle workers stay."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most so many bytes; one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def spans(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each row the index of its first word (n + 1 values)."""
    w = kind[buf]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    inner = off[(off > 0) & (off < len(w))]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = (_BYTE[LOWER] if lower else _BYTE)[buf]
        value *= _table("up", _BASE, len(buf))[: len(buf)]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[ends] - total[starts]) * _table("down", _INVERSE, len(buf))[starts])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row and the rows' offsets in them; a row of fewer words has one window of all of them."""
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(have)])
    with np.errstate(over="ignore"):
        full = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for j in range(n):
            full += h[j : j + len(full)] * SALTS[j]
        row = np.repeat(np.arange(len(count)), have)
        at = first[:-1][row] + (np.arange(out_off[-1]) - out_off[:-1][row])
        out = np.zeros(out_off[-1], np.uint64)
        whole = (count >= n)[row]
        out[whole] = full[at[whole]]
        for r in np.flatnonzero((count > 0) & (count < n)):
            own = h[first[r] : first[r + 1]]
            out[out_off[r]] = (own * SALTS[: len(own)]).sum(dtype=np.uint64) + SALTS[40 + len(own) % 20]
        return mix(out), out_off
