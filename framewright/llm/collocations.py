"""Phrase collocation mining: phrases of 2 to 4 words by compressed position bitmaps of a shard, summed over shards.

A shard is a slice of documents.  Its words stand at numbered positions, with an
empty one between pieces, so that no phrase crosses a piece's end.  The bitmap of
a word has a bit per position, cut into blocks of 8 of which only those with a
bit are kept.  A phrase's bitmap marks the places of its last word: shifted by
one and ANDed with the bitmaps of the words in the same blocks it gives those of
all its extensions, whose popcounts are the shard's counts.  Phrases are extended
depth-first in groups of bounded size.

A phrase is frequent only if all its words and pairs are.  Counts are summed over
shards for words, then for 40-bit hashes of pairs, then for phrases; each pass
only extends what passes a filter of the frequent words or pairs: a bit array of
bounded size that lets through all of them and few others.  What it or an equal
hash lets through wrongly costs time, never a result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import small_batches, stored

#: Words of a phrase at most; occurrences of a phrase at least; phrases reported for a language; share of a longer phrase that makes a shorter one redundant (percent).
LONGEST, LEAST, TOP, COVER = 4, 30, 2_000, 80
#: Bytes of text in a shard (a longer text is one alone); blocks extended at once; bits of the filter for each phrase and at most.
SHARD_BYTES, GROUP, FILTER_BITS, MOST_FILTER_BITS = 2 << 20, 30_000, 16, 1 << 27
#: Bits of a pair's hash in its count; rows of an Arrow batch of counts at most.
SLOT_BITS, ROWS = 40, 10_000
#: Parts in which the best of a language are found before they meet.
SALTS = 64

#: Words of a piece end at blanks and tabs; pieces end at these characters.
_WORD = np.ones(256, bool)
_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD[[0x20, 0x09]] = False
_WORD[_END] = False


def _folded(buf: np.ndarray) -> np.ndarray:
    return W.LOWER[buf]


def _of_phrase(hashes: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its words and its language."""
    with np.errstate(over="ignore"):
        return W.mix(reduce(lambda s, x: s + x[1] * W.SALTS[x[0]], enumerate(hashes), lang * W.SALTS[40 + len(hashes)]))


def _hashes(column: pa.Array) -> np.ndarray:
    """A hash of each whole string."""
    buf, off = W.texts(column)
    return W.hashes(buf, off[:-1], off[1:], lower=False)


class Shard:
    """Positions, words and languages of a slice of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array):
        buf = _folded(buf)
        starts, ends, first = W.spans(buf, off, _WORD)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        coded = pc.fill_null(langs, "und").dictionary_encode()
        self.langs, lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.lang_hashes = _hashes(self.langs) if len(self.langs) else np.zeros(0, np.uint64)
        # a piece ends between two words if an ending character or a row's end stands there
        gap = np.zeros(len(starts) + 1, np.int64)
        gap[np.searchsorted(starts, np.flatnonzero(_END[buf]))] = 1
        gap[first] = 1
        self.position = np.arange(len(starts)) + np.cumsum(gap[:-1])
        h = W.hashes(buf, starts, ends, lower=False)
        with np.errstate(over="ignore"):
            both = W.mix(h + self.lang_hashes[lang] * W.SALTS[50]) if len(h) else h
        self.word, different = pd.factorize(both)
        at = np.zeros(len(different), np.int64)
        at[self.word[::-1]] = np.arange(len(starts))[::-1]
        self.hash, self.lang = h[at], lang[at]
        self._bytes, self._starts, self._ends = buf, starts[at], ends[at]

    def texts(self) -> pa.Array:
        """The text of each different word."""
        size = self._ends - self._starts
        off = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self._starts - off[:-1], size) + np.arange(off[-1])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self._bytes[place]))).cast(pa.string())

    def phrase_hashes(self, members: np.ndarray) -> np.ndarray:
        """Hashes of phrases, given as rows of word numbers."""
        return _of_phrase([self.hash[members[:, i]] for i in range(members.shape[1])], self.lang_hashes[self.lang[members[:, 0]]])


class Bitmaps:
    """Compressed bitmaps of a shard's words: blocks ordered by word, and the same by block number."""

    def __init__(self, word: np.ndarray, position: np.ndarray):
        key = np.sort((word << 40) | position)
        block = key >> 3  # the word and the block's number
        first = np.flatnonzero(np.diff(block, prepend=-1))
        bit = np.left_shift(1, key & 7).astype(np.uint8)
        bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        block = block[first]
        self.word, self.block, self.bits = block >> 37, block & ((1 << 37) - 1), bits
        order = np.argsort(self.block, kind="stable")
        self._word, self._bits = self.word[order], self.bits[order]
        most = int(self.block.max()) + 2 if len(order) else 1
        self._from = np.searchsorted(self.block[order], np.arange(most + 1))

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Blocks of all one-word extensions: the place of the block they come from, the new word, block and bits."""
        wide = bits.astype(np.uint16) << 1
        here, over = (wide & 0xFF).astype(np.uint8), (wide >> 8).astype(np.uint8)
        source = np.concatenate([np.flatnonzero(here), np.flatnonzero(over)])
        n = np.count_nonzero(here)
        shifted = np.concatenate([here[source[:n]], over[source[n:]]])
        target = block[source]
        target[n:] += 1
        target = np.minimum(target, len(self._from) - 2)
        count = self._from[target + 1] - self._from[target]
        each = np.repeat(np.arange(len(source)), count)
        other = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + self._from[target][each]
        both = shifted[each] & self._bits[other]
        hit = np.flatnonzero(both)
        each, other = each[hit], other[hit]
        return source[each], self._word[other], target[each], both[hit]


def _deeper(shard: Shard, maps: Bitmaps, lengths: range, pairs, members: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
    """Extend phrases (rows of members; blocks ordered by phrase), a group of whole phrases at a time.

    No closure: one that calls itself would hold a shard's arrays until cycles are collected.
    """
    a = 0
    while a < len(phrase):
        b = min(a + GROUP, len(phrase))
        b = int(np.searchsorted(phrase, phrase[b - 1], "right"))  # the last phrase whole
        source, word, blocks, own = maps.extended(phrase[a:b], block[a:b], bits[a:b])
        number, different = pd.factorize((phrase[a:b][source].astype(np.int64) << 32) | word)
        longer = np.column_stack([members[different >> 32], different & 0xFFFFFFFF])
        n = longer.shape[1]
        ok = np.ones(len(longer), bool) if pairs is None else pairs(shard.phrase_hashes(longer[:, -2:]))
        if n in lengths and len(longer):
            counts = np.bincount(number, np.bitwise_count(own), len(longer)).astype(np.int64)
            yield longer[ok], counts[ok]
        if n + 1 < lengths.stop:
            on = np.flatnonzero(ok[number])
            order = on[np.argsort(number[on], kind="stable")]
            yield from _deeper(shard, maps, lengths, pairs, longer[ok], (np.cumsum(ok) - 1)[number[order]], blocks[order], own[order])
        a = b


def phrases(shard: Shard, lengths: range, filters: list):
    """The shard's phrases of so many words whose words and pairs may be frequent, by groups: rows of word numbers, and counts.

    filters test hashes, the first those of words, the second, needed beyond pairs, those of pairs.
    """
    keep = filters[0](shard.phrase_hashes(np.arange(len(shard.hash))[:, None]))
    of_kept = keep[shard.word]
    if of_kept.any():
        maps = Bitmaps(shard.word[of_kept], shard.position[of_kept])
        words, number = np.unique(maps.word, return_inverse=True)
        yield from _deeper(shard, maps, lengths, filters[1] if len(filters) > 1 else None, words[:, None], number, maps.block, maps.bits)


def _shards(batches):
    """Shards of consecutive batches, of SHARD_BYTES or a text more."""

    def joined():
        pending, size = [], 0
        for batch in batches:
            pending.append(batch)
            size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield pending
                pending, size = [], 0
        if pending:
            yield pending

    for parts in joined():
        whole = pa.Table.from_batches(parts)
        buf, off = W.texts(whole.column("text"))
        langs = whole.column("lang").combine_chunks()
        for a, b in W.slices(off, SHARD_BYTES):
            yield Shard(buf[off[a] : off[b]], off[a : b + 1] - off[a], langs.slice(a, b - a))


def _given(names: list[str], columns: list[pa.Array]):
    """Batches of ROWS rows at most, so that neither side holds many."""
    for a in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(a, ROWS) for c in columns], names=names)


def _count_words(batches):
    for shard in _shards(batches):
        counts = np.bincount(shard.word, minlength=len(shard.hash))
        totals = np.bincount(shard.lang, counts, len(shard.langs)).astype(np.int64)
        lang = pa.concat_arrays([shard.langs.take(pa.array(shard.lang)), shard.langs]).cast(pa.string())
        phrase = pa.concat_arrays([shard.texts(), pa.nulls(len(totals), pa.string())])
        yield from _given(["lang", "phrase", "n"], [lang, phrase, pa.array(np.concatenate([counts, totals]))])


def _count_pairs(shared):
    """Of each pair of frequent words SLOT_BITS of its hash, and its count."""

    def run(batches):
        filters = [_passes(shared.value)]
        for shard in _shards(batches):
            for members, counts in phrases(shard, range(2, 3), filters):
                slot = (shard.phrase_hashes(members) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                yield from _given(["slot", "n"], [pa.array(slot), pa.array(counts)])

    return run


def _count_phrases(shared: list):
    def run(batches):
        filters = [_passes(s.value) for s in shared]
        for shard in _shards(batches):
            texts = shard.texts()
            for members, counts in phrases(shard, range(2, LONGEST + 1), filters):
                words = [texts.take(pa.array(column)) for column in members.T]
                lang = shard.langs.take(pa.array(shard.lang[members[:, 0]])).cast(pa.string())
                yield from _given(["lang", "phrase", "n"], [lang, pc.binary_join_element_wise(*words, " "), pa.array(counts)])

    return run


def _passes(bits: np.ndarray):
    """A test of hashes against a bit array, a power of two of 64-bit words."""
    shift = np.uint64(64 - (len(bits) * 64 - 1).bit_length())

    def test(h: np.ndarray) -> np.ndarray:
        place = h >> shift
        return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    return test


def _places(width: int):
    """Of (lang, phrase) the bits of a filter of 2 ** width bits: the number of a 64-bit word and its bits there."""

    def run(batches):
        for batch in batches:
            buf, off = W.texts(batch.column("phrase"))
            starts, ends, first = W.spans(buf, off, _WORD)
            h, n = W.hashes(buf, starts, ends, lower=False), np.diff(first)
            lang, out = _hashes(batch.column("lang")), np.zeros(len(n), np.uint64)
            for k in range(1, LONGEST + 1):
                own = np.flatnonzero(n == k)
                out[own] = _of_phrase([h[first[own] + i] for i in range(k)], lang[own])
            place = out >> np.uint64(64 - width)
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["word", "bits"])

    return run


def _width(n: int) -> int:
    """A filter of so many keys has 2 ** width bits."""
    return max(10, (min(max(n * FILTER_BITS, 1), MOST_FILTER_BITS) - 1).bit_length())


def _filter(rows: DataFrame, width: int):
    """The broadcast bit array (16 MB at most) of rows of its 64-bit words and their bits."""
    got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << width - 6, np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _of_words(words: DataFrame):
    width = _width(words.count())
    return _filter(words.select("lang", "phrase").mapInArrow(W.released(_places(width)), "word long, bits long"), width)


def _of_slots(slots: DataFrame):
    width = _width(slots.count())
    place = F.shiftright("slot", SLOT_BITS - width)
    return _filter(slots.select(place.alias("p")).selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS int)) AS bits"), width)


def frequencies(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n, words)`` of all phrases of 1 to LONGEST words that occur so often, and ``(lang, n)``, all words of each language."""
    small_batches(docs.sparkSession)
    rows = docs.select("text", "lang")
    summed = lambda counts: counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    kind = "lang string, phrase string, n long"
    words = stored(summed(rows.mapInArrow(W.released(_count_words), kind)).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    single = words.where("phrase is not null")
    shared = [_of_words(single)]
    slots = rows.mapInArrow(W.released(_count_pairs(shared[0])), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    shared.append(_of_slots(stored(slots.where(F.col("n") >= least).select("slot"), "slots")))
    longer = stored(summed(rows.mapInArrow(W.released(_count_phrases(shared)), kind)).where(F.col("n") >= least), "phrases")
    for s in shared:
        s.destroy()
    every = single.union(longer).withColumn("words", F.size(F.split("phrase", " ")))
    return every, words.where("phrase is null").select("lang", "n")


def _part(first, n):
    """n words of a phrase from the first (1-based) on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def scored(every: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, phrase, n, words)`` -> lang, phrase, words, a, l, r, score of the phrases of two words and more: the lowest score of all cuts, ties to the smallest first part."""
    long = every.where("words > 1")
    count = lambda name: every.select("lang", F.col("phrase").alias(f"__{name}"), F.col("n").alias(name))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("__l", _part(F.lit(1), F.col("k"))).withColumn("__r", _part(F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(count("l"), ["lang", "__l"]).join(count("r"), ["lang", "__r"])
    score = F.expr("(2000000 * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase", "words", F.col("n").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def uncovered(found: DataFrame) -> DataFrame:
    """Without the phrases inside a longer one that has COVER percent of their count or more."""
    longer = found.where("words > 2").withColumn("__n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("__at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("__n") + 1)))
    inside = longer.select("lang", _part(F.col("__at"), F.col("__n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    kept = found.join(inside, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20, 0)")
    return kept.where(F.col("__longer").isNull() | (100 * wide("__longer") < COVER * wide("a"))).drop("__longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(text, lang)`` -> lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Null texts count as empty, null languages are the language ``und``; empty
    texts and tables give no phrases, repeated rows count as often as they occur,
    ties of score and count go by the phrase's bytes.  Texts of any length are
    read whole, a very long one as a shard of its own.  Other columns are ignored.
    """
    every, totals = frequencies(docs, least)
    found = stored(uncovered(scored(every, least)), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = lambda d, keys: d.withColumn("rank", F.row_number().over(Win.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    best = first(first(salted, ["lang", "__salt"]).drop("rank"), ["lang"])
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
