"""Document-frequency vocabularies, bigrams, and spelling by delete variants and context."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types

from framewright.functions import text as T
from framewright.functions.text import once
from framewright.operators import lines as L
from framewright.scratch import stored

#: Floors and shares of the vocabularies, and thresholds of context evidence.
DOMAIN_FLOOR, DOMAIN_SHARE = 3, 0.0005
WATERMARK_FLOOR, WATERMARK_SHARE = 5, 0.3
ACCENT_COUNT, ACCENT_RATIO = 5, 10.0
WORD_COUNT, WORD_RATIO = 30, 80.0
LONGEST, EDITS = 20, 2
#: Bytes of texts whose pairs of words are counted at once, and rows of an Arrow batch of them.
TEXTS, ROWS = 1 << 25, 50_000
#: So many units of documents are bits of a number.
FEW = 64
#: Hashes of shortened words that are made at once.
HASHES = 1 << 20
#: A sieve of hashes has at most so many rows of 64 bits; conditions that only sift allow for rounding.
CELL_BITS = 21
CELLS = 1 << CELL_BITS
SLACK = 1.000001
#: Words that are common on screen without being a watermark.
EXCLUDED = ("mekong", "thuy", "quayphim", "mat", "19", "hit")


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(T.words(F.lower(text))).alias("pos", "token"))


def distinct_tokens(docs: DataFrame, text: str) -> DataFrame:
    """token: each once; what a text repeats is dropped in its row."""
    return docs.select(F.explode(F.array_distinct(T.words(F.lower(text)))).alias("token")).distinct()


def document_frequency(docs: DataFrame, unit: str, text: str) -> DataFrame:
    """token, df: in how many units (videos, sources) a token occurs.  Few units are bits of a number, or-ed in Arrow batches and then by Spark."""
    kind = docs.schema[unit].dataType
    few = docs.select(unit).distinct().limit(FEW + 1).collect() if isinstance(kind, types.StringType | types.IntegralType) else []
    if 0 < len(few) <= FEW:
        each = docs.where(F.col(text).isNotNull()).select(F.col(unit).alias("unit"), F.lower(text).alias("text"))
        bits = each.mapInArrow(L.units_of({r[0]: i for i, r in enumerate(few)}), "token string, units long")
        return bits.groupBy("token").agg(F.bit_count(F.bit_or("units")).cast("long").alias("df"))
    return docs.select(unit, F.explode(F.array_distinct(T.words(F.lower(text)))).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("df"))


def _units(docs: DataFrame, unit: str) -> DataFrame:
    return docs.agg(F.countDistinct(unit).alias("units"))


def domain_vocabulary(docs: DataFrame, unit: str, text: str, floor: int = DOMAIN_FLOOR, share: float = DOMAIN_SHARE) -> DataFrame:
    """Tokens in at least max(floor, ceil(share * units)) units."""
    df = document_frequency(docs, unit, text).join(F.broadcast(_units(docs, unit)))  # one row
    return df.where(F.col("df") >= F.greatest(F.lit(floor), F.ceil(share * F.col("units")))).select("token", "df")


def watermark_vocabulary(docs: DataFrame, unit: str, text: str, dictionary: DataFrame, floor: int = WATERMARK_FLOOR, share: float = WATERMARK_SHARE) -> DataFrame:
    """Tokens of two letters or more in at least max(floor, round(share * units)) units that no dictionary has; halves round to even."""
    df = document_frequency(docs, unit, text).join(F.broadcast(_units(docs, unit)))  # one row
    common = df.where((F.col("df") >= F.greatest(F.lit(floor), F.bround(share * F.col("units")))) & (F.length("token") >= 2) & ~F.col("token").isin(*EXCLUDED))
    return common.join(dictionary.select("token"), "token", "left_anti").select("token", "df")


def _pairs(batches, shared=None):
    """Of Arrow batches of texts the pairs of adjacent words, tab between them, with their counts; a pair may come again after
    TEXTS bytes.  With shared bits of words' hashes, those with one of these words."""

    def counted(texts: list[pa.Array]):
        # white space as in T.words(): x09 to x0d and blanks
        lists = pc.ascii_split_whitespace(pa.chunked_array(texts).combine_chunks())
        words, text = lists.flatten(), pc.list_parent_indices(lists)
        filled = pc.not_equal(words, "")
        coded, text = words.filter(filled).dictionary_encode(), text.filter(filled).to_numpy()
        ids, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        near = text[1:] == text[:-1]
        if shared is not None:
            wanted = L.among(L.hashes(coded.dictionary), shared.value, CELL_BITS)[ids]
            near &= wanted[1:] | wanted[:-1]
        both = np.sort((ids[:-1] * size + ids[1:])[near])
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        n, both = np.diff(np.append(first, len(both))), both[first]
        for i in range(0, len(both), ROWS):
            of = lambda numbers: coded.dictionary.take(pa.array(numbers))
            own = both[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(of(own // size), of(own % size), "\t"), pa.array(n[i : i + ROWS])], names=["pair", "n"])

    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch["text"])
        if sum(x.nbytes for x in held) >= TEXTS:
            yield from counted(held)
            held = []
    if held:
        yield from counted(held)


def bigrams(docs: DataFrame, key: str, text: str, near: DataFrame | None = None) -> DataFrame:
    """w1, w2, n: adjacent words; with near (token), all pairs that have one of its words, and by chance some others.

    Pairs are first counted by numbers of words, for many texts at once.  Most of
    what is left is distinct, so that it is dealt out before Spark adds it up: a
    table of a large task's pairs wouldn't fit its memory.
    """
    shared = None if near is None else _bits(near.select("token").mapInArrow(L.word_hashes, "__h long"))
    pairs = docs.select(F.lower(text).alias("text")).mapInArrow(lambda batches: _pairs(batches, shared), "pair string, n bigint")
    every = pairs.repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))
    return every.select(F.substring_index("pair", "\t", 1).alias("w1"), F.substring_index("pair", "\t", -1).alias("w2"), "n")


def deletions(word: Column, edits: int = EDITS) -> Column:
    """The word and all words that deleting up to so many letters leaves; letters are taken out from left to right, so that no two ways lead to the same places."""

    def shorter(x: Column) -> Column:
        n = F.length(x["w"])
        without = lambda i: F.struct(F.concat(F.substr(x["w"], F.lit(1), i - 1), F.substr(x["w"], i + 1)).alias("w"), i.alias("at"))
        return F.when(x["at"] > n, F.array().cast("array<struct<w:string,at:int>>")).otherwise(F.transform(F.sequence(x["at"], n), without))

    def level(words: Column, left: int) -> Column:
        own = F.transform(words, lambda x: x["w"])
        return own if left == 0 else once(words, lambda w: F.concat(F.transform(w, lambda x: x["w"]), level(F.flatten(F.transform(w, shorter)), left - 1)))

    return F.array_distinct(level(F.array(F.struct(word.alias("w"), F.lit(1).alias("at"))), edits))


def _shortened(edits: int, shared=None):
    """A function of Arrow batches of words: each with the hashes, each once, of itself and of what deleting up to so many letters leaves (one or two);
    with shared bits, only of those that are, but for chance, among them.

    A hash is a sum over letters and places, so that those of what is left come
    from sums of the beginning, the middle and the end.
    """
    base, mixed = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    back = np.uint64(pow(int(base), -1, 1 << 64))

    def hashes(words: pa.Array, n: int) -> pa.Array:
        letters = np.array(words.to_pylist(), f"U{max(n, 1)}").view(np.uint32).reshape(len(words), -1)[:, :n].astype(np.uint64) + np.uint64(1)
        letters *= mixed
        letters ^= letters >> np.uint64(31)
        letters *= mixed
        letters *= np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base)), dtype=np.uint64)[:n]
        sums = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(letters, axis=1, out=sums[:, 1:])
        whole = sums[:, n:]
        made = [whole, sums[:, :n] + (whole - sums[:, 1:]) * back]
        if edits > 1:
            i, j = np.triu_indices(n, 1)
            made.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * back * back)
        each = np.concatenate(made, axis=1)
        each ^= each >> np.uint64(32)
        each = np.sort((each * mixed >> np.uint64(32)).astype(np.uint32), axis=1)
        first = np.ones(each.shape, bool)
        np.not_equal(each[:, 1:], each[:, :-1], out=first[:, 1:])
        if shared is not None:
            first &= L.among(each, shared.value, CELL_BITS)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first.sum(axis=1))).astype(np.int32)), pa.array(each[first].view(np.int32)))

    def run(batches):
        for batch in batches:
            sizes = pc.utf8_length(batch[0]).to_numpy()
            for n in np.unique(sizes).tolist():
                own, most = batch.filter(pa.array(sizes == n)), max(1, HASHES // (1 + n + (n * (n - 1) // 2 if edits > 1 else 0)))
                for k in range(0, len(own), most):
                    some = own.slice(k, most)
                    yield pa.RecordBatch.from_arrays([some[0], hashes(some[0], n)], names=["word", "left_over"])

    return run


def _variants(words: DataFrame, name: str, edits: int, shared=None) -> DataFrame:
    """Each word with the hashes of what deletions (see above) leave of it, of 32 bits; equal ones are a hint that only the words themselves confirm."""
    own = words.where("token is not null").select("token").mapInArrow(_shortened(edits, shared), f"{name} string, left_over array<int>")
    if shared is not None:
        # few hashes are left: once dealt out by word, what is met needs no more shuffles
        own = own.where(F.size("left_over") > 0).repartition(name)
    return own.select(name, F.explode("left_over").alias("left_over"))


def suggestions(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, word, edits, k: dictionary words one edit from a token that isn't one, or two where none is; commonest first.

    Tokens of over 20 letters or less than half letters have none.  Both sides
    meet on hashes of what deletions leave of them, so that no pair is made of
    words that share nothing; the distance decides.  ``dictionary`` is (token,
    df); one of up to a few megabytes is sent to all tasks, a larger one shuffled.
    """
    near = _near(tokens, dictionary).distinct()
    best = near.withColumn("__least", F.min("edits").over(W.partitionBy("token"))).where("edits = __least").drop("__least")
    return best.withColumn("k", F.row_number().over(W.partitionBy("token").orderBy(F.desc("df"), "word"))).select("token", "word", "edits", "k")


def best_suggestions(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, word: the first of the suggestions; the least is kept while a token's words are met."""
    best = _near(tokens, dictionary).groupBy("token").agg(F.min(F.struct("edits", -F.col("df"), "word")).alias("b"))
    return best.select("token", F.col("b.word").alias("word"))


def _near(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, word, df, edits: dictionary words within EDITS of tokens that can have suggestions; a pair may come more than once."""
    t = tokens.select("token").distinct().where((F.length("token") <= LONGEST) & (2 * F.length(F.regexp_replace("token", r"\P{L}+", "")) >= F.length("token")) & (F.col("token") != ""))
    words = stored(dictionary.where(F.length("token") <= LONGEST + EDITS), "dictionary")
    t = t.join(words.select("token"), "token", "left_anti")
    variants = _variants(words, "word", EDITS).join(words.select(F.col("token").alias("word"), "df"), "word")
    variants = stored(variants, "variants")
    shared = _bits(variants.select(F.col("left_over").cast("long").alias("__h")))
    met = _variants(t, "token", EDITS, shared).join(variants, "left_over")
    return met.select("token", "word", "df", F.levenshtein("token", "word", EDITS).alias("edits")).where(F.col("edits").between(1, EDITS))


def in_context(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, token and its neighbours."""
    w = docs.select(key, T.words(F.lower(text)).alias("w"))
    near = F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("token"), F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after")))
    return w.select(key, F.explode(near).alias("t")).select(key, "t.*")


def _evidence(rows: DataFrame, word: str, table: DataFrame, name: str) -> DataFrame:
    """rows with the sum of the counts of the bigrams that the word makes with its neighbours."""
    left = table.select(F.col("w1").alias("before"), F.col("w2").alias(word), F.col("n").alias("__l"))
    right = table.select(F.col("w1").alias(word), F.col("w2").alias("after"), F.col("n").alias("__r"))
    both = rows.join(left, ["before", word], "left").join(right, [word, "after"], "left")
    return both.withColumn(name, F.coalesce("__l", F.lit(0)) + F.coalesce("__r", F.lit(0))).drop("__l", "__r")


def _sieve(keys: DataFrame) -> DataFrame:
    """The hashes ``__h`` as bits, of which at most CELLS rows are made, however many hashes there are."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__h, {CELL_BITS}) & 63 as int))")
    cells = keys.select(F.col("__h").bitwiseAND(F.lit(CELLS - 1)).alias("__cell"), bit.alias("__bit")).groupBy("__cell").agg(F.bit_or("__bit").alias("__bits"))
    return stored(cells, "sieve")


def _bits(keys: DataFrame):
    """The sieve of the hashes ``__h`` as a broadcast array of CELLS numbers."""
    cells, bits = _sieve(keys).toPandas(), np.zeros(CELLS, np.uint64)
    bits[cells["__cell"].to_numpy(np.int64)] = cells["__bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _sifted(rows: DataFrame, sieve: DataFrame, **hashes: Column) -> DataFrame:
    """The rows of which a hash is, but for chance, among those of the sieve."""
    for name, h in hashes.items():
        bits = F.broadcast(sieve.select(F.col("__cell").alias(f"__c{name}"), F.col("__bits").alias(f"__b{name}")))  # at most CELLS rows
        rows = rows.join(bits, h.bitwiseAND(F.lit(CELLS - 1)) == F.col(f"__c{name}"), "left")
    there = lambda name, h: F.coalesce(F.getbit(f"__b{name}", F.shiftrightunsigned(h, CELL_BITS).bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return rows.where(reduce(lambda x, y: x | y, [there(*x) for x in hashes.items()]))


def _stronger(pairs: DataFrame, candidates: DataFrame, table: DataFrame, lowest: float, fewest: int) -> tuple[DataFrame, DataFrame]:
    """(before, token, word, rule) and (token, after, word, rule), with the rule's least and ratio: words whose bigram with the neighbour on one side of a token has ratio times the token's, and half of ratio more.

    lowest is the lowest ratio, fewest the least count of a pair.  Each table of
    pairs is read once: for strong ones, and for those of the tokens next to them.
    """
    strong = stored(table.where(F.col("n") >= math.ceil(lowest * (fewest + 0.5) / SLACK)), "strong")
    rule = ["rule", "least", "ratio"]
    met = {}
    for near, word in (("w1", "w2"), ("w2", "w1")):
        both = strong.select(F.col(near).alias("near"), F.col(word).alias("word"), F.col("n").alias("__of_word")).join(candidates, "word")
        met[near] = stored(both.where(F.col("__of_word") * SLACK >= F.col("ratio") * (fewest + 0.5)), "met")
    role = lambda df, c, **is_: df.select(F.col(c).alias("w"), *[F.lit(is_.get(x, False)).alias(x) for x in ("before", "after", "own")])
    each = role(met["w1"], "near", before=True).union(role(met["w2"], "near", after=True)).union(role(met["w1"], "token", own=True)).union(role(met["w2"], "token", own=True))
    roles = stored(each.groupBy("w").agg(*[F.max(x).alias(x) for x in ("before", "after", "own")]), "roles")
    of = lambda side: roles.select(F.col("w").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in ("before", "after", "own")])
    mine = stored(pairs.join(of("w1"), "w1").join(of("w2"), "w2").where("w1_before and w2_own or w1_own and w2_after").select("w1", "w2", "n"), "mine")

    def side(near: str, names: tuple[str, str]) -> DataFrame:
        own = mine.select(F.col(near).alias("near"), F.col("w2" if near == "w1" else "w1").alias("token"), F.col("n").alias("__of_token"))
        enough = F.col("__of_word") * SLACK >= F.col("ratio") * (F.col("__of_token") + 0.5)
        return stored(met[near].join(own, ["near", "token"]).where(enough).withColumnRenamed("near", names[0] if near == "w1" else names[1]).select(*names, "word", *rule), "stronger")

    return side("w1", ("before", "token")), side("w2", ("token", "after"))


def _replaced(rules: list[tuple[DataFrame, int, float]], pairs: DataFrame, table: DataFrame, fewest: int, sift: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """replacements() by several rules (candidates, least, ratio) at once, the rule's number in a column; sift gives distinct
    places, among them those that have a side of the left or right table that it is given."""
    numbered = [c.select("token", "word", F.lit(i).alias("rule"), F.lit(least).alias("least"), F.lit(float(ratio)).alias("ratio")) for i, (c, least, ratio) in enumerate(rules)]
    candidates = stored(reduce(DataFrame.union, numbered), "candidates")
    left, right = _stronger(pairs, candidates, table, min(ratio for _, _, ratio in rules), fewest)
    some = sift(left, right)
    columns = ["before", "token", "after", "word", "rule", "least", "ratio"]
    rows = stored(some.join(left, ["before", "token"]).select(*columns).union(some.join(right, ["token", "after"]).select(*columns)).distinct(), "words")
    pair = lambda a, b: rows.select(F.col(a).alias("w1"), F.col(b).alias("w2"))
    wanted = pair("before", "token").union(pair("token", "after")).union(pair("before", "word")).union(pair("word", "after")).distinct()
    known = stored(table.join(wanted, ["w1", "w2"], "left_semi"), "known")
    others = _evidence(_evidence(rows, "token", known, "evidence"), "word", known, "other")
    best = others.groupBy("rule", "least", "ratio", "before", "token", "after", "evidence").agg(F.max_by(F.struct("word", "other"), F.struct("other", F.transform(F.split("word", ""), lambda c: -F.ascii(c)))).alias("b"))
    enough = (F.col("b.other") >= F.col("least")) & (F.col("b.other") >= (F.col("evidence") + 1) * F.col("ratio"))
    return best.where(enough).select("rule", "before", "token", "after", F.col("b.word").alias("word"), F.col("b.other").alias("other"), "evidence")


def _pairs_of(places: DataFrame, table: DataFrame) -> DataFrame:
    """w1, w2, n: the pairs of neighbours of (before, token, after), 0 for those that the table doesn't have."""
    both = places.select(F.col("before").alias("w1"), F.col("token").alias("w2")).union(places.select("token", "after"))
    return stored(both.where("w1 is not null and w2 is not null").distinct().join(table, ["w1", "w2"], "left").select("w1", "w2", F.coalesce("n", F.lit(0)).alias("n")), "pairs")


def replacements(context: DataFrame, candidates: DataFrame, table: DataFrame, least: int, ratio: float, counted: bool = False) -> DataFrame:
    """For distinct (before, token, after): the candidate of the largest evidence, if that is at least `least` and at
    least ratio (above 0) times that of the token plus one; ties go to the smaller word.  ``candidates`` is (token, word).

    Evidence is the sum of two sides, so a word that has ratio times the token's
    plus one has on one side at least ratio times the token's plus one half.  Those
    words are found from the bigrams; only places that have such a side are
    shuffled, after bits of their hashes (one broadcast of bounded size) have
    sifted the rest out; then their evidence is counted in full.  counted says that
    the table, best a stored one, has all pairs of neighbours of the context.
    """
    places = context.where("before is not null or after is not null").select("before", "token", "after")
    hashes = {"l": F.xxhash64(F.lit(1), "before", "token"), "r": F.xxhash64(F.lit(2), "token", "after")}

    def sift(left: DataFrame, right: DataFrame) -> DataFrame:
        sieve = _sieve(left.select(hashes["l"].alias("__h")).union(right.select(hashes["r"].alias("__h"))))
        return stored(_sifted(places, sieve, **hashes).select("before", "token", "after").distinct(), "places")

    return _replaced([(candidates, least, ratio)], table if counted else _pairs_of(places, table), table, int(counted), sift).drop("rule")


def accent_candidates(dictionary: DataFrame) -> DataFrame:
    """(token, word): dictionary words that differ in accents alone."""
    d = dictionary.select("token", T.strip_accents(F.col("token")).alias("plain"))
    return d.join(d.withColumnRenamed("token", "word"), "plain").where("token <> word").select("token", "word")


def edit_candidates(dictionary: DataFrame) -> DataFrame:
    """(token, word): dictionary words one edit apart, met on what one deletion leaves."""
    v = stored(_variants(dictionary, "token", 1), "variants")
    met = v.join(v.withColumnRenamed("token", "word"), "left_over").where("token <> word").select("token", "word").distinct()
    return met.where(F.levenshtein("token", "word", 1) == 1)


def resolved(tokens: DataFrame, dictionary: DataFrame, domain: DataFrame) -> DataFrame:
    """token, corrected, action (pass, correct, uncertain) and source of each distinct token.

    In this order: a dictionary word; one without the brackets and quotes around
    it; figures and listed words; a domain word; the best suggestion, unless the
    token is all capitals or a code and the suggestion differs in more than
    accents.  Only tokens that come so far reach the suggestions.
    """
    # several passes follow: the texts are read, and the classes found, once
    t, dictionary = stored(tokens.select("token").distinct(), "tokens"), stored(dictionary, "dictionary")
    t = t.withColumn("__low", F.lower("token")).withColumn("__core", T.edge_stripped(F.col("token"))).withColumn("__class", T.token_class(F.col("token")))
    listed = lambda df, on, name: df.select(F.col("token").alias(on), F.lit(True).alias(name)).distinct()
    words = listed(dictionary, "__low", "__word")
    t = t.join(words, "__low", "left").withColumn("__core_low", F.lower("__core"))
    t = t.join(listed(dictionary, "__core_low", "__core_word"), "__core_low", "left").join(listed(domain, "__low", "__domain"), "__low", "left")
    t = stored(t, "looked_up").withColumn("__done", F.coalesce("__word", F.lit(False)) | F.coalesce("__core_word", F.lit(False)) | F.col("__class").isNotNull() | F.coalesce("__domain", F.lit(False)))
    best = best_suggestions(t.where("not __done").select(F.col("__low").alias("token")), dictionary).withColumnRenamed("token", "__low")
    t = t.join(best, "__low", "left")
    same = F.lower(T.strip_accents(F.col("__core"))) == F.lower(T.strip_accents(F.col("word")))
    taken = F.col("word").isNotNull() & (~T.risky_token(F.col("token")) | same)
    out = lambda value, action, source: F.struct(value.alias("corrected"), F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), F.lit(source).alias("source"))
    r = (
        F.when(F.col("__word"), out(F.col("token"), "pass", "dict_exact"))
        .when(F.col("__core_word") & (F.col("__core") != F.col("token")) & (F.col("__core") != ""), out(F.col("__core"), "correct", "dict_exact_stripped"))
        .when(F.col("__class").isNotNull(), out(F.col("__class.corrected"), F.col("__class.action"), "regex"))
        .when(F.col("__domain"), out(F.col("token"), "pass", "domain_exact"))
        .when(taken, out(F.col("word"), "correct", "dict_suggest"))
        .otherwise(out(F.col("token"), "uncertain", "unresolved"))
    )
    return t.select("token", r.alias("r")).select("token", "r.*")


def _in_places(spelt: DataFrame, dictionary: DataFrame, table: DataFrame, counted: bool) -> DataFrame:
    """part, id, pos, accent, flag: the places of lines whose word, by its context, has other accents, or looks wrong."""
    pairs, rules = table, [(accent_candidates(dictionary), ACCENT_COUNT, ACCENT_RATIO), (edit_candidates(dictionary), WORD_COUNT, WORD_RATIO)]
    if not counted:
        pairs = _pairs_of(in_context(spelt, "id", "text"), table)
    placed = []

    def sift(left: DataFrame, right: DataFrame) -> DataFrame:
        of = lambda df, a, b, second: df.select(F.col(a).alias("w1"), F.col(b).alias("w2"), F.lit(second).alias("second"))
        bits = _bits(of(left, "before", "token", True).union(of(right, "token", "after", False)).mapInArrow(L.pair_hashes, "__h long"))
        found = spelt.select("part", "id", F.lower("text").alias("low"), "kept").mapInArrow(L.places_of(bits, CELL_BITS), "part int, id long, pos long, before string, token string, after string")
        placed.append(stored(found, "places"))
        return placed[0].select("before", "token", "after").distinct()

    found = _replaced(rules, pairs, table, int(counted), sift)
    accent, flag = (F.max(F.when(F.col("rule") == i, F.col("word"))) for i in (0, 1))
    found = stored(found.groupBy("before", "token", "after").agg(accent.alias("accent"), flag.alias("flag")), "in_context").alias("f")
    same = reduce(lambda x, y: x & y, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("before", "token", "after")])
    return placed[0].alias("p").join(found, same).select("part", "id", "pos", "accent", "flag")


def corrected_lines(lines: DataFrame, key: str, text: str, dictionary: DataFrame, domain: DataFrame, table: DataFrame, counted: bool = False) -> DataFrame:
    """key, line, corrected, flags: protected words, then the resolver, then accents by context; real words that look wrong in
    their context are only counted.  Every distinct token is resolved once and joined back.  counted says that the table, best a
    stored one, has all pairs of neighbours in the lines that have a dictionary word.

    Lines are dealt out to parts of about L.TEXTS bytes.  Only the distinct words of a
    part leave it, and those that change come back; dictionary words change by
    their context alone, and only where bits of hashes let them through.
    """
    own = lines.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // L.TEXTS), own.sparkSession.sparkContext.defaultParallelism)
    dealt = own.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part").withColumn("id", F.monotonically_increasing_id())
    spelt = stored(dealt.mapInArrow(L.with_kept, types.StructType([*dealt.schema.fields, types.StructField("kept", types.ArrayType(types.StringType()))])), "spelt")
    dictionary = stored(dictionary, "dictionary")
    places = _in_places(spelt, dictionary, table, counted)
    tokens = spelt.select("part", "text", "kept").mapInArrow(L.tokens_of, "part int, token string")
    # a dictionary word stays as it is, or changes by its context
    others = tokens.join(dictionary.select(F.col("token").alias("__word")), F.lower("token") == F.col("__word"), "left_anti")
    others = stored(others, "part_tokens")
    changed = stored(resolved(others.select("token"), dictionary, domain).where("corrected <> token").select("token", "corrected"), "resolved")
    spellings = others.join(changed, "token").select("part", "token", "corrected", *[F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("pos", "long"), ("accent", "string"), ("flag", "string"))])
    changes = spellings.union(places.select("part", F.lit(None).cast("string"), F.lit(None).cast("string"), "id", "pos", "accent", "flag"))
    schema = types.StructType([types.StructField("key", lines.schema[key].dataType), types.StructField("corrected", types.StringType()), types.StructField("flags", types.LongType())])
    return spelt.groupBy("part").cogroup(changes.groupBy("part")).applyInArrow(L.put_together("key"), schema).withColumnRenamed("key", key)
