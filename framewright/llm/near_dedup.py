"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts gives each document the size and the 128-bit
   fingerprint of its set of word shingles, 200 minima in 40 bands of 5, and the
   low 2 bits of 192 minima, packed into six words.
2. Equal sets become one class at once, so copies cost nothing below.
3. Classes that share a band are candidates.  Each bucket is linked to its most
   popular member (the one whose buckets are largest, which is the original of a
   family of copies): as many candidates as members, never all pairs.
4. Candidates whose collision-corrected bit estimate is low go; the rest is
   decided on the full sets, and the differences of the sets are kept.
5. What a bucket still holds apart from its largest component is compared with
   the rest of that bucket, so that a member linked to any other member, not only
   to the popular one, is found.  Sizes and bits come first; two members whose
   differences from the popular one are known are then decided from those, which
   say exactly how much the two have in common; others on their full sets.

A pair at the threshold of 0.8 misses all bands with probability
(1 - 0.8^5)^40 = 1.2e-7; its bit estimate is five deviations above the cut.
Class ids are 64 bits of the fingerprint: among ten thousand million different
sets, about three pairs of ids are expected to clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.components import components
from framewright.llm.store import small_batches, stored

BANDS, ROWS, SIGNED = 40, 5, 192
MINIMA = BANDS * ROWS
#: Most of the 192 low-bit pairs that may differ: an estimate of 0.62 (see similarity()).
MOST_DIFFERENT = 54
#: The same for a member of a bucket and its popular member, whose difference is taken to compare members: an estimate of 0.35.
MOST_APART = 93
#: Ids of candidate documents up to this number go to all executors (8 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Pairs with one popular member that are judged in one place; the set of a member of more pairs goes to as many places.
PAIRS = 256

_rng = np.random.default_rng(7)
_A, _C = (_rng.integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def similarity(different: int, compared: int = SIGNED, bits: int = 2) -> float:
    """The Jaccard estimate from the number of differing b-bit values, less chance collisions."""
    chance = 2.0**-bits
    return (1 - different / compared - chance) / (1 - chance)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """200 minima of each set; values holds the 64-bit shingle hashes of all sets, none empty, starts where each begins."""
    out = np.empty((MINIMA, len(starts)), np.uint32)
    x = ((values >> np.uint64(32)) ^ values).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(MINIMA):
            h = x * _A[i]
            h ^= h >> np.uint32(16)
            h *= _C[i]
            h ^= h >> np.uint32(15)
            out[i] = np.minimum.reduceat(h, starts)
    return out.T


def packed(m: np.ndarray) -> np.ndarray:
    """The low 2 bits of the first 192 minima: three words of low bits, then three of high bits."""
    planes = [np.packbits(((m[:, :SIGNED] >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in (0, 1)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.zeros((len(m), BANDS), np.uint64)
        for r in range(ROWS):
            keys += (m[:, r::ROWS].astype(np.uint64) + np.uint64(1)) * W.SALTS[r]
        return W.mix(keys + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * W.SALTS[10]).view(np.int64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row and the sorted distinct shingle hashes of the rows from there on, slice by slice."""
    buf, off = W.texts(column)
    for a, b in W.slices(off):
        own, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = W.spans(own, at, W.SPACED)
        g, go = W.grams(W.hashes(own, starts, ends), first, n)
        yield a, [np.unique(g[go[i] : go[i + 1]]) for i in range(b - a)]


def _signer(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, sets in shingle_sets(batch.column(1), n):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys, bits = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 6), np.int64)
                if len(full):
                    m = minima(np.concatenate(sets), np.concatenate([[0], np.cumsum(size[full])[:-1]]))
                    keys[full], bits[full] = band_keys(m), packed(m)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), pa.array(size), pa.array(prints, pa.binary()), pa.array([int.from_bytes(p[:8], "little", signed=True) if p else None for p in prints], pa.int64()), lists(keys), lists(bits)],
                    names=["doc_id", "n", "print", "vid", "bands", "bits"],
                )

    return run


def _setter(n: int):
    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), n):
                values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                vids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8 * 2).digest()[:8], "little", signed=True) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(values))], names=["vid", "shingles"])

    return run


def _judged(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) pairs of class ids, whether their full sets are similar enough, and what each set has that the other lacks."""
    used = pairs.select(F.col("a").alias("vid")).union(pairs.select(F.col("b").alias("vid"))).distinct()
    ids = stored(reps.join(used, "vid").select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    few = ids.count() <= MOST_BROADCAST
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(W.released(_setter(n)), "vid long, shingles array<bigint>").where("vid is not null")
    sets = sets.groupBy("vid").agg(F.first("shingles").alias("shingles"))
    of = lambda c: sets.select(F.col("vid").alias(c), F.col("shingles").alias("set_" + c))
    # a popular member's pairs are spread
    many = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("parts")).where("parts > 1"), "popular")
    many = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    placed = pairs.select("a", "b").join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    copied = of("b").join(many, "b", "left").select("b", "set_b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = placed.join(of("a"), "a").join(copied, ["b", "part"])
    more = both.select("a", "b", F.array_except("set_a", "set_b").alias("added"), F.array_except("set_b", "set_a").alias("removed"), F.size("set_b").alias("size_b"))
    common, union = F.col("size_b") - F.size("removed"), F.col("size_b") + F.size("added")
    return more.withColumn("linked", 100 * common >= percent * union)


def _differ(a: str, b: str):
    """How many of the 192 low-bit pairs of rows a and b differ."""
    x, y = (lambda i: F.element_at(f"{a}.bits", i)), (lambda i: F.element_at(f"{b}.bits", i))
    one = lambda i: F.bit_count(x(i).bitwiseXOR(y(i)).bitwiseOR(x(i + 3).bitwiseXOR(y(i + 3))))
    return one(1) + one(2) + one(3)


def _possible(percent: int):
    """Whether sizes and bits leave the pair of rows x and y above the threshold."""
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (_differ("x", "y") <= MOST_DIFFERENT)


def _known_alike(percent: int):
    """Whether rows x and y, of which the differences from one set c are known, are similar enough; null if one isn't known.

    A shingle that both lack of c, or that both have beyond c, is one that the
    sum of the differences counts twice.
    """
    again = F.size(F.array_intersect("x.removed", "y.removed")) + F.size(F.array_intersect("x.added", "y.added"))
    common = F.col("x.size_b") - F.size("x.removed") - F.size("y.removed") + again
    union = F.col("x.size_b") + F.size("x.added") + F.size("y.added") - again
    return F.when(F.col("x.removed").isNotNull() & F.col("y.removed").isNotNull(), 100 * common >= percent * union)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, text)`` -> a row per row: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes that aren't ASCII white space, with A-Z lower-cased;
    a document's set holds its distinct n-word shingles, or, with fewer words,
    the whole sequence as one.  Documents are linked if 100 * intersection >=
    percent * union of the sets, and component_id is the smallest doc_id reached.
    percent must be 80 or more: the bands and the cut on bits are set for that.

    Null, empty and blank texts have an empty set and are their own component;
    texts of any length are read whole.  doc_id counts as a whole number: one that
    isn't is an error under ANSI rules, else null.
    Rows of one doc_id are one document: the links of any of its texts hold.
    A null doc_id takes part in nothing: component_id null, kept true.  Columns
    but doc_id and text are ignored, an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("percent must be at least 80")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(W.released(_signer(n)), "doc_id long, n long, print binary, vid long, bands array<bigint>, bits array<bigint>"), "signed")
    known = signed.where("doc_id is not null and vid is not null")
    # copies of one set: a class, summed per task before the shuffle
    reps = known.groupBy("vid", "n").agg(F.min("doc_id").alias("rep"))
    first = signed.select("doc_id", "vid", "bands", "bits").where("vid is not null")
    reps = stored(reps.alias("r").join(first.alias("f"), (F.col("r.vid") == F.col("f.vid")) & (F.col("r.rep") == F.col("f.doc_id"))).select("r.vid", "r.n", "r.rep", "f.bands", "f.bits").dropDuplicates(["vid"]), "classes")
    facts = reps.select("vid", "n", "bits")
    rows = reps.select("vid", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(sizes, "bucket"), "buckets")
    popular = shared.groupBy("vid").agg(F.sum("size").alias("popularity"))
    top = shared.join(popular, "vid").groupBy("bucket").agg(F.max(F.struct("popularity", "vid")).alias("top")).select("bucket", F.col("top.vid").alias("b"))
    stars = shared.select("bucket", F.col("vid").alias("a")).join(top, "bucket").where("a <> b").select("a", "b").distinct()
    known_as = lambda c: facts.select(F.col("vid").alias(c), F.struct("n", "bits").alias("of_" + c))
    pairs = stored(stars.join(known_as("a"), "a").join(known_as("b"), "b").where(_differ("of_a", "of_b") <= MOST_APART).select("a", "b"), "pairs")
    judged = stored(_judged(pairs, reps, docs, n, percent), "judged")
    links = judged.where("linked").select("a", "b")
    labels = components(links)

    # what is left in buckets of several components
    held = shared.select("bucket", "vid").join(labels.select(F.col("v").alias("vid"), "label"), "vid", "left").select("bucket", "vid", F.coalesce("label", "vid").alias("label"))
    counted = held.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mains = counted.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("main.label").alias("main"))
    mixed = held.join(mains, "bucket").join(top, "bucket").join(facts, "vid")
    apart = judged.select(F.col("a").alias("vid"), "b", "added", "removed", "size_b")
    none, itself = F.array().cast("array<bigint>"), F.col("vid") == F.col("b")
    own = lambda c, at_center: F.when(itself, at_center).otherwise(F.col(c)).alias(c)
    mixed = stored(mixed.join(apart, ["vid", "b"], "left").select("bucket", "vid", "label", "main", "n", "bits", own("added", none), own("removed", none), own("size_b", F.col("n").cast("int"))), "mixed")
    # sets of a bucket meet those of their own size class and the next ones, PAIRS of them in one place
    mixed = mixed.withColumn("class", F.floor(F.log("n") / np.log(max(100 / percent, 1.01)) + 1e-9))
    parts = mixed.groupBy("bucket", "class").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    rest = mixed.join(parts, ["bucket", "class"]).withColumn("part", F.pmod(F.xxhash64("vid"), "parts")).drop("parts").alias("y")
    odd = mixed.where("label <> main").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    odd = odd.join(parts, ["bucket", "class"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").alias("x")
    across = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.vid") < F.col("y.vid")))
    alike = F.coalesce(_known_alike(percent), F.lit(True))
    sure = F.col("x.removed").isNotNull() & F.col("y.removed").isNotNull()
    more = stored(odd.join(rest, across & _possible(percent) & alike).select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"), sure.alias("sure")).distinct(), "more")
    links = links.union(more.where("sure").select("a", "b"))
    open_pairs = more.where("not sure").join(more.where("sure"), ["a", "b"], "left_anti").select("a", "b")
    links = links.union(_judged(stored(open_pairs, "open"), reps, docs, n, percent).where("linked").select("a", "b"))

    # a doc_id with several texts is one document
    several = known.groupBy("doc_id").agg(F.min("vid").alias("a"), F.max("vid").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.union(known.select("doc_id", F.col("vid").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b"))
    labels = components(links)
    named = labels.join(reps.select(F.col("vid").alias("v"), "rep"), "v")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "label").select(F.col("v").alias("vid"), "component_id")
    classes = stored(reps.select("vid", "rep").join(found, "vid", "left").select("vid", F.coalesce("component_id", "rep").alias("of")), "groups")
    out = signed.select("doc_id", "n", "vid").join(classes, "vid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near_groups(): the one of the smallest doc_id, with all columns.

    Of rows that share a kept doc_id one stays; rows without a doc_id all stay.
    """
    groups = stored(near_groups(docs, n, percent).where("doc_id is not null").select("doc_id", "kept"), "kept")
    gone = groups.where("not kept").select("doc_id").distinct()
    few = gone.count() <= MOST_BROADCAST
    stay = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(groups.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    times = repeated.count()
    if not times:
        return stay
    repeated = F.broadcast(repeated) if times <= MOST_BROADCAST else repeated
    once = stay.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(stay.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
