"""Masked pseudo-likelihood of documents by a bidirectional window network in numpy.

Every token is predicted from the two tokens on either side; a document's score
is the sum of the log-probabilities of its words.

1. Word counts of the whole corpus give the vocabulary: the commonest words are
   tokens of their own, all others share one.
2. The texts, as token numbers of two bytes, are dealt by a hash of the row into
   shards of about SHARD_TOKENS.  In each round every shard trains a copy of the
   network on its positions in a fixed order (the rounds together take each
   position once), and the copies are averaged in order of shards: the network
   depends on the rows alone, not on how they are split, and a larger corpus has
   more shards of the same size.
3. The softmax is in two levels, a group of tokens and the token in its group.
   Words without a token share the probability of OTHER by their corpus counts.
4. What a rare word has on its two sides is remembered over the whole corpus: the
   network's share of the word is mixed with how often other documents have the
   word between the same neighbours.  A document never counts for itself.

What is gathered (counts, shards, remembered windows) grows with the corpus; what
is broadcast (the network, NAMED words, 2^18 cells of counts) does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import small_batches, stored

#: Groups of words in the softmax and words in each; units; rounds of training.
GROUPS, MEMBERS, UNITS, ROUNDS = 32, 128, 16, 2
WORDS = GROUPS * MEMBERS
#: The token, and group of its own, of all other words; the token that stands beyond the edges of a text.
OTHER, EDGE = WORDS, WORDS + 1
#: Words whose counts are broadcast at most; the count up to which a word is rare; bits of the cells that count the others.
NAMED, RARE, CELL_BITS = 131_072, 64, 18
#: Offsets of the window, positions of a training step, its size, positions scored at once, tokens of a shard about.
WINDOW, STEP_ROWS, RATE, CHUNK, SHARD_TOKENS = (-2, -1, 1, 2), 4096, 0.3, 4096, 2_000_000
#: Copies of the network that are summed in one place.
MERGE = 64
#: Weight of the network's share of a rare word against remembered windows.
PRIOR = 2.0
_SHAPES = (("inner", (len(WINDOW), EDGE + 1, UNITS)), ("top", (UNITS, GROUPS + 1)), ("top_bias", (GROUPS + 1,)), ("outer", (GROUPS, UNITS, MEMBERS)), ("bias", (GROUPS, MEMBERS)))
_SIZE = sum(math.prod(s) for _, s in _SHAPES)


def _exponents(z: np.ndarray, bounded: bool) -> np.ndarray:
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _at(e: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of each row's own share of its exponents."""
    return np.log(e[np.arange(len(e)), own] / (e @ np.ones(e.shape[1], np.float32)))


def _errors(e: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """The gradient of the mean loss over so many rows: probabilities, less 1 at the own token."""
    e *= (1 / (rows * (e @ np.ones(e.shape[1], np.float32))))[:, None]
    e[np.arange(len(e)), own] -= np.float32(1 / rows)
    return e


def _sorted(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of the words in order of their groups, and for each group its part of them."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
    return order[: cuts[-1]], [(g, slice(cuts[g], cuts[g + 1])) for g in range(GROUPS) if cuts[g] < cuts[g + 1]]


class Network:
    """Window embeddings summed, tanh, a softmax over groups and one over the tokens of the group."""

    def __init__(self, data: np.ndarray):
        self.data, at = data, 0
        for name, shape in _SHAPES:
            size = math.prod(shape)
            setattr(self, name, data[at : at + size].reshape(shape))
            at += size

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """A network that starts from the tokens' frequencies."""
        net = cls(np.random.default_rng(5).normal(0, 0.1, _SIZE).astype(np.float32))
        mass = (counts[:WORDS] + 1.0).reshape(GROUPS, MEMBERS)
        groups = np.append(mass.sum(1), counts[OTHER] + 1)
        net.top_bias[:] = np.log(groups / groups.sum())
        net.bias[:] = np.log(mass / mass.sum(1, keepdims=True))
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.inner[0][around[:, 0]]
        for k in range(1, len(WINDOW)):
            h += self.inner[k][around[:, k]]
        return np.tanh(h, out=h)

    def _bounded(self) -> bool:
        """Whether no exponent can overflow, as units lie within 1."""
        most = lambda weights, bias: float((np.abs(weights).sum(axis=-2) + np.abs(bias)).max())
        return max(most(self.top, self.top_bias), most(self.outer, self.bias)) < 60

    def _members(self, own: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """What the second level says of each word, whose hidden units stand in order of groups."""
        z = np.empty((len(own), MEMBERS), np.float32)
        for g, part in parts:
            np.matmul(own[part], self.outer[g], out=z[part])
            z[part] += self.bias[g]
        return z

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        out, bounded = np.empty(len(token)), self._bounded()
        for a in range(0, len(token), CHUNK):
            group, member = np.divmod(token[a : a + CHUNK], MEMBERS)
            h = self.hidden(around[a : a + CHUNK])
            logs = _at(_exponents(h @ self.top + self.top_bias, bounded), group).astype(np.float64)
            order, parts = _sorted(group)
            logs[order] += _at(_exponents(self._members(h[order], parts), bounded), member[order])
            out[a : a + CHUNK] = logs
        return out

    def train(self, around: np.ndarray, token: np.ndarray, seen: Network) -> None:
        """One step of adaptive gradient descent; seen holds the sums of squares, in the same shape."""
        n, bounded = len(token), self._bounded()
        group, member = np.divmod(token, MEMBERS)
        h = self.hidden(around)
        g1 = _errors(_exponents(h @ self.top + self.top_bias, bounded), group, n)
        back = g1 @ self.top.T
        order, parts = _sorted(group)
        own = h[order]
        g2 = _errors(_exponents(self._members(own, parts), bounded), member[order], n)
        down, outer, bias = np.empty_like(own), np.zeros_like(self.outer), np.zeros_like(self.bias)
        for g, part in parts:
            np.matmul(g2[part], self.outer[g].T, out=down[part])
            np.matmul(own[part].T, g2[part], out=outer[g])
            np.matmul(np.ones(part.stop - part.start, np.float32), g2[part], out=bias[g])
        back[order] += down
        back *= 1 - h * h
        for part, grad, sum_ in ((self.top, h.T @ g1, seen.top), (self.top_bias, g1.sum(axis=0), seen.top_bias), (self.outer, outer, seen.outer), (self.bias, bias, seen.bias)):
            sum_ += grad * grad
            part -= RATE * grad / (np.sqrt(sum_) + 1e-6)
        # of the embeddings only those in the windows change: their gradients are summed over equal tokens
        for k in range(len(WINDOW)):
            at = around[:, k].astype(np.uint16)
            order = np.argsort(at, kind="stable")
            at = at[order]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            grad, at = np.add.reduceat(back[order], begin, axis=0), at[begin]
            sum_ = seen.inner[k][at] + grad * grad
            seen.inner[k][at] = sum_
            self.inner[k][at] -= RATE * grad / (np.sqrt(sum_) + 1e-6)


@dataclass
class Model:
    """The words that are tokens and those whose counts are known, in order of their hashes, the cells that count all others, and the network.

    share: log of a known word's part of OTHER; cell_share: the same for a word of
    each cell; rare_share: log of the part of OTHER that is rare words; counts: of
    the tokens.
    """

    top_hashes: np.ndarray
    top_tokens: np.ndarray
    hashes: np.ndarray
    share: np.ndarray
    rare: np.ndarray
    cell_share: np.ndarray
    rare_share: float
    counts: np.ndarray
    weights: np.ndarray

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """The token of each word hash."""
        return _found(self.top_hashes, self.top_tokens, h, OTHER)

    def shares(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log share and rarity of each word hash."""
        share, rare = np.zeros(len(h)), np.zeros(len(h), bool)
        others = np.flatnonzero(token == OTHER)
        h = h[others]
        place = _found(self.hashes, np.arange(len(self.hashes), dtype=np.int32), h, -1)
        named = place >= 0
        share[others] = np.where(named, self.share[place] if len(self.share) else 0, self.cell_share[h >> np.uint64(64 - CELL_BITS)])
        rare[others] = ~named | (self.rare[place] if len(self.rare) else True)
        return share, rare


def _found(hashes: np.ndarray, values: np.ndarray, h: np.ndarray, otherwise: int) -> np.ndarray:
    """The value of each hash in a sorted table."""
    if not len(hashes):
        return np.full(len(h), otherwise, np.int32)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, values[at], np.int32(otherwise))


def _word_slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and the rows' offsets in them, slice by slice."""
    buf, off = W.texts(column)
    for a, b in W.slices(off):
        own = buf[off[a] : off[b]]
        starts, ends, first = W.spans(own, off[a : b + 1] - off[a], W.SPACED)
        yield a, W.hashes(own, starts, ends), first


def _stream(values: np.ndarray, first: np.ndarray, edge) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values with two edges before and after each row, and where the values stand."""
    rows = len(first) - 1
    at = np.arange(len(values)) + 2 * np.repeat(np.arange(1, rows + 1), np.diff(first))
    out = np.full(len(values) + 2 * rows + 2, edge, values.dtype)
    out[at] = values
    return out, at


def _windows(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([stream[at + d] for d in WINDOW], axis=1)


def _count(batches):
    """Word hashes with their counts, summed over a task as far as 2 million of them go; new ones are merged when they are as many as the old."""
    h, n, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merged():
        every, inverse = np.unique(np.concatenate([h, *(x for x, _ in new)]), return_inverse=True)
        return every, np.bincount(inverse, np.concatenate([n, *(c for _, c in new)]), len(every)).astype(np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    for batch in batches:
        for _, own, _ in _word_slices(batch.column(0)):
            new.append(np.unique(own, return_counts=True))
            if sum(len(x) for x, _ in new) > max(len(h), 1 << 19):
                h, n = merged()
                new = []
            if len(h) > 2_000_000:
                yield out()
                h, n = h[:0], n[:0]
    h, n = merged()
    yield out()


def vocabulary(docs: DataFrame) -> Model:
    """The words of all texts with an untrained network.

    As many words as NAMED allows have counts of their own, in order of counts;
    words of one count (to three digits) have them together or not at all.
    """
    counts = stored(docs.select("text").mapInArrow(W.released(_count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10("n")) - 2))
    sizes = counts.groupBy((F.floor(F.col("n") / step) * step).cast("long").alias("least")).agg(F.count("*").alias("words"))
    least, words = 1 << 62, 0
    for r in sizes.orderBy(F.desc("least")).collect():  # about 900 counts for each power of ten
        words += r["words"]
        if words > NAMED:
            break
        least = r["least"]
    named = counts.where(F.col("n") >= least).toArrow()
    h, n = named.column("hash").to_numpy().view(np.uint64), named.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    token = np.minimum(np.arange(len(h)), OTHER).astype(np.int32)
    others = counts.where(F.col("n") < least)
    cells = others.groupBy(F.shiftrightunsigned("hash", 64 - CELL_BITS).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    at, in_cell, different = (cells.column(c).to_numpy() for c in ("cell", "n", "words"))
    totals = np.bincount(token, n, OTHER + 1)
    totals[OTHER] += in_cell.sum()
    every = max(totals[OTHER], 1)
    cell_share = np.full(1 << CELL_BITS, -np.log(every + 1))
    cell_share[at] = np.log(in_cell / different / every)
    top, known, low = h[:WORDS], h[WORDS:], n[WORDS:] <= RARE
    rare_share = float(np.log(max(n[WORDS:][low].sum() + in_cell.sum(), 1) / every))
    by_top, by_hash = np.argsort(top), np.argsort(known)
    share = np.log(n[WORDS:] / every)[by_hash].astype(np.float32)
    return Model(top[by_top], by_top.astype(np.int32), known[by_hash], share, low[by_hash], cell_share.astype(np.float32), rare_share, totals, Network.fresh(totals).data)


def _encoder(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            for a, h, first in _word_slices(batch.column(1)):
                rows = len(first) - 1
                stream, _ = _stream(model.tokens(h).astype(np.uint16), first, EDGE)
                cut = first + 2 * np.arange(rows + 1) + 2
                keep = np.flatnonzero(np.diff(first))
                blobs = [stream[cut[r] - 2 : cut[r + 1] - 2].tobytes() for r in keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows).take(pa.array(keep)), pa.array(blobs, pa.binary())], names=["key", "tokens"])

    return run


class Learner:
    """Trains a copy of the network on a stream of texts, STEP_ROWS positions at a time, wherever the texts end.

    A round takes every ROUNDS-th place of the stream, from the turn-th on, so
    that all rounds together take each position once.
    """

    def __init__(self, weights: np.ndarray, turn: int):
        self.net, self.seen, self.turn = Network(weights.copy()), Network(np.full(_SIZE, 1e-3, np.float32)), turn
        # what is left of the stream, how much of it was left behind, the next place in it, positions taken
        self.stream, self.behind, self.at, self.total = np.zeros(0, np.int32), 0, 0, 0

    def add(self, texts: list[np.ndarray], last: bool = False) -> None:
        """Texts with two edges before each; with last, what is left is taken as well."""
        edges = [np.full(2, EDGE, np.int32)] if last else []
        self.stream = np.concatenate([self.stream, *texts, *edges])
        at = np.flatnonzero(self.stream[: max(len(self.stream) - 2, 0)] != EDGE)
        at = at[(at >= max(self.at, 2)) & ((at + self.behind) % ROUNDS == self.turn)]
        end = len(at) if last else len(at) // STEP_ROWS * STEP_ROWS
        for a in range(0, end, STEP_ROWS):
            p = at[a : min(a + STEP_ROWS, end)]
            self.net.train(_windows(self.stream, p), self.stream[p], self.seen)
        self.total += end
        if end:
            self.at = int(at[end - 1]) + 1
        begin = max(self.at - 2, 0)
        self.stream, self.behind, self.at = self.stream[begin:], self.behind + begin, self.at - begin


def _trainer(shared, turn: int):
    def run(batches):
        learner, at = None, None

        def done():
            learner.add([], last=True)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([learner.total]), pa.array([learner.net.data.tobytes()], pa.binary())], names=["shard", "n", "weights"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if shards[a] != at:
                    if learner:
                        yield done()
                    learner, at = Learner(shared.value, turn), int(shards[a])
                learner.add([np.frombuffer(x.as_buffer(), np.uint16).astype(np.int32) for x in batch.column("tokens").slice(a, b - a)])
        if learner:
            yield done()

    return run


def _sum(batches):
    """Weighted sums of the copies of each group, which come in order of group and shard."""
    at, total, data = None, 0, None
    kind = ["shard", "n", "weights"]

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total]), pa.array([(data / total).astype(np.float32).tobytes()], pa.binary())], names=kind)

    for batch in batches:
        for group, n, blob in zip(batch.column("group").to_pylist(), batch.column("n").to_pylist(), batch.column("weights"), strict=True):
            x = np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64) * n
            if group != at:
                if data is not None:
                    yield out()
                at, total, data = group, n, x
            else:
                total, data = total + n, data + x
    if data is not None:
        yield out()


def _averaged(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The average of all copies, MERGE at a time in order of shards, level by level; equal copies give equal averages."""
    while True:
        shards = -(-shards // MERGE)
        groups = copies.withColumn("group", F.floor(F.col("shard") / MERGE)).repartition(shards, "group").sortWithinPartitions("group", "shard")
        copies = groups.mapInArrow(_sum, "shard long, n long, weights binary")
        if shards == 1:
            got = copies.collect()
            return np.frombuffer(got[0]["weights"], np.float32).copy() if got else None
        copies = stored(copies, "copies")


def train(docs: DataFrame) -> Model:
    """The vocabulary and the network learnt from all positions of all texts ``(doc_id, text)``.

    Null, empty and blank texts and tables without words teach nothing; a null
    doc_id is a row like others; the order and the split of the rows don't count;
    rows that are equal in both columns may stand for one another; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = vocabulary(docs)
    shards = max(1, -(-int(model.counts.sum()) // SHARD_TOKENS))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    encoded = rows.mapInArrow(W.released(_encoder(spark.sparkContext.broadcast(model))), "key long, tokens binary")
    numbered = stored(encoded.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "tokens"), "shards")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.weights)
        copies = numbered.repartition(shards, "shard").sortWithinPartitions("shard", "key", "tokens").select("shard", "tokens").mapInArrow(W.released(_trainer(shared, turn)), "shard long, n long, weights binary")
        got = _averaged(copies, shards)
        shared.destroy()
        if got is not None:
            model.weights = got
    return model


def _remembered(h: np.ndarray, first: np.ndarray, part: np.ndarray, rare: np.ndarray):
    """Row, window and word-in-window hashes, log share, count in the row of the word in the window, and of the window, of rare words."""
    stream, at = _stream(h, first, np.uint64(0))
    row, at = np.repeat(np.arange(len(first) - 1), np.diff(first))[rare], at[rare]
    with np.errstate(over="ignore"):
        window = W.mix(stream[at - 1] * W.SALTS[20] + stream[at + 1] * W.SALTS[21])
        pair = W.mix(window + h[rare] * W.SALTS[23])
        in_row = row.astype(np.uint64) * W.SALTS[24]
        _, of_window, n_window = np.unique(W.mix(window + in_row), return_inverse=True, return_counts=True)
        _, place, n_pair = np.unique(W.mix(pair + in_row), return_index=True, return_counts=True)
    return row[place], window[place].view(np.int64), pair[place].view(np.int64), part[rare][place], n_pair, n_window[of_window[place]]


def _scorer(shared):
    def run(batches):
        model: Model = shared.value
        net = Network(model.weights)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, h, first in _word_slices(batch.column(1)):
                rows = len(first) - 1
                token = model.tokens(h)
                share, rare = model.shares(h, token)
                stream, at = _stream(token, first, EDGE)
                logs = share.copy()
                for c in range(0, len(token), 1 << 16):
                    logs[c : c + (1 << 16)] += net.log_probability(_windows(stream, at[c : c + (1 << 16)]), token[c : c + (1 << 16)])
                row = np.repeat(np.arange(rows), np.diff(first))
                ids = batch.column(0).slice(a, rows)
                yield _scored(number + np.arange(rows), ids, np.diff(first), np.bincount(row, logs, rows))
                if rare.any():
                    r, window, pair, part, n, own = _remembered(h, first, share - model.rare_share, rare)
                    yield _scored(number + r, pa.nulls(len(r), ids.type), None, None, window, pair, part, n, own)
                number += rows

    return run


def _scored(number, ids, *columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    columns = [pa.nulls(len(number), k) if c is None else pa.array(c, k) for c, k in zip([*columns, *[None] * (7 - len(columns))], kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(number), ids, *columns], names=["number", "doc_id", "n_tokens", "base", "window", "pair", "part", "n", "own"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, n_tokens (long), log_likelihood (the sum over all words) and mean_log_likelihood.

    Windows of rare words are those of docs.  Null, empty and blank texts have 0
    tokens, a sum of 0 and a null mean; texts are scored whole; each row is a
    document, repeated rows too, and those get equal scores; other columns are
    ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"number long, doc_id {kind}, n_tokens long, base double, window long, pair long, part double, n long, own long"
    scored = stored(docs.select("doc_id", "text").mapInArrow(W.released(_scorer(shared)), schema), "scored")
    rows = scored.where("window is not null").select("number", "window", "pair", "part", "n", "own")
    # windows that several documents have
    windows = rows.groupBy("window").agg(F.sum("n").alias("all"), F.max("own").alias("most")).where(F.col("all") > F.col("most")).select("window", "all")
    near = stored(rows.join(windows, "window").drop("window"), "near")
    pairs = near.groupBy("pair").agg(F.sum("n").alias("times"))
    mixed = (F.col("times") - F.col("n") + PRIOR * F.exp("part")) / (F.col("all") - F.col("own") + PRIOR)
    gain = F.col("n") * (F.log(mixed) - F.col("part"))
    # whole millionths: sums don't depend on their order
    gains = near.join(stored(pairs, "pairs"), "pair").groupBy("number").agg(F.sum(F.round(gain * 1e6).cast("long")).alias("gain"))
    found = scored.where("window is null").select("number", "doc_id", "n_tokens", "base").join(gains, "number", "left")
    total = F.when(F.col("n_tokens") > 0, F.round(F.col("base") + F.coalesce(F.col("gain") / 1e6, F.lit(0.0)), 6)).otherwise(0.0)
    return found.select("doc_id", "n_tokens", total.alias("log_likelihood")).withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))
