"""Token counts by a linear longest-match automaton.

The vocabulary's trie has a failure link per node: where no child fits, the
longest pieces that are certain by then are popped, and matching goes on from the
node of what is left.  Only the number of popped pieces is kept, so the greedy
count of a word needs one step per byte and builds no piece.  Distinct words of a
slice of texts run through the automaton side by side.

A word is a run of bytes other than ASCII white space, with a blank before it;
pieces that begin with the blank start words, all others continue them.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import words as W
from framewright.llm.store import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text whose distinct words are counted at once; words beyond this length go one by one.
SLICE, LONG = 1 << 22, 256


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file (a base 64 piece and its rank on each line), read by the driver."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie edges as a hash table of (node, byte); failure link and popped pieces by node; -1: none."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    final.append(False)
                at = children[at][c]
            final[at] = at != 0
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and c not in children[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = children[z][c], n
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        edges = [(u << 8 | c, v) for u, own in enumerate(children) for c, v in own.items()]
        self._index(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _index(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        self.bits = max(8, int(len(keys)).bit_length() + 2)
        self.keys, self.nodes, self.probes = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32), 0
        rest = np.arange(len(keys))
        while len(rest):
            slot = self._slot(keys[rest]) + self.probes
            free = self.keys[slot] < 0
            at, which = np.unique(slot[free], return_index=True)
            chosen = rest[free][which]
            self.keys[at], self.nodes[at] = keys[chosen], nodes[chosen]
            rest = np.setdiff1d(rest, chosen, assume_unique=True)
            self.probes += 1

    def child(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | c
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.nodes[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for p in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + p
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.nodes[at[hit]]
            open_ = open_[~hit]
        return out

    def counts(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of each word of buf; a word that no pieces make up counts as one."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n = len(starts)
        state, count, lost = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(-1, int(lengths[0]) if n else -1):
            live = int(np.searchsorted(-lengths, -j, "left"))  # words longer than j
            todo = np.arange(live)
            c = np.full(live, 0x20, np.int64) if j < 0 else buf[starts[:live] + j].astype(np.int64)
            while len(todo):
                to = self.child(state[todo], c[todo])
                ok = to >= 0
                state[todo[ok]] = to[ok]
                todo = todo[~ok]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
                gone = state[todo] < 0
                lost[todo[gone]] = True
                state[todo[gone]] = 0
                todo = todo[~gone]
        todo = np.flatnonzero(state > 0)
        while len(todo):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            lost[todo[state[todo] < 0]] = True
            todo = todo[state[todo] > 0]
        out = np.empty(n, np.int64)
        out[order] = np.where(lost, 1, count)
        return out


def _counter(shared):
    def run(batches):
        machine: Automaton = shared.value
        for batch in batches:
            buf, off = W.texts(batch.column(1))
            for a, b in W.slices(off, SLICE):
                own = buf[off[a] : off[b]]
                starts, ends, first = W.spans(own, off[a : b + 1] - off[a], W.SPACED)
                _, one, which = np.unique(W.hashes(own, starts, ends, lower=False), return_index=True, return_inverse=True)
                begin, length = starts[one], ends[one] - starts[one]
                pieces = np.zeros(len(one), np.int64)
                for part in (length <= LONG, length > LONG):
                    pieces[part] = machine.counts(own, begin[part], length[part])
                total = np.concatenate([[0], np.cumsum(pieces[which])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, n_words, n_tokens (both long) by greedy longest match over the pieces at path.

    Null, empty and blank texts have 0 of both; a text is counted whole, whatever
    its length; repeated rows get equal rows; other columns are ignored; no rows
    give no rows.  The automaton is of the size of the vocabulary, which is fixed.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(path)))
    rows = docs.select("doc_id", "text")
    zero = F.lit(0).cast("long")
    return rows.mapInArrow(W.released(_counter(shared)), rows.select("doc_id", zero.alias("n_words"), zero.alias("n_tokens")).schema)
