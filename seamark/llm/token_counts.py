"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., "Fast WordPiece
Tokenization"). Where no child fits, the longest pieces that the automaton has
read are *popped*: their number is precomputed for each node, and the failure
link leads to the node of what remains. A word is read once, in time linear in
its length, and no piece is ever built.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import text_slices

#: A word is read with this byte before it, as in vocabularies that mark word starts by a blank.
START = b" "


class LongestMatch:
    """Counts of greedy longest-match pieces; the vocabulary must hold every single byte."""

    def __init__(self, pieces: list[bytes]):
        child: dict[int, int] = {}  # node * 256 + byte -> node
        parent, ends = [(0, 0)], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(ends)
                    parent.append((node, byte))
                    ends.append(False)
                node = nxt
            ends[node] = node != 0
        missing = [b for b in range(256) if not (child.get(b) and ends[child[b]])]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent is numbered before its children
            depth[v] = depth[parent[v][0]] + 1
        fail, pops = [0] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            u, byte = parent[v]
            if ends[v]:
                fail[v], pops[v] = 0, 1
                continue
            z, n = fail[u], pops[u]
            while (nxt := child.get(z << 8 | byte)) is None:
                n += pops[z]
                z = fail[z]
            fail[v], pops[v] = nxt, n
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = n = 0
        for byte in word:
            while (nxt := child.get(node << 8 | byte)) is None:
                n += pops[node]
                node = fail[node]
            node = nxt
        while node:
            n += pops[node]
            node = fail[node]
        return n


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class WordCounts(dict):
    """word -> pieces; a cache that is emptied when full."""

    LIMIT = 300_000

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self.automaton.count(START + word)
        if len(word) <= 64:
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    """One automaton and cache for a worker process."""
    return WordCounts(LongestMatch(read_ranks(path)))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_words, n_tokens``.

    ``n_tokens`` sums the greedy longest-match pieces of the text's words, each
    with a blank before it. Null or blank text: 0. Order, repeats and other
    columns don't matter; a map over rows, without a shuffle. ``vocabulary`` is
    the path of a ``.tiktoken`` file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary)
        for b, texts in text_slices(batches, "text"):
            split = [t.split() for t in texts]
            n = [sum(map(counts.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array(n, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long")
