"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of the test items is a seed. One scan over the documents finds
seed hits, groups them along diagonals into windows and aligns each with its
item word by word, so no text is shuffled; a high local score finds edited and
paraphrased copies too. A window is left out only if the words it shares with
the item, however ordered, are too few for the least score. So the verdict on a
document depends on it and the item alone, not on what else the corpus holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import U64, WordHashes, shingle_hashes, text_slices

SEED_WORDS = 4
#: Words of test items whose seeds are broadcast at once; more items go in further scans.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the best possible score from which a document counts as contaminated, and words matched at least (all words of a shorter item).
LEAST_SCORE, LEAST_WORDS = 0.5, 6
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
FILTER_BITS = 22
#: Words of distinct windows remembered in a task with their alignments; when full, it begins anew.
REMEMBERED = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    text = text.lower() if text.isascii() else text.decode().lower().encode()
    return _WORD.findall(text)


class Seeds:
    """Sorted seed hashes of a block of items, with the items and places that have them."""

    def __init__(self, items: list[tuple[int, bytes]]):
        cache = WordHashes()
        self.words = [words_of(t) for _, t in items]
        self.ids = [i for i, _ in items]
        #: For each item its distinct word hashes, sorted, and how often it has them.
        self.bags = [np.unique(cache.of(w), return_counts=True) for w in self.words]
        h, item, place = [], [], []
        for k, w in enumerate(self.words):
            if len(w) >= SEED_WORDS:
                s = shingle_hashes(cache.of(w), SEED_WORDS)
                h.append(s)
                item.append(np.full(len(s), k))
                place.append(np.arange(len(s)))
        h = np.concatenate(h) if h else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.may = np.zeros(1 << FILTER_BITS, bool)
        self.may[self.h >> U64(64 - FILTER_BITS)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in the text, item, place in the item)`` of each hit."""
        at = np.flatnonzero(self.may[grams >> U64(64 - FILTER_BITS)])
        low = np.searchsorted(self.h, grams[at], "left")
        n = np.searchsorted(self.h, grams[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[k], self.place[k]

    def shared(self, item: int, hashes: np.ndarray) -> int:
        """How many words the item and these have in common, in any order: no alignment matches more."""
        h, n = self.bags[item]
        at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
        return int(np.minimum(np.bincount(at[h[at] == hashes], minlength=len(h)), n).sum())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers with a linear gap: ``(best score, start, end)`` within the window.

    A row is one vector step: the gap along the row is a running maximum.
    """
    n = len(window)
    steps = np.arange(n) * -GAP
    prev, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    places = np.arange(n)
    for w in item:
        diag = prev[:-1] + np.where(window == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        cell = np.maximum(np.maximum(diag, up), 0)
        source = np.where(cell == 0, places, np.where(diag >= up, begin[:-1], begin[1:]))
        lifted = cell + steps
        run = np.maximum.accumulate(lifted)
        # where the running maximum was last reached
        origin = np.maximum.accumulate(np.where(lifted == run, places, 0))
        cell = run - steps
        source = source[origin]
        prev = np.concatenate([[0], cell])
        begin = np.concatenate([[0], np.where(cell == 0, places + 1, source)])
        k = int(np.argmax(cell))
        if cell[k] > best[0]:
            best = (int(cell[k]), int(source[k]), k + 1)
    return best


def _compared(target: list[bytes], words: list[bytes]) -> tuple[float, int, int, int]:
    """``(score, words matched, start, end)`` of an item's best place in a window."""
    number: dict[bytes, int] = {}
    t = np.array([number.setdefault(w, len(number)) for w in target])
    w = np.array([number.get(x, -1) for x in words])
    best, start, end = align(t, w)
    return best / (MATCH * len(target)), int(np.isin(w[start:end], t).sum()), start, end


def _aligned(shared, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, cache = shared.value, WordHashes()
        known: dict[tuple[int, bytes], tuple[float, int, int, int]] = {}
        held = 0
        for b, texts in text_slices(batches, "text"):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), texts, strict=True):
                words = words_of(text)
                if len(words) < SEED_WORDS:
                    continue
                hashes = cache.of(words)
                at, item, place = seeds.hits(shingle_hashes(hashes, SEED_WORDS))
                if not len(at):
                    continue
                order = np.lexsort((at, item))
                at, item, place = at[order], item[order], place[order]
                size = np.array([len(seeds.words[i]) for i in item])
                # a new window at another item, or beyond the item's length from the hit before
                new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[1:])]))
                for s, e in zip(new, [*new[1:], len(at)], strict=True):
                    k, length = int(item[s]), int(size[s])
                    first = max(0, int((at[s:e] - place[s:e]).min()) - length // 2)
                    end = min(len(words), int((at[s:e] - place[s:e]).max()) + length + length // 2)
                    if seeds.shared(k, hashes[first:end]) / length < least_score:
                        continue
                    key = (k, b" ".join(words[first:end]))
                    if key not in known:
                        held += end - first
                        if held > REMEMBERED:
                            known.clear()
                            held = end - first
                        known[key] = _compared(seeds.words[k], words[first:end])
                    share, matched, start, stop = known[key]
                    if matched < min(LEAST_WORDS, length):
                        continue
                    out.append((doc, seeds.ids[k], share, matched, first + start, first + stop))
            if out:
                kinds = [b.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "item_id", "score", "n_matched", "start_word", "end_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and test item it holds: ``id_col, item_id, score, n_matched, start_word, end_word``.

    ``score`` is the local alignment score over the best possible for the item;
    words count from 0 in the document's lower-cased words. Rows with a null
    id can be found too. Null or empty texts on either side, and items of fewer
    than SEED_WORDS words, match nothing. Of repeated rows the best is given
    once for each id and item. Empty tables: no rows. Clean documents have none.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    n_words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = int(n_words // BLOCK_WORDS) + 1
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Seeds([(r["item_id"], r["text"].encode()) for r in block]))
        hit = rows.mapInArrow(_aligned(shared, least_score), f"id {kind}, item_id long, score double, n_matched long, start_word long, end_word long")
        part = materialize(hit.where(F.col("score") >= least_score), "aligned")
        found = part if found is None else found.union(part)
    best = F.max_by(F.struct("score", "n_matched", "start_word", "end_word"), F.struct("score", "n_matched", -F.col("start_word")))
    return found.groupBy("id", "item_id").agg(best.alias("b")).select(F.col("id").alias(id_col), "item_id", "b.*")
