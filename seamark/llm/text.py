"""Word and shingle helpers shared by the text operators; they run inside Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` on UTF-8 cuts at exactly these
six ASCII characters, and ``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Odd multipliers, one for each place in a shingle (rule: splitmix64 of the place).
MAX_PLACES = 16


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


PLACES = splitmix(np.arange(1, MAX_PLACES + 1, dtype=U64)) | U64(1)


class WordHashes(dict):
    """word bytes -> 64-bit hash; a cache of bounded size (it is emptied when full)."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each k-word window; fewer words than k: the whole sequence as one; none: empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(n, k)
    with np.errstate(over="ignore"):
        acc = np.full(n - w + 1, w, U64)
        for j in range(w):
            acc += hashes[j : n - w + 1 + j] * PLACES[j % MAX_PLACES] + U64(j)
    return splitmix(acc)


def text_slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each, and their texts as UTF-8, null as empty.

    Spark already limits a batch's bytes; the slices keep the Python objects made
    from it small. One text longer than ``most`` is a slice of its own.
    """
    for b in batches:
        column = b.column(b.schema.get_field_index(name)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most, prepend=0))
        ends = [*(int(c) for c in cuts if c), b.num_rows]
        at = 0
        for end in ends:
            if end > at:
                part = b.slice(at, end - at)
                yield part, [t or b"" for t in column.slice(at, end - at).to_pylist()]
            at = end


def offsets(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int64)
