"""Packing documents into token sequences of one width, with whole remainders where that fills a sequence.

A document gives full sequences and a remainder below the width. How often each
remainder length occurs is a histogram of fewer than ``WIDTH`` numbers. Shallow
combinations of lengths that fill a sequence exactly are its columns; how often
to use each is the non-negative least-squares solution against the histogram,
rounded down to what the histogram holds. The documents of a length are ranked
by prefix sums, and a rank finds its combination, so no group is gathered.
Remainders that no combination takes are packed greedily, many tasks side by
side: largest that fits first, then one is cut. What a task has left at its end
is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize, small
from .text import text_slices

WIDTH = 2048
#: Lengths from which combinations of three and of four are made: those that most documents have. What they leave is packed greedily.
THREES, FOURS = 96, 24
ROUNDS = 600
RESIDUAL_ROWS = 50_000


# ids


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class ChunkIds:
    """Bytes between two single blanks -> ids of the blank and those bytes, ``known``; emptied when full.

    A byte-level tokenizer's pieces never reach over a blank from left to right,
    so a text's ids are those of its chunks one after another, unless white space
    stands on both sides of a blank: such texts, and those that spell a special
    token, are encoded whole. The first chunk has no blank before it; its key
    ends with one.
    """

    LIMIT, GROUP = 1_600_000, 256
    AFTER = [b" " + w for w in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")]
    RUN = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tok.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    def whole(self, text: bytes) -> bool:
        """Must the text be encoded as one?"""
        if any(s in text for s in self.special):
            return True
        return (text.endswith(b" ") or any(a in text for a in self.AFTER)) and bool(self.RUN.search(text.decode()))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) + len(chunks) > self.LIMIT:
            self.known.clear()
        new = chunks.difference(self.known)
        alone = [c for c in new if not c or c[-1] == 32 or c[0] < 33 or (c[0] > 127 and c.decode()[0].isspace())]
        joined = list(new.difference(alone))
        groups = [joined[i : i + self.GROUP] for i in range(0, len(joined), self.GROUP)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, ids in zip(some, self._ids([(b" " + b" ".join(g)).decode() for g in some]), strict=True):
                ends = np.append(np.flatnonzero(self.blank[ids])[1:], len(ids))
                if len(ends) != len(group):
                    alone += group
                    continue
                raw, start, step = ids.tobytes(), 0, self.kind.itemsize
                for c, end in zip(group, (ends * step).tolist(), strict=True):
                    self.known[c] = raw[start:end]
                    start = end
        for c, ids in zip(alone, self._ids([c[:-1].decode() if c.endswith(b" ") else " " + c.decode() for c in alone]), strict=True):
            self.known[c] = ids.tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text in ``kind``."""
        split: list[list[bytes] | None] = []
        for t in texts:
            if not t or self.whole(t):
                split.append(None)
                continue
            parts = t.split(b" ")
            parts[0] += b" "
            split.append(parts)
        self.learn(set().union(*(p for p in split if p)))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) if p else (self._ids([t.decode()])[0].tobytes() if t else b"") for t, p in zip(texts, split, strict=True)]


@functools.lru_cache(maxsize=2)
def chunk_cache(path: str) -> ChunkIds:
    """One cache for a worker process, kept from task to task."""
    return ChunkIds(path)


ENCODED = "row long, doc_id long, part int, n long, rest int, place long, full_before long, ids binary"
ENCODED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("rest", pa.int32()), ("place", pa.int64()), ("full_before", pa.int64()), ("ids", pa.binary())])


def _encode(path: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_cache(path)
        end = b"" if end_id is None else np.array([end_id], cache.kind).tobytes()
        part, row, full = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(width, np.int64)
        for b, texts in text_slices(batches, "text"):
            out = []
            for doc_id, ids in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), (x + end for x in cache.encode(texts)), strict=True):
                n = len(ids) // cache.kind.itemsize
                out.append((part << 33 | row, doc_id, part, n, n % width, int(seen[n % width]), full, ids))
                row, full = row + 1, full + n // width
                seen[n % width] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENCODED_ARROW, strict=True)], schema=ENCODED_ARROW)

    return run


# the plan


def combinations(histogram: np.ndarray, threes: int = THREES, fours: int = FOURS) -> np.ndarray:
    """Lengths that fill a sequence exactly, four to a row, unused places the width: powers of two alone, all pairs, threes and fours of common lengths."""
    width = len(histogram)
    has = histogram > 0
    rows = [(1 << k,) for k in range(width.bit_length() - 1) if has[1 << k]]
    rows += [(a, width - a) for a in range(1, width // 2 + 1) if has[a] and has[width - a]]
    common = [int(x) for x in np.argsort(-histogram, kind="stable")[: max(threes, fours)] if has[x] and x]
    for k, most in ((3, threes), (4, fours)):
        for some in combinations_with_replacement(sorted(common[:most]), k - 1):
            last = width - sum(some)
            if last >= some[-1] and has[last]:
                rows.append((*some, last))
    out = np.full((len(rows), 4), width, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def repeats(histogram: np.ndarray, columns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Least squares: x >= 0 with the lengths of x combinations as near to the histogram as can be, by accelerated projected gradients."""
    width = len(histogram)
    if not len(columns):
        return np.zeros(0)
    flat = columns.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, columns.shape[1]), width + 1)[:width]

    def back(y: np.ndarray) -> np.ndarray:
        return np.append(y, 0.0)[columns].sum(1)

    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    h = histogram.astype(float)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(used(y) - h), 0)
        if (y - new) @ (new - x) > 0:
            t = 1.0  # the momentum points uphill: begin anew
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def whole_repeats(histogram: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` rounded to what the histogram holds; then each combination as often as what is left allows."""
    left = np.append(histogram, np.iinfo(np.int64).max)
    out = np.zeros(len(columns), np.int64)
    many = [np.unique(c, return_counts=True) for c in columns]
    for wish in (np.floor(x + 0.5).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):
        for j in np.argsort(-x, kind="stable"):
            which, times = many[j]
            k = min(int(wish[j]), int((left[which] // times).min()))
            if k > 0:
                out[j] += k
                left[which] -= k * times
                left[-1] = np.iinfo(np.int64).max
    return out


def _places(columns: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For each use of a combination's place: length, first rank, number, first sequence, offset; by length and rank."""
    taken = np.zeros(width, np.int64)
    out, sequence = [], 0
    for c, k in zip(columns.tolist(), x.tolist(), strict=True):
        offset = 0
        for length in c:
            if length < width and k:
                out.append((length, int(taken[length]), k, sequence, offset))
                taken[length] += k
                offset += length
        sequence += k
    out.sort()
    return tuple(np.array(a, np.int64) for a in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def _assign(places: tuple[np.ndarray, ...], base: int):
    """Rows ``row, rest, rank`` -> their sequence and offset; null where no combination takes them."""
    length, first, number, sequence, offset = places
    keys = (length << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, rank = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            at = np.searchsorted(keys, (rest << 44) + rank, side="right") - 1
            k = np.maximum(at, 0)
            ok = (at >= 0) & (length[k] == rest) & (rank - first[k] < number[k]) if len(keys) else np.zeros(len(rest), bool)
            got = (base + sequence[k] + rank - first[k], offset[k]) if len(keys) else (rank, rank)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got[0], mask=~ok), pa.array(got[1].astype(np.int32), mask=~ok)], names=["row", "rest", "sequence_id", "offset"])

    return run


def pack_rest(pieces: list[tuple[int, int, int]], width: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], int, list[tuple[int, int, int]]]:
    """Greedy packing of ``(row, start, length)``: placed ``(row, start, length, sequence, offset)``, sequences used, pieces left.

    A sequence takes the longest piece, then again and again the longest that
    fits; if none fits, the shortest is cut. What cannot fill a sequence is left
    or, if this is the ``last`` call, cut into sequences of powers of two.
    """
    by_length: dict[int, list[tuple[int, int]]] = {}
    total = 0
    for row, start, n in pieces:
        by_length.setdefault(n, []).append((row, start))
        total += n
    lengths = sorted(by_length)
    out, sequence = [], 0

    def take(i: int) -> tuple[int, int, int]:
        n = lengths[i]
        row, start = by_length[n].pop()
        if not by_length[n]:
            del by_length[n], lengths[i]
        return row, start, n

    def put(row: int, start: int, n: int) -> None:
        if n not in by_length:
            bisect.insort(lengths, n)
            by_length[n] = []
        by_length[n].append((row, start))

    while total >= (1 if last else width):
        size = min(width, 1 << (total.bit_length() - 1))
        total -= size
        offset = 0
        while offset < size:
            i = bisect.bisect_right(lengths, size - offset) - 1
            row, start, n = take(max(i, 0))
            fits = min(n, size - offset)
            out.append((row, start, fits, sequence, offset))
            if fits < n:
                put(row, start + fits, n - fits)
            offset += fits
        sequence += 1
    return out, sequence, [(row, start, n) for n, some in by_length.items() for row, start in some]


def _pack(width: int, base: int):
    schema = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = base + (TaskContext.get().partitionId() << 40)
        held: list[tuple[int, int, int]] = []

        def some(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            placed, sequences, held = pack_rest(held, width, last)
            if placed:
                row, start, n, sequence, offset = zip(*placed, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((row, start, n, [first + s for s in sequence], offset), schema, strict=True)], schema=schema)
            first += sequences

        for b in batches:
            held += zip(b.column(0).to_pylist(), [0] * b.num_rows, b.column(1).to_pylist(), strict=True)
            if len(held) >= RESIDUAL_ROWS:
                yield from some(False)
        yield from some(True)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(kind: str, width: int):
    """Pieces of each document from its ids: full sequences first, then its remainder's."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out = []
            for i in range(b.num_rows):
                n, doc_id, first = column["n"][i].as_py(), column["doc_id"][i].as_py(), column["first_full"][i].as_py()
                raw = memoryview(np.frombuffer(column["ids"][i].as_buffer(), kind).astype("<u4").tobytes())
                full = n // width
                places = [(k * width, width, first + k, 0) for k in range(full)]
                places += [(full * width + p["start"], p["length"], p["sequence_id"], p["offset"]) for p in column["pieces"][i].as_py() or ()]
                out += [(doc_id, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n, sequence, offset) for s, m, sequence, offset in places]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each id of each document, its end id included, lies in one piece. Sequences
    hold ``width`` ids (a power of two), or fewer if their number is a power of
    two, so none needs padding; only the last remainders of a task make such short
    ones. Sequence ids are unique, not dense.

    Null text: the end id alone. Null and repeated document ids are rows of their
    own. A very long text is one row of ids and many full sequences. Without an
    end id, empty texts give no piece. Empty table: no rows.
    """
    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    encoded = materialize(rows.mapInArrow(_encode(tokenizer_path, end_id, width), ENCODED), "packing-ids")
    counts = materialize(encoded.groupBy("part", "rest").agg(F.count("*").alias("k"), F.sum(F.floor(F.col("n") / width)).alias("full")), "packing-counts")
    # fewer numbers than the width
    found = {r["rest"]: (r["k"], r["full"]) for r in counts.groupBy("rest").agg(F.sum("k").alias("k"), F.sum("full").alias("full")).collect()}
    histogram = np.array([found.get(r, (0, 0))[0] if r else 0 for r in range(width)], np.int64)
    fulls = sum(full for _, full in found.values())
    columns = combinations(histogram)
    x = whole_repeats(histogram, columns, repeats(histogram, columns))
    places = _places(columns, x, width)
    residual = int(histogram.sum() - places[2].sum())
    # ranks: by part before, then by place within the part
    before = counts.select("part", "rest", (F.sum("k").over(Window.partitionBy("rest").orderBy("part")) - F.col("k")).alias("before"))
    ranked = encoded.where("rest > 0").select("row", "part", "rest", "place").join(before.hint("merge"), ["part", "rest"]).select("row", "rest", (F.col("before") + F.col("place")).alias("rank"))
    placed = materialize(ranked.mapInArrow(_assign(places, fulls), "row long, rest int, sequence_id long, offset int"), "packing-placed")
    taken = placed.where("sequence_id is not null").select("row", F.lit(0).alias("start"), F.col("rest").alias("length"), "sequence_id", "offset")
    left = placed.where("sequence_id is null").select("row", "rest").repartition(max(1, -(-residual // RESIDUAL_ROWS)), "row").sortWithinPartitions("row")
    packed = left.mapInArrow(_pack(width, fulls + int(x.sum())), "row long, start int, length int, sequence_id long, offset int")
    pieces = taken.union(packed).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # at most a remainder's ids
    parts = counts.groupBy("part").agg(F.sum("full").alias("full")).select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("full_parts"))  # a row for each task
    whole = encoded.join(pieces, "row", "left").join(small(materialize(parts, "packing-parts")), "part")
    whole = whole.select("doc_id", "n", (F.col("full_parts") + F.col("full_before")).alias("first_full"), "pieces", "ids")
    out = materialize(whole.mapInArrow(_cut(str(chunk_cache(tokenizer_path).kind.str), width), PIECES), "packing")
    drop(encoded, counts, placed)
    return out
