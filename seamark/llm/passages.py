"""Substring dedup: paragraph MinHash banding, verified by exact Jaccard similarity.

Texts have no reliable paragraph marks, so a *paragraph* is content-defined: the
SPAN words around a place chosen by winnowing (the least hash of a word pair in
each run of WINNOW places; Schleimer et al., "Winnowing"). The same passage has
the same paragraphs wherever it stands, and no passage of LEAST_WORDS words is
without one. A paragraph's 5-word shingles give BANDS MinHash keys of one value
each, so two paragraphs at similarity 0.8 share a bucket with a chance of 0.96.

Each bucket's paragraphs are linked with its first. A link makes two texts a
candidate pair: the words around their linked paragraphs are aligned from a
shared shingle on, over gaps of up to JUMP words, and the longest stretches of
LEAST_WORDS words or more whose sets of 5-word shingles have an exact Jaccard
similarity of SIMILAR are passages. Where a bucket of three texts or more holds
a link that fails, or one near a passage's end, its texts are met again by
windows of LEAST_WORDS words around the paragraph: whoever shares so many words
exactly is found, whatever the first paragraph's text shares. Edited ones are met
by gapped keys, 32 words of 40 around the paragraph: in one task all mates of a
leading text that share one are compared, unless passages join them there already;
mates in different tasks (a text of more than MATES) are led anew by these keys,
once. Passages are clustered by components; all but the first of each are removed.

Nothing depends on how the rows are dealt: buckets are led by the least row key.

Scale: buckets are dealt by ranges of (key, row), so a bucket that holds a third
of the rows is spread over many tasks; each task streams its sorted rows, and
buckets that cross a border between tasks (two for each task at most) are led
anew through a broadcast table. A text is shuffled once, to the task that cuts
out the words around its links; these slices go to the text that leads them,
whose own slices are repeated for each thousand of its mates, so a leader of
millions is spread over many tasks. Every size takes this one way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import connected_components
from .store import drop, materialize, shuffle_width
from .text import U64, WordHashes, shingle_hashes, splitmix, text_slices

LEAST_WORDS, SIMILAR, SHINGLE = 50, 0.8, 5
SPAN, BANDS = 20, 2
#: Words that an alignment may skip on either side before the next common shingle.
JUMP = 12
#: Words taken on either side of a linked paragraph; mates of a text compared in one task; step of the windows.
AROUND, MATES, STEP = 64, 250, 2
#: Words by which extents of one text must overlap to be of one cluster.
MEET = 25
#: Words by which a covering extent may begin later.
NEAR = 10
#: Base of the windows' hash.
_BASE = 0x9E3779B97F4A7C15
#: Of a place whose words are met again: its link failed, the leading text's, or that of a text beside one whose link failed.
FAILED, LEADS, BESIDE = 0, 1, 2
#: Words of a block of the gapped keys, of which (words before the gap from the place on, how many, words of the gap).
BLOCK = 8
GAPPED = [(t * BLOCK, 4 * BLOCK, 0) for t in range(-3, 2)]
for _t in range(-3, 1):
    for _c in range(1, 4):
        GAPPED.append((_t * BLOCK, _c * BLOCK, BLOCK))
        if _t + _c <= 1:  # a word more in the gap moves what stands before it, or what follows; a place is told by the words in its middle
            GAPPED.append((_t * BLOCK - 1, _c * BLOCK, BLOCK + 1))
        if _t + _c >= 1:
            GAPPED.append((_t * BLOCK, _c * BLOCK, BLOCK + 1))
_LEFT, _WORDS, _GAP = np.array(GAPPED).T
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = splitmix(np.arange(2000, 2000 + BANDS, dtype=U64)) | U64(1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    w = 1
    while 2 * w <= width:
        values, w = np.minimum(values[:-w], values[w:]), 2 * w
    return values if w == width else np.minimum(values[: len(values) - (width - w)], values[width - w :])


def paragraphs(h: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, band keys)`` of the paragraphs of texts whose word hashes lie end to end; texts of fewer than ``least`` words have none.

    Places are picked by winnowing: of every ``least`` - SPAN neighbouring word pairs, the first with the least hash.
    """
    ends = np.cumsum(lengths)
    width = max(1, least - SPAN)
    texts = np.flatnonzero(lengths >= max(least, SPAN))
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS), U64)
    # the place in the low bits: of equal hashes the first is less
    bits = U64((1 << int(len(h)).bit_length()) - 1)
    least_of = _least((shingle_hashes(h, 2) & ~bits) | np.arange(len(h) - 1, dtype=U64), width) & bits
    windows = lengths[texts] - width
    text = np.repeat(texts, windows)
    begin = ends[texts] - lengths[texts]
    start = least_of[np.arange(len(text)) + np.repeat(begin - (np.cumsum(windows) - windows), windows)].astype(np.int64)
    keep = np.concatenate([[True], start[1:] != start[:-1]])
    text, start = text[keep], start[keep]
    begin = ends[text] - lengths[text]
    start = np.clip(start - SPAN // 2, begin, ends[text] - SPAN)
    keep = np.concatenate([[True], start[1:] != start[:-1]])
    text, start, begin = text[keep], start[keep], begin[keep]
    grams = shingle_hashes(h, SHINGLE)
    with np.errstate(over="ignore"):
        low = np.stack([_least(grams * m, SPAN - SHINGLE + 1)[start] for m in _MULTIPLIERS], 1)
    keys = splitmix(low + splitmix(np.arange(BANDS, dtype=U64)))
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (text[1:] != text[:-1])])  # one word over and over has one paragraph
    return text[new], (start - begin)[new], keys[new]


def _emit(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: WordHashes = WordHashes()
        for b, texts in text_slices(batches, "text", 1 << 20):
            words = [t.split() for t in texts]
            text, start, keys = paragraphs(cache.of([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64), least)
            out = [keys.T.ravel().view(np.int64), np.tile(b.column(0).to_numpy()[text], BANDS), np.tile(start.astype(np.int32), BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["bk", "k", "p"])

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, each with its bucket's first; as ``border`` the first rows of the first and the last bucket.

    ``wide`` marks rows from the third text of a bucket on.
    """

    def rows(bk, k, p, lk, lp, wide, border: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (bk, k, p, lk, lp, wide)] + [pa.array(np.full(len(bk), border))], names=["bk", "k", "p", "lk", "lp", "wide", "border"])

    head, last, texts = None, None, 0
    for b in batches:
        bk, k, p = (b.column(i).to_numpy() for i in range(3))
        if not len(bk):
            continue
        new = np.concatenate([[head is None or bk[0] != head[0]], bk[1:] != bk[:-1]])
        if head is None:
            yield rows(bk[:1], k[:1], p[:1], k[:1], p[:1], np.array([False]), True)
        at = np.maximum.accumulate(np.where(new, np.arange(len(bk)), -1))
        own = at >= 0
        lk, lp = (np.where(own, x[at], y) for x, y in zip((k, p), head[1:] if head else (0, 0), strict=True))
        other = new | np.concatenate([[k[0] != last], k[1:] != k[:-1]])
        nth = np.cumsum(other)
        nth = np.where(own, nth - nth[at] + 1, nth + texts)
        yield rows(bk[~new], k[~new], p[~new], lk[~new], lp[~new].astype(np.int32), nth[~new] > 2, False)
        head, last, texts = (bk[-1], lk[-1], lp[-1]), k[-1], int(nth[-1])
    if head is not None:
        bk, k, p = (np.array([x], t) for x, t in zip(head, (np.int64, np.int64, np.int32), strict=True))
        yield rows(bk, k, p, k, p, np.array([False]), True)


def linked(rows: DataFrame, key: str) -> DataFrame:
    """``k, p, lk, lp, wide``: each of ``rows (k, p)`` with the first row of its bucket, which is what has one ``key``; further places of the first text too."""
    dealt = rows.select(key, "k", "p").repartitionByRange(shuffle_width(rows.sparkSession), key, "k").sortWithinPartitions(key, "k", "p")
    streamed = materialize(dealt.mapInArrow(_stream, f"{key} long, k long, p int, lk long, lp int, wide boolean, border boolean"), "buckets")
    # at most two rows for each task: which buckets cross a border, and what leads them
    border = streamed.where("border").groupBy(key).agg(F.min(F.struct("k", "p")).alias("first"), F.count("*").alias("times")).where("times > 1")
    border = materialize(border.select(key, F.col("first.k").alias("fk"), F.col("first.p").alias("fp")), "borders")
    j = streamed.join(F.broadcast(border), key, "left").select("k", "p", F.coalesce("fk", "lk").alias("lk"), F.coalesce("fp", "lp").alias("lp"), (F.col("wide") | F.col("fk").isNotNull()).alias("wide"))
    out = materialize(j.where("k <> lk or p <> lp"), "links")
    drop(streamed, border)
    return out


#: Gaps on either side, the shortest first.
_GAPS = sorted(((x, y) for x in range(JUMP + 1) for y in range(JUMP + 1)), key=lambda g: (g[0] + g[1], g[0]))


def _blocks(a: list[int], b: list[int], ga: list[int], gb: list[int], i: int, j: int) -> list[tuple[int, int, int]]:
    """Equal runs ``(i, j, words)`` in order, from a common shingle at (i, j) on, over gaps of up to JUMP words."""
    out = []
    while True:
        n, size, step = min(len(a) - i, len(b) - j), 0, 16
        while size < n:
            x, y = i + size, j + size
            if (some := a[x : x + step]) == (others := b[y : y + step]):
                size, step = min(n, size + step), 2 * step
                continue
            if len(some) == len(others) == 1:
                break
            if step > 16:
                step = 16
                continue
            for w, v in zip(some, others, strict=False):
                if w != v:
                    break
                size += 1
            break
        if not size:
            return out
        out.append((i, j, size))
        i, j = i + size, j + size
        some, others = ga[i : i + JUMP + 1], gb[j : j + JUMP + 1]
        if not (both := set(some).intersection(others)):
            return out
        n, m = len(some), len(others)
        x, y = next((x, y) for x, y in _GAPS if x < n and y < m and some[x] in both and some[x] == others[y])
        i, j = i + x, j + y


def jaccard(a: list[int], b: list[int]) -> float:
    """Exact similarity of two sets of shingle hashes."""
    x, y = set(a), set(b)
    both = len(x & y)
    return both / max(1, len(x) + len(y) - both)


def _stretches(ga: list[int], gb: list[int], blocks: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int, int, float]]:
    """The passages of one alignment: the longest that is similar enough, then what lies before and after it.

    From block x to block y, shared >= SIMILAR * (mine + other - shared) is a
    difference of two prefix sums, so the first x of each y is a binary search.
    """
    (first_i, first_j, _), (last_i, last_j, last_n) = blocks[0], blocks[-1]
    if min(last_i - first_i, last_j - first_j) + last_n < least:
        return []
    if len(blocks) == 1:
        return [(first_i, first_i + last_n, first_j, first_j + last_n, 1.0)]
    out, todo = [], [(0, len(blocks))]
    i, j, n = (np.array(x) for x in zip(*blocks, strict=True))
    shared = np.cumsum(np.maximum(n - SHINGLE + 1, 0))
    upto = (1 + SIMILAR) * shared - SIMILAR * (i + j + 2 * n)
    before = (1 + SIMILAR) * np.concatenate([[0], shared[:-1]]) - SIMILAR * (i + j)
    while todo:
        low, high = todo.pop()
        if low >= high:
            continue
        y = np.arange(low, high)
        x = low + np.searchsorted(-np.minimum.accumulate(before[low:high]), -(upto[low:high] + 2 * SIMILAR * (SHINGLE - 1) + 1e-9))
        x = np.minimum(x, y)
        words = np.minimum(i[y] + n[y] - i[x], j[y] + n[y] - j[x])
        alone = low + int(np.argmax(n[low:high]))  # one equal run is always similar enough
        best = int(np.argmax(words))
        for x1, y1 in ((int(x[best]), int(y[best])), (alone, alone)):
            s, e, u, v = int(i[x1]), int(i[y1] + n[y1]), int(j[x1]), int(j[y1] + n[y1])
            if min(e - s, v - u) >= least and (similar := jaccard(ga[s : e - SHINGLE + 1], gb[u : v - SHINGLE + 1])) >= SIMILAR:
                out.append((s, e, u, v, similar))
                todo += [(low, x1), (y1 + 1, high)]
                break
    return out


#: Of two texts, the runs of the one's words that equal the other's so many words before.
Seen = dict[int, list[tuple[int, int]]]


def aligned(seen: Seen, i: int, j: int) -> bool:
    for s, e in seen.get(i - j, ()):
        if s <= i < e:
            return True
    return False


def passages(mine: Pieces, other: Pieces, links: list[tuple[int, int]], least: int, seen: Seen | None = None) -> list[tuple[int, int, int, int, float]]:
    """Verified ``(start, end, other start, other end, similarity)`` of two texts' pieces; ``seen`` tells what earlier calls aligned."""
    (a, ga, ra, rga), (b, gb, rb, rgb) = _as_lists(mine), _as_lists(other)
    out: list[tuple[int, int, int, int, float]] = []
    seen = {} if seen is None else seen
    width = SPAN - SHINGLE + 1
    for p, lp in links:
        if aligned(seen, p, lp):
            continue
        if ga[p] == gb[lp]:
            i, j = p, lp
        else:
            some, others = ga[p : p + width], gb[lp : lp + width]
            both = set(some).intersection(others)
            if not both:
                continue
            x = next(x for x, g in enumerate(some) if g in both)
            i, j = p + x, lp + others.index(some[x])
            if aligned(seen, i, j):
                continue
        right = _blocks(a, b, ga, gb, i, j)
        if not right or right[0][2] < SHINGLE:
            continue
        left = _blocks(ra, rb, rga, rgb, len(a) - i - SHINGLE, len(b) - j - SHINGLE)
        left = [(len(a) - q - n, len(b) - r - n, n) for q, r, n in reversed(left)]
        s, r = left[-1], right[0]  # both hold the shingle at (i, j)
        blocks = [*left[:-1], (s[0], s[1], r[0] + r[2] - s[0]), *right[1:]]
        for q, r, n in blocks:
            seen.setdefault(q - r, []).append((q, q + n))
        out += _stretches(ga, gb, blocks, least)
    return sorted(set(out))


SLICES = "lk long, salt int, mate boolean, k long, id {id}, links array<struct<p:int,lp:int>>, wide array<int>, own array<struct<lp:int,p:int>>, many boolean, at array<int>, words array<binary>"
FOUND = "k long, id {id}, s int, e int, lk long, lid {id}, u int, v int, similarity double, wk long"


def cut_out(h: np.ndarray, places: list[int], around: int) -> tuple[list[int], list[bytes]]:
    """Where the pieces of ``around`` words beside the paragraphs at ``places`` begin, and their words as 32-bit hashes."""
    at: list[int] = []
    end: list[int] = []
    for p in sorted(set(places)):
        low, high = max(0, p - around), min(len(h), p + SPAN + around)
        if end and low <= end[-1]:
            end[-1] = high
        else:
            at.append(low)
            end.append(high)
    short = (h >> U64(32)).astype("<u4")
    return at, [short[s:e].tobytes() for s, e in zip(at, end, strict=True)]


class Pieces:
    """Words of pieces laid end to end, between them marks of the text's ``number`` that equal nothing and that no alignment can jump."""

    def __init__(self, at: np.ndarray, words: list[bytes], number: int):
        sizes = np.array([len(x) // 4 + JUMP + 1 for x in words])
        ends = np.cumsum(sizes)
        self.at, self.start, self.end = at, ends - sizes, ends - JUMP - 1
        self.h = np.arange(ends[-1]).astype(U64) + U64(number + 1 << 32)
        for s, e, x in zip(self.start.tolist(), self.end.tolist(), words, strict=True):
            self.h[s:e] = np.frombuffer(x, "<u4")

    @cached_property
    def grams(self) -> np.ndarray:
        return shingle_hashes(self.h, SHINGLE)

    def here(self, p: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, p, "right") - 1
        return self.start[k] + p - self.at[k]

    def there(self, x: int) -> int:
        k = int(np.searchsorted(self.start, x, "right")) - 1
        return int(self.at[k] + x - self.start[k])


@lru_cache(maxsize=100)
def _as_lists(pieces: Pieces) -> tuple[list[int], list[int], list[int], list[int]]:
    """Words and shingles, and both from the end on."""
    words, grams = pieces.h.tolist(), pieces.grams.tolist()
    return words, grams, words[::-1], grams[::-1]


class Near:
    """Keys of the words near some places of many texts, whose pieces are laid end to end: ``add``, then ``windows`` and ``gapped``."""

    def __init__(self):
        self.texts: list[tuple[int, Pieces, np.ndarray, int]] = []
        self.apart: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # k, place, gapped key
        self.words = 0

    def add(self, k: int, pieces: Pieces, places: np.ndarray, kind: int) -> None:
        self.texts.append((k, pieces, places, kind))
        self.words += len(pieces.h)

    def lay(self) -> None:
        sizes = np.array([len(x.h) for _, x, _, _ in self.texts])
        base = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            h = splitmix(np.concatenate([x.h for _, x, _, _ in self.texts]))
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * _powers(_BASE, len(h)), dtype=U64)])
        self.k = np.repeat(np.array([k for k, _, _, _ in self.texts], np.int64), [len(x.at) for _, x, _, _ in self.texts])  # of each piece
        self.start, self.end = (np.concatenate([getattr(x, name) + o for (_, x, _, _), o in zip(self.texts, base, strict=True)]) for name in ("start", "end"))
        self.at = np.concatenate([x.at for _, x, _, _ in self.texts])
        self.places = np.concatenate([x for _, _, x, _ in self.texts])
        self.kind = np.repeat([x for _, _, _, x in self.texts], [len(x) for _, _, x, _ in self.texts])
        self.within = np.concatenate([x.here(places) for _, x, places, _ in self.texts])
        self.x = self.within + np.repeat(base, [len(x) for _, _, x, _ in self.texts])
        self.piece = np.searchsorted(self.start, self.x, "right") - 1

    def runs(self, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """The same hash for the same ``width`` words, wherever they begin."""
        with np.errstate(over="ignore"):
            return splitmix((self.sums[starts + width] - self.sums[starts]) * _powers(_INVERSE, len(self.sums))[starts])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(k, start, key)`` of windows of ``width`` words near the places that are not of kind BESIDE.

        Of STEP + 1 neighbouring ones, that with the least key; so who shares STEP words more shares one.
        """
        of = self.kind != BESIDE
        x, piece = self.x[of], self.piece[of]
        low, high = np.maximum(x - (width - SPAN) - STEP, self.start[piece]), np.minimum(x + STEP, self.end[piece] - width) + 1
        low, high = low[low < high], high[low < high]
        near = np.zeros(len(self.sums) + 1, np.int32)
        np.add.at(near, low, 1)
        np.add.at(near, high, -1)
        starts = np.flatnonzero(np.cumsum(near) > 0)
        rank = np.full(len(self.sums) + 2 * STEP, ~U64(0))
        keys = self.runs(starts, width)
        rank[starts + STEP] = keys
        least = _least(rank, STEP + 1)
        keep = np.zeros(len(starts), bool)
        for j in range(STEP + 1):
            keep |= least[starts + j] == keys
        starts, keys = starts[keep], keys[keep]
        piece = np.searchsorted(self.start, starts, "right") - 1
        return self.k[piece], (starts + self.at[piece] - self.start[piece]).astype(np.int32), keys

    def gapped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place's number, number in GAPPED, key)``: words around the places that are not of kind LEADS, but for a gap of BLOCK words or one more.

        Five blocks that LEAST_WORDS words around a place hold whole, without one: who has these
        words with one edit, or several in one block, shares a key with the other.
        """
        of = self.kind != LEADS
        x, piece = self.x[of], self.piece[of]
        starts = x + _LEFT[:, None]
        shape, at = np.nonzero((starts >= self.start[piece]) & (starts + (4 * BLOCK + _GAP)[:, None] <= self.end[piece]))
        starts, words, gap = starts[shape, at], _WORDS[shape], _GAP[shape]
        key = self.runs(starts, words)
        part = np.flatnonzero(words < 4 * BLOCK)
        starts, words, gap = starts[part], words[part], gap[part]
        key[part] = splitmix(key[part] + splitmix(self.runs(starts + words + gap, 4 * BLOCK - words) + words.astype(U64)))
        return np.flatnonzero(of)[at], shape, key


@lru_cache(maxsize=8)
def _table(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, base, U64), dtype=U64)])


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2^64."""
    return _table(base, max(1 << 12, 1 << n.bit_length()))[:n]


def _slices(id_type: pa.DataType):
    places = pa.list_(pa.int32())
    links, own = pa.list_(pa.struct([("p", pa.int32()), ("lp", pa.int32())])), pa.list_(pa.struct([("lp", pa.int32()), ("p", pa.int32())]))
    schema = pa.schema([("lk", pa.int64()), ("salt", pa.int32()), ("mate", pa.bool_()), ("k", pa.int64()), ("id", id_type), ("links", links), ("wide", places), ("own", own), ("many", pa.bool_()), ("at", places), ("words", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: WordHashes = WordHashes()
        for b, texts in text_slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for row, text in zip(b.drop_columns(["text"]).to_pylist(), texts, strict=True):
                h = cache.of(text.split())
                for m in row["mates"] or ():
                    rows.append((m["lk"], m["salt"], True, row["k"], row["id"], m["links"], None, None, None, *cut_out(h, [x["p"] for x in m["links"]], AROUND)))
                if row["places"]:
                    lead = cut_out(h, row["places"] + [x["p"] for x in row["own"]], AROUND + 2 * JUMP)
                    rows += [(row["k"], salt, False, row["k"], row["id"], None, row["wide"], row["own"], row["salts"] > 1, *lead) for salt in range(row["salts"])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _verify(least: int, id_type: pa.DataType, apart: bool = True):
    schema = pa.schema([("k", pa.int64()), ("id", id_type), ("s", pa.int32()), ("e", pa.int32()), ("lk", pa.int64()), ("lid", id_type), ("u", pa.int32()), ("v", pa.int32()), ("similarity", pa.float64()), ("wk", pa.int64())])
    reach = least - SPAN

    def met_again(near: Near) -> pa.RecordBatch:
        parts = list(near.apart)
        if near.texts:
            near.lay()
            parts.append(near.windows(least))
        k, p, wk = (np.concatenate(x) for x in zip(*parts, strict=True))
        kind = np.repeat([1] * len(near.apart) + [0] * bool(near.texts), [len(x) for x, _, _ in parts])
        own_columns = {"k": k, "s": p, "e": kind, "wk": wk.view(np.int64)}
        return pa.RecordBatch.from_arrays([pa.array(own_columns[f.name], f.type) if f.name in own_columns else pa.nulls(len(k), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, near, number = Lead(), Near(), 0
        for b in batches:
            column = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            lk, k, ids, mate = (column[name].to_pylist() for name in ("lk", "k", "id", "mate"))
            links, own = _lists(column["links"], "p", "lp"), _lists(column["own"], "lp", "p")
            wide, starts = _lists(column["wide"]), _lists(column["at"])
            rows: list[tuple] = []
            for at in range(b.num_rows):
                pieces = Pieces(starts(at)[0], column["words"][at].as_py(), number := number + 1)
                if not mate[at]:  # rows arrive sorted: a text's own slices, then its mates'
                    rows += lead.end(near, least)
                    again: dict[int, list[int]] = {}
                    for lp, p in zip(*(x.tolist() for x in own(at)), strict=True):
                        again.setdefault(lp, []).append(p)
                    lead = Lead(k[at], ids[at], pieces, set(wide(at)[0].tolist()), apart and column["many"][at].as_py())
                    continue
                p, lp = links(at)
                if again:
                    pairs = set(zip(p.tolist(), lp.tolist(), strict=True))
                    first: dict[int, int] = {}
                    for x, y in sorted(pairs):
                        first.setdefault(y, x)
                    pairs |= {(x, z) for y, x in first.items() for z in again.get(y, ())}
                    p, lp = (np.array(x) for x in zip(*pairs, strict=True))
                seeds = sorted(zip(pieces.here(p).tolist(), lead.pieces.here(lp).tolist(), strict=True))
                found = passages(pieces, lead.pieces, seeds, least)
                found = [(pieces.there(s), pieces.there(e - 1) + 1, lead.pieces.there(u), lead.pieces.there(v - 1) + 1, r) for s, e, u, v, r in found]
                rows += [(k[at], ids[at], s, e, lk[at], lead.id, u, v, r, None) for s, e, u, v, r in found]
                inside, failed = [], []
                for x, y in zip(p.tolist(), lp.tolist(), strict=True) if lead.wide else ():
                    if y in lead.wide:
                        # deep inside a passage, whoever shares a window of this text shares it with the leading text
                        deep = any((s == 0 or s <= x - reach) and x + SPAN + reach <= e and u <= y < v for s, e, u, v, _ in found)
                        (inside if deep else failed).append((x, y))
                lead.met(k[at], ids[at], pieces, failed, inside, found)
                if near.words > 1 << 18:
                    yield met_again(near)
                    near = Near()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if rows := lead.end(near, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if near.texts or near.apart:
            yield met_again(near)

    return run


class Lead:
    """A leading text with its mates of one task, and which of their places are to be met again."""

    def __init__(self, k: int = 0, id_=None, pieces: Pieces | None = None, wide: set[int] = frozenset(), many: bool = False):
        self.k, self.id, self.pieces, self.wide, self.many = k, id_, pieces, wide, many
        self.mates: list[tuple[int, object, Pieces]] = []
        self.links: list[tuple[int, int, int, bool]] = []  # number of the mate, its place, the leading text's, whether it failed
        self.failed: set[int] = set()
        self.extents = Extents()

    def met(self, k: int, id_, pieces: Pieces, failed: list[tuple[int, int]], inside: list[tuple[int, int]], found: list[tuple]) -> None:
        if failed or inside:
            n = len(self.mates)
            self.links += [(n, x, y, True) for x, y in failed] + [(n, x, y, False) for x, y in inside]
            for s, e, u, v, _ in found:
                self.extents.join((n, s, e), (-1, u, v))
            self.mates.append((k, id_, pieces))
            self.failed |= {y for _, y in failed}

    def end(self, near: Near, least: int) -> list[tuple]:
        """Passages of mates with each other; adds the places to be met by other tasks, and gives the ids of all texts added, as rows."""
        links = [x for x in self.links if self.many or x[2] in self.failed]
        if not links:
            return []
        ids, own = {}, Near()
        places: dict[tuple[int, int], set[int]] = {}
        for m, x, _, failed in links:
            places.setdefault((m, FAILED if failed else BESIDE), set()).add(x)
        of = []
        for (m, kind), some in places.items():
            k, id_, pieces = self.mates[m]
            at = np.array(sorted(some))
            own.add(k, pieces, at, kind)
            of += [m] * len(at)
            if kind == FAILED:
                near.add(k, pieces, at, kind)
            if kind == FAILED or self.many:
                ids[k] = id_
        if self.failed:
            near.add(self.k, self.pieces, np.array(sorted(self.failed)), LEADS)
            ids[self.k] = self.id
        return self._mates(own, np.array(of), near, least) + [(k, id_, None, None, None, None, None, None, None, None) for k, id_ in ids.items()]

    def _mates(self, near: Near, of: np.ndarray, more: Near, least: int) -> list[tuple]:
        """Passages of mates that share a gapped key, of which one's link failed, and which the leading text's passages do not join there already.

        ``more`` gets the keys by which mates in other tasks are met.
        """
        if not self.many and len(set(of.tolist())) < 2:
            return []
        near.lay()
        at, shape, key = near.gapped()
        order = np.lexsort((at, key))
        at, shape, key = at[order], shape[order], key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        first, last = cuts[:-1], cuts[1:]
        failed = near.kind == FAILED
        if len(first):
            several = np.minimum.reduceat(of[at], first) < np.maximum.reduceat(of[at], first)
            todo = several & np.logical_or.reduceat(failed[at], first)
            first, last = first[todo], last[todo]
        known: dict[int, int] = {}  # to which extents a passage with these words would be joined
        places, within, bad, texts, root = near.places.tolist(), near.within.tolist(), failed.tolist(), of.tolist(), self.extents.root

        def group(name: int) -> int:
            if (x := known.get(name, -1)) < 0:
                place, (left, _, gap) = name // len(GAPPED), GAPPED[name % len(GAPPED)]
                start = places[place] + left
                if (x := self.extents.group(texts[place], start, start + 4 * BLOCK + gap)) >= 0:
                    known[name] = x
            return root(x) if x >= 0 else -1 - name

        tried: set[tuple[int, int]] = set()
        seen: dict[tuple[int, int], Seen] = {}
        rows = []
        for low, high in zip(first.tolist(), last.tolist(), strict=True):
            them = at[low:high].tolist()
            names = [x * len(GAPPED) + n for x, n in zip(them, shape[low:high].tolist(), strict=True)]
            groups = [group(x) for x in names]
            left = len(set(groups))
            for i in range(len(them)):
                if left == 1:
                    break
                if not bad[them[i]]:
                    continue
                for j in range(len(them)):
                    if groups[i] == groups[j] or texts[them[i]] == texts[them[j]]:
                        continue
                    pair = (them[i], them[j]) if texts[them[i]] > texts[them[j]] else (them[j], them[i])
                    if pair in tried:
                        continue
                    tried.add(pair)
                    a, b = pair
                    mine, other = texts[a], texts[b]
                    runs = seen.setdefault((mine, other), {})
                    if aligned(runs, within[a], within[b]):
                        continue
                    (k, id_, pieces), (lk, lid, others) = self.mates[mine], self.mates[other]
                    found = passages(pieces, others, [(within[a], within[b])], least, runs)
                    for s, e, u, v, r in found:
                        s, e, u, v = pieces.there(s), pieces.there(e - 1) + 1, others.there(u), others.there(v - 1) + 1
                        rows.append((k, id_, s, e, lk, lid, u, v, r, None))
                        self.extents.join((mine, s, e), (other, u, v))
                    if found:
                        groups = [root(g) if g >= 0 else group(x) if texts[place] == mine or texts[place] == other else g for g, x, place in zip(groups, names, them, strict=True)]
                        if (left := len(set(groups))) == 1:
                            break
        if self.many:  # texts in other tasks may share these keys
            ks = np.array([self.mates[m][0] for m in of[at].tolist()], np.int64)
            more.apart.append((ks, near.places[at], key))
        return rows


class Extents:
    """Extents of texts that passages join, through extents of one text that overlap by MEET words too."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, int, int]]] = {}  # of each text its extents, those that overlap by MEET as one, and the number of each
        self.parent: list[int] = []

    def root(self, x: int) -> int:
        while (up := self.parent[x]) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def number(self, text: int, s: int, e: int) -> int:
        mine, apart, low, high = self.of.get(text, ()), [], s, e
        x = -1
        for extent in mine:
            u, v, other = extent
            if min(e, v) - max(s, u) >= MEET or (s == u and e == v):
                low, high = min(low, u), max(high, v)
                if x >= 0:
                    self.parent[self.root(other)] = self.root(x)
                else:
                    x = other
            else:
                apart.append(extent)
        if x < 0:
            x = len(self.parent)
            self.parent.append(x)
        self.of[text] = [*apart, (low, high, x)]
        return x

    def join(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> None:
        self.parent[self.root(self.number(*a))] = self.root(self.number(*b))

    def group(self, text: int, start: int, end: int) -> int:
        """An extent that overlaps these words by MEET, as any passage that holds them then does; -1 if there is none."""
        for s, e, x in self.of.get(text, ()):
            if min(e, end) - max(s, start) >= MEET:
                return x
        return -1


def _lists(column: pa.Array, *fields: str):
    """Of a column of lists: what gives the numbers of one row's list, or the named fields of its structs."""
    ends, values = column.offsets.to_numpy(), column.values
    parts = [(values.field(f) if fields else values).to_numpy() for f in fields or ("",)]
    return lambda at: [x[ends[at] : ends[at + 1]] for x in parts]


def _checked(rows: DataFrame, links: DataFrame, least: int, apart: bool) -> DataFrame:
    """Passages of all linked texts, and as rows with a ``wk`` the windows by which texts are met again; see FOUND.

    With ``apart`` the gapped keys of mates that other tasks hold too, told by an ``e`` of 1.
    """
    mate = "k <> lk"
    pairs = materialize(links.where(mate).groupBy("k", "lk").agg(F.collect_set(F.struct("p", "lp")).alias("links")), "pairs")
    # of each leading text: its linked places (no more than the text has), and how many tasks share its mates
    lead = links.groupBy("lk").agg(
        F.collect_set(F.when(F.expr(mate), F.col("lp"))).alias("places"),
        F.collect_set(F.when(F.col("wide") & F.expr(mate), F.col("lp"))).alias("wide"),
        F.collect_set(F.when(~F.expr(mate), F.struct("lp", "p"))).alias("own"),
        F.ceil(F.approx_count_distinct(F.when(F.expr(mate), F.col("k"))) / MATES).cast("int").alias("salts"),
    )
    lead = materialize(lead.where("salts > 0"), "leaders")
    salted = pairs.join(lead.select("lk", "salts"), "lk").select("k", F.struct("lk", F.pmod(F.hash("k"), "salts").alias("salt"), "links").alias("mate"))
    mates = salted.groupBy("k").agg(F.collect_list("mate").alias("mates"))  # a place of a text has one leader for each band
    want = materialize(mates.join(lead.withColumnRenamed("lk", "k"), "k", "full"), "wanted")
    drop(pairs, lead)
    kind = rows.schema["id"].dataType
    names = {"id": kind.simpleString()}
    slices = rows.join(want, "k").select("k", "id", "mates", "places", "wide", "own", "salts", "text").mapInArrow(_slices(to_arrow_type(kind)), SLICES.format(**names))
    dealt = slices.repartition(shuffle_width(rows.sparkSession), "lk", "salt")  # the work of a slice is not told by its bytes
    dealt = dealt.sortWithinPartitions("lk", "salt", "mate", "k")
    out = materialize(dealt.mapInArrow(_verify(least, to_arrow_type(kind), apart), FOUND.format(**names)), "checked")
    drop(want)
    return out


def _again(checked: DataFrame, least: int) -> DataFrame:
    """``k, s, e, lk, u, v, similarity`` of stretches that share windows of ``least`` words exactly, of buckets with links that failed."""
    links = linked(checked.where("wk is not null and e = 0").select("wk", "k", F.col("s").alias("p")), "wk")
    met = links.where("k <> lk").select("k", "lk", "p", (F.col("lp") - F.col("p")).alias("shift")).distinct()
    order = Window.partitionBy("k", "lk", "shift").orderBy("p")  # within one text's places
    new = met.withColumn("new", F.coalesce((F.col("p") - F.lag("p").over(order) > STEP + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    out = new.groupBy("k", "lk", "shift", "run").agg(F.min("p").alias("s"), (F.max("p") + least).alias("e"))
    out = out.select("k", "s", "e", "lk", (F.col("s") + F.col("shift")).alias("u"), (F.col("e") + F.col("shift")).alias("v"), F.lit(1.0).alias("similarity"))
    held = checked.where("similarity is not null").select("k", "lk", "s", "e", "u", "v").alias("f")
    out = materialize(out.alias("w").join(held, F.expr("w.k = f.k and w.lk = f.lk and f.s <= w.s and w.e <= f.e and f.u <= w.u and w.v <= f.v"), "left_anti"), "met-again")
    drop(links)
    return out


def _regions(each: DataFrame) -> DataFrame:
    """``each`` with ``region``: extents of one text that overlap by MEET words, through others too, share one."""
    before = Window.partitionBy("k").orderBy("start_word", "n_words", "node").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.col("start_word") + F.col("n_words")).over(before)
    new = F.coalesce((F.col("start_word") + MEET > end).cast("int"), F.lit(1))
    upto = Window.partitionBy("k").orderBy("start_word", "n_words", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumn("new", new).withColumn("region", F.sum("new").over(upto)).drop("new")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each occurrence of a passage that several documents share.

    Columns: ``id_col``, ``start_word``, ``n_words``, ``component_id`` (the
    cluster's smallest document id), ``similarity`` (exact Jaccard similarity of
    5-word shingles, the least of those it was verified with), ``removed``.
    Extents of one document that overlap by MEET words are of one cluster and
    share one fate. Of all that are linked the first occurrence, by id and place,
    stays, and with it what overlaps it there, unless SIMILAR of it is part of
    an extent that is itself removed; all else is removed. A passage has
    ``least_words`` (at least SPAN) words or more, and SIMILAR or more in common
    with another document's. Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.
    A stretch that different documents share to different extents has a row for
    each extent, so what is removed is always kept elsewhere.

    Exact copies of ``least_words`` + STEP words or more are all found (of fewer, and
    edited ones, those that share a bucket with the first text, or a gapped key of it; a
    stretch met by windows alone is given to within STEP words at either end). Words are compared
    by 32 bits of their hashes. Ids may have any type that can be
    ordered. Null ids and null, empty or short texts give no row; nor do repeats
    within one document, and rows of one id are never linked with each other.
    Repeated rows count once; rows of one id and different texts are compared by
    their own texts. Rows are told apart by a 64-bit hash of id and text. Empty
    table: no rows. Other columns are not read.
    """
    if least_words < SPAN:
        raise ValueError(f"least_words must be {SPAN} or more")
    rows = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("k", F.xxhash64("id", "text"))
    emitted = materialize(rows.select("k", "text").mapInArrow(_emit(least_words), "bk long, k long, p int"), "paragraphs")
    links = linked(emitted, "bk")
    drop(emitted)
    parts = [_checked(rows, links, least_words, True)]
    drop(links)
    # mates of one leading text that other tasks met: by their gapped keys, each such bucket led anew
    apart = parts[0].where("wk is not null and e = 1").select("wk", "k", F.col("s").alias("p"))
    if not apart.isEmpty():
        links = linked(apart, "wk")
        parts.append(_checked(rows, links, least_words, False))
        drop(links)
    checked = reduce(DataFrame.union, parts)
    more = _again(checked, least_words)
    named = checked.where("id is not null")
    ids = materialize(named.select("k", "id").union(named.where("lid is not null").select("lk", "lid")).distinct(), "ids")
    found = checked.where("similarity is not null").select(more.columns).union(more).distinct()
    found = materialize(found.withColumn("a", F.xxhash64("k", "s", "e")).withColumn("b", F.xxhash64("lk", "u", "v")), "passages")
    drop(*parts, more)
    roots = connected_components(found.select("a", "b"))
    one = found.select(F.col("a").alias("node"), "k", F.col("s").alias("start_word"), (F.col("e") - F.col("s")).alias("n_words"), "similarity")
    other = found.select(F.col("b").alias("node"), F.col("lk").alias("k"), F.col("u").alias("start_word"), (F.col("v") - F.col("u")).alias("n_words"), "similarity")
    each = one.union(other).groupBy("node", "k", "start_word", "n_words").agg(F.min("similarity").alias("similarity"))
    each = each.join(ids, "k").join(roots.withColumnRenamed("v", "node"), "node")
    each = materialize(_regions(each), "occurrences")
    first = each.groupBy("root").agg(F.min(F.struct("id", "start_word", "node")).alias("first"), F.max("id").alias("last")).where("first.id <> last")
    first = materialize(first.select("root", F.col("first.id").alias("first_id"), F.col("first.node").alias("kept_node")), "firsts")
    # clusters that meet in a region are one
    meet = each.join(first.select("root"), "root", "left_semi").groupBy("k", "region").agg(F.min("root").alias("low"), F.collect_set("root").alias("of"))
    joined = connected_components(meet.where(F.size("of") > 1).select("low", F.explode("of").alias("b")).select(F.col("low").alias("a"), "b"))
    whole = materialize(first.join(joined.withColumnRenamed("root", "whole"), first["root"] == F.col("v"), "left").select(first["root"], "first_id", "kept_node", F.coalesce("whole", first["root"]).alias("whole")), "clusters")
    names = whole.groupBy("whole").agg(F.min("first_id").alias("component_id"))
    in_region = Window.partitionBy("k", "region")  # extents of one text
    end, first_here = F.col("start_word") + F.col("n_words"), F.col("node") == F.col("kept_node")
    # a first occurrence need not stay if an extent that is removed covers SIMILAR of it: what that one is a copy of has it

    def covered(shift: int) -> Column:
        upto = in_region.orderBy("start_word").rangeBetween(Window.unboundedPreceding, shift)
        furthest = F.max(F.when(~first_here, end)).over(upto)
        needed = F.col("start_word") + shift + SIMILAR * F.col("n_words")
        return (needed <= end) & F.coalesce(furthest >= needed, F.lit(False))

    out = each.join(whole, "root").join(names, "whole").withColumn("stays", first_here & ~covered(0) & ~covered(NEAR))
    out = out.withColumn("removed", ~F.max("stays").over(in_region))
    out = out.select(F.col("id").alias(id_col), F.col("start_word").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "component_id", "similarity", "removed")
    result = materialize(out, "repeated")
    drop(found, roots, ids, each, first, joined, whole)
    return result
