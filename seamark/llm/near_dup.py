"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched into registers: register i keeps
the smallest of exponentially distributed hash values, truncated to a power of
``BASE`` (Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog").
Registers merge by maximum and two sets agree in a register with a chance that
follows their similarity, so bands of registers find candidates. For a
candidate pair the counts of larger, smaller and equal registers give the
similarity of highest joint likelihood; pairs that could reach the threshold
are then confirmed on the full sets.

Scale: texts are read once to be sketched; rows with equal sets collapse to one
*class* before banding; each bucket is compared with one hub (never all pairs),
and hubs are chosen by how many other sets they meet. All sets that share a
bucket share its hub, so what the hubs leave in different components is looked
for among the sets of one hub (a *family*): pair by pair in a small family, and
in a large one by blocks of sets, compared exactly as matrices in a task, which
return at most a spanning forest. Blocks are filled component by component, and
two blocks are compared only if they hold more than one: so the members of a
family that are already linked meet only the blocks of those that are not, and
the texts sent follow the family's size times the blocks still apart. No
candidate is dropped or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .store import drop, materialize, small
from .text import U64, WordHashes, shingle_hashes, splitmix, text_slices

ROWS, BANDS = 6, 42
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.02, 20.0, 1023
#: At similarity 0.8 a pair shares no band with a chance of 3e-6.
#: A pair is verified when its estimate is at least the threshold less six standard errors.
CHUNK = 1 << 15
#: Families above SMALL members are compared in blocks of about BLOCK sets.
SMALL, BLOCK = 24, 400

_MULTIPLIERS = splitmix(np.arange(1000, 1000 + REGISTERS, dtype=U64)) | U64(1)
_LN_BASE = np.log(BASE)


def sketch(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of consecutive non-empty sets of 64-bit hashes."""
    lows = np.empty((REGISTERS, len(starts)), U64)
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            lows[i] = np.minimum.reduceat(shingles * _MULTIPLIERS[i], starts)
    h = -np.log1p(-((lows.T >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / _LN_BASE), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of highest likelihood, given register rows and the known set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1.0 - u

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LN_BASE

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        e = np.maximum(1.0 - p - q, 1e-12)
        return up * np.log(np.maximum(p, 1e-12)) + down * np.log(np.maximum(q, 1e-12)) + same * np.log(e)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) >= likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _sets(texts: list[bytes], cache: WordHashes, width: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(cache.of(t.lower().split()), width)) for t in texts]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b, texts in text_slices(batches, "text", 1 << 19):
            sets = _sets(texts, cache, width)
            full = [s for s in sets if len(s)]
            regs: list[np.ndarray] = []
            at = 0
            while at < len(full):  # a few sets at a time stay in the processor's cache
                end, size = at, 0
                while end < len(full) and (end == at or size + len(full[end]) <= CHUNK):
                    size += len(full[end])
                    end += 1
                part = full[at:end]
                regs.extend(sketch(np.concatenate(part), np.cumsum([0] + [len(s) for s in part[:-1]])))
                at = end
            rows = iter(regs)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["id", "n", "ck", "regs"],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node and band: the band's six registers of ten bits, mixed with the band's number."""
    shift = U64(10) * np.arange(ROWS, dtype=U64)
    for b in batches:
        if not b.num_rows:
            continue
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        packed = (regs.astype(U64) << shift).sum(2, dtype=U64)
        keys = splitmix(packed ^ splitmix(np.arange(BANDS, dtype=U64)))
        v = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(v)], names=["bk", "v"])


def _likely(percent: int):
    low = percent / 100.0 - 6.0 * np.sqrt(percent / 100.0 * (1 - percent / 100.0) / REGISTERS) - 0.01

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            c = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keep = joint_estimate(a, c, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)) >= low
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _own_text(width: int):
    """Keep rows whose text really has the class's set (a repeated id may have several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b, texts in text_slices(batches, "text"):
            keys = [_key(s) for s in _sets(texts, cache, width)]
            keep = [k == c for k, c in zip(keys, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["v", "text"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, right = WordHashes(), None, None
        for b, texts in text_slices(batches, "ta"):
            others = [t or b"" for t in b.column(3).cast(pa.binary()).to_pylist()]
            hubs = b.column(1).to_pylist()
            keep = []
            for s, hub, other in zip(_sets(texts, cache, width), hubs, others, strict=True):
                if hub != last:  # rows arrive sorted by hub
                    last, right = hub, _sets([other], cache, width)[0]
                both = len(np.intersect1d(s, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Two rows are linked when 100 * |intersection| >= percent * |union| of their
    word-shingle sets; ``component_id`` is the smallest id reachable by links and
    ``kept`` marks rows whose own id that is. Fewer than ``width`` words: the
    whole sequence is one shingle. Null, empty or blank text: no shingles, linked
    with nothing, its own component. Rows with a null id take part in linking;
    a component of null ids alone has a null id and is kept. Repeated rows are
    copies of each other and share their id. Extra columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig = materialize(source.mapInArrow(_signatures(width), f"id {source.schema['id'].dataType.simpleString()}, n long, ck binary, regs binary"), "sig")
    nodes = materialize(
        sig.where("ck is not null")
        .groupBy("ck")
        .agg(F.min("id").alias("label"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
        .withColumn("v", F.monotonically_increasing_id()),
        "nodes",
    )
    bands = materialize(nodes.select("v", "regs").mapInArrow(_bands, "bk long, v long"), "bands")
    sizes = bands.groupBy("bk").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(sizes, "bk"), "members")
    drop(bands)
    # a set that meets many others is the better hub: an original meets its copies more often than they meet each other
    central = members.groupBy("v").agg(F.sum("size").alias("meets"))
    ranked = materialize(members.join(central, "v").select("bk", "v", "meets"), "ranked")
    drop(members)

    work = _Work(source, nodes, width, percent)
    hubs = ranked.groupBy("bk").agg(F.max_by("v", F.struct("meets", -F.col("v"))).alias("hub"))
    stars = materialize(ranked.join(hubs, "bk").where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    drop(ranked)
    links = [work.verified(stars)]
    roots = connected_components(links[0])
    links += _rest(stars, roots, work)
    drop(stars, roots)
    roots = connected_components(reduce(DataFrame.union, links))
    # both written before they are joined, so that a component with many sets can be split
    label = materialize(nodes.select("v", "ck", "label").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "labels")
    least = materialize(label.groupBy("root").agg(F.min("label").alias("component_id")), "least")
    classes = label.join(least, "root").select("ck", "component_id")
    out = sig.join(classes, "ck", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    result = materialize(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), "near-dup")
    drop(sig, nodes, label, least, roots, *links, *work.fetched)
    return result


class _Work:
    """What confirming pairs of one run needs. A text is fetched for one row of a class, and once."""

    def __init__(self, source: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.source, self.nodes, self.width, self.percent = source, nodes, width, percent
        self.fetched: list[DataFrame] = []

    def texts(self, need: DataFrame) -> DataFrame:
        """``v, text`` of at least the nodes in ``need (v)``."""
        for t in self.fetched:
            need = need.join(t.select("v"), "v", "left_anti")
        need = materialize(need.join(self.nodes.select("v", "label", "ck"), "v"), "need")
        if not need.isEmpty() or not self.fetched:
            found = self.source.join(small(need), self.source["id"].eqNullSafe(need["label"])).select("v", "ck", "text")
            self.fetched.append(materialize(found.mapInArrow(_own_text(self.width), "v long, text string").dropDuplicates(["v"]), "texts"))
        drop(need)
        return reduce(DataFrame.union, self.fetched)

    def sized(self, pairs: DataFrame) -> DataFrame:
        n = self.nodes.select("v", "n")
        both = pairs.join(n.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
        return both.where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) confirmed: sizes, then the joint estimate, then full sets."""
        regs = self.nodes.select("v", "regs")
        both = self.sized(pairs).join(regs.select(F.col("v").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("v").alias("b"), F.col("regs").alias("rb")), "b")
        likely = materialize(both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(self.percent), "a long, b long"), "likely")
        texts = self.texts(likely.select(F.col("a").alias("v")).union(likely.select(F.col("b").alias("v"))).distinct())
        full = small(likely).join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
        out = materialize(full.select("a", "b", "ta", "tb").sortWithinPartitions("b").mapInArrow(_confirm(self.width, self.percent), "a long, b long"), "links")
        drop(likely)
        return out


def block_links(sets: list[np.ndarray], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different roots, from exact intersections.

    Shingles of one set alone cannot be shared; the others are columns of a 0/1
    matrix whose product with itself counts intersections.
    """
    size = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(shared.sum()), 4096):
        s, e = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[s:e], column[s:e] - low] = 1
        both += m @ m.T
    x, y = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    up = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(roots[i]), top(roots[j])
        if p != q:
            up[p] = q
            out.append((i, j))
    return out


def _block(width: int, percent: int):
    def run(group):
        import pandas as pd

        sets = _sets([t.encode() for t in group["text"]], WordHashes(), width)
        found = block_links(sets, group["root"].tolist(), percent)
        v = group["v"].to_numpy()
        return pd.DataFrame({"a": [v[i] for i, _ in found], "b": [v[j] for _, j in found]}, dtype="int64")

    return run


def _rest(stars: DataFrame, roots: DataFrame, work: _Work) -> list[DataFrame]:
    """Exact way for what the hubs leave: links between sets of one family that lie in different components."""
    family = stars.select(F.col("b").alias("hub"), F.col("a").alias("v")).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    # written before they are joined, so that a hub with many sets can be split
    whole = materialize(family, "family")
    open_ = materialize(whole.groupBy("hub").agg(F.count("*").alias("k"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("hub", "k"), "open")
    family = materialize(whole.join(open_, "hub"), "families")
    drop(whole, open_)
    few, many = family.where(f"k <= {SMALL}"), family.where(f"k > {SMALL}")
    one = few.select("hub", F.col("v").alias("a"), F.col("root").alias("r1"))
    other = few.select("hub", F.col("v").alias("b"), F.col("root").alias("r2"))
    pairs = materialize(one.join(other, "hub").where("a < b and r1 <> r2").select("a", "b").distinct(), "pairs")
    links = [work.verified(pairs)]
    drop(pairs)
    if not many.isEmpty():
        sizes = materialize(many.groupBy("hub", "root").agg(F.count("*").alias("kr")), "sizes")
        blocks = F.ceil(F.col("k") / BLOCK)
        # a component fills as many blocks as it needs, from a hashed one on
        block = F.pmod(F.xxhash64("root") + F.pmod(F.xxhash64("v"), F.ceil(F.col("kr") / BLOCK)), blocks).cast("int")
        placed = materialize(many.join(sizes, ["hub", "root"]).select("hub", "v", "root", block.alias("block")), "placed")
        ends = materialize(placed.groupBy("hub", "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "block-ends")
        x, y = (ends.select("hub", F.col("block").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in "ij")
        cells = x.join(y, "hub").where("i <= j and least(low_i, low_j) <> greatest(high_i, high_j)").select("hub", "i", "j")
        cells = materialize(cells, "cells")
        sides = cells.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        rows = materialize(placed.join(sides, ["hub", "block"]).select("hub", "v", "root", "i", "j"), "cell-rows")
        texts = work.texts(rows.select("v").distinct())
        links.append(materialize(rows.join(texts, "v").groupBy("hub", "i", "j").applyInPandas(_block(work.width, work.percent), "a long, b long"), "block-links"))
        drop(sizes, placed, ends, cells, rows)
    drop(family)
    return links
