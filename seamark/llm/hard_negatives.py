"""Hard negatives by a sort-tile-recursive R-tree of vectors.

Rows are tiled by Spark (slabs of the first component, ranges of the second
within them) into shards of a bounded size, and a shard is packed on by the
components that spread most into leaves of some dozens of rows, each with the
minimum bounding box of its rows. A box gives an interval for each component and
so one for the inner product with an anchor. For an anchor a shard's boxes are
taken best first: those outside the score windows, or strictly below the k-th
score found, are never read. Shards meet blocks of anchors of a bounded size;
what each gives is merged by Spark.

Scores are whole numbers. They are computed in floats only where these are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize, shuffle_width

SCALE = 256
SHARD_ROWS, LEAST_ROWS, LEAF_ROWS, BLOCK_ANCHORS = 32_768, 4_096, 64, 8_192
#: Components are held within this, so that scores of up to 127 components fit a long.
MOST = 1 << 28
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95

LEAVES = "shard long, dim int, lo binary, hi binary, low_label long, high_label long, ids binary, labels binary, vectors binary"
LEAVES_ARROW = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary()), ("low_label", pa.int64()), ("high_label", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``id, label, v array<int>``: components times ``scale``, rounded down; one row for each id.

    Rows with a null id, label or vector, or a null or non-finite component, go.
    Of rows with one id the one with the smallest label, then vector, stays.
    """
    x = F.col("x")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    r = rows.select(rows[id_col].cast("long").alias("id"), label.cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("x"))
    r = r.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    held = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return r.select("id", "label", held.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def tile(v: np.ndarray, leaf: int = LEAF_ROWS) -> list[np.ndarray]:
    """Sort-tile-recursive: rows in slabs by the component that spreads most, each slab by the next, down to leaves."""

    def cut(rows: np.ndarray, levels: int) -> list[np.ndarray]:
        if len(rows) <= leaf or not v.shape[1]:
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        by = int(np.argmax(v[rows].var(axis=0)))
        rows = rows[np.argsort(v[rows, by], kind="stable")]
        leaves = -(-len(rows) // leaf)
        slabs = leaves if levels == 1 else int(np.ceil(leaves ** (1 / levels)))
        size = -(-leaves // slabs) * leaf
        return [x for i in range(0, len(rows), size) for x in cut(rows[i : i + size], max(levels - 1, 1))]

    return cut(np.arange(len(v)), 4)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of sorted rows, packed into leaves; labels with enough rows have leaves of their own."""
    part, shard = TaskContext.get().partitionId(), 0
    held: list[tuple[int, int, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        ids, labels = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        v = np.array([h[2] for h in held], np.int64).reshape(len(held), -1)
        code, n = np.unique(labels, return_inverse=True, return_counts=True)[1:]
        own = np.where(n[code] >= LEAF_ROWS, code, -1)
        out = []
        for c in np.unique(own):
            rows = np.flatnonzero(own == c)
            for leaf in tile(v[rows]):
                r = rows[leaf]
                lo, hi = v[r].min(axis=0), v[r].max(axis=0)
                out.append((part << 20 | shard, v.shape[1], lo.astype("<i4").tobytes(), hi.astype("<i4").tobytes(), labels[r].min(), labels[r].max(), ids[r].tobytes(), labels[r].tobytes(), v[r].astype("<i4").tobytes()))
        shard += 1
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LEAVES_ARROW, strict=True)], schema=LEAVES_ARROW)

    for b in batches:
        vectors = b.column(2)
        ends = np.asarray(vectors.offsets) if len(vectors) else []
        flat = vectors.values.to_numpy()
        for i, (vec_id, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            v = flat[ends[i] : ends[i + 1]]
            if held and (len(held) >= SHARD_ROWS or len(held[0][2]) != len(v)):
                yield from flush()
            held.append((vec_id, label, v))
    if held:
        yield from flush()


def build_tree(rows: DataFrame, count: int) -> DataFrame:
    """Leaves of ``rows (id, label, v)``, written to the shared folder; rows of different lengths never share a shard."""
    shards = max(-(-count // SHARD_ROWS), min(shuffle_width(rows.sparkSession), -(-count // LEAST_ROWS)), 1)
    slabs = int(np.ceil(np.sqrt(shards)))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    cuts = rows.agg(F.percentile_approx(first, [i / slabs for i in range(1, slabs)] or [0.5], 10_000).alias("q")).first()["q"] or []  # one row
    slab = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < first)) if cuts else F.lit(0)
    dealt = rows.select("id", "label", "v", F.size("v").alias("dim"), slab.alias("slab"), second.alias("second"))
    dealt = dealt.repartitionByRange(shards, "dim", "slab", "second", "id").sortWithinPartitions("dim", "slab", "second", "id")
    return materialize(dealt.select("id", "label", "v").mapInArrow(_leaves, LEAVES), "rtree")


class Shard:
    """A shard's leaves in arrays."""

    def __init__(self, leaves: pa.Table, dim: int):
        blob = lambda name, kind: np.frombuffer(b"".join(leaves.column(name).to_pylist()), kind)
        self.ids, self.labels = blob("ids", np.int64), blob("labels", np.int64)
        self.v = blob("vectors", "<i4").astype(np.int64).reshape(len(self.ids), dim)
        self.lo, self.hi = (blob(n, "<i4").astype(np.int64).reshape(leaves.num_rows, dim) for n in ("lo", "hi"))
        self.low_label, self.high_label = leaves.column("low_label").to_numpy(), leaves.column("high_label").to_numpy()
        self.ends = np.concatenate([[0], np.cumsum([len(x) // 8 for x in leaves.column("ids").to_pylist()])])

    def in_kind_for(self, anchors: np.ndarray) -> type:
        """The fastest kind of number in which every inner product is exact."""
        most = int(np.abs(anchors).max(initial=1)) * int(np.abs(self.v).max(initial=1)) * max(1, anchors.shape[1])
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least inner product that each box allows for each anchor."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        lo, hi = self.lo.astype(anchors.dtype).T, self.hi.astype(anchors.dtype).T
        return up @ hi + down @ lo, up @ lo + down @ hi

    def rows_of(self, boxes: np.ndarray) -> np.ndarray:
        n = self.ends[boxes + 1] - self.ends[boxes]
        return np.repeat(self.ends[boxes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def best_first(shard: Shard, v: np.ndarray, anchor: np.ndarray, upper: np.ndarray, boxes: np.ndarray, wanted, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window ``(low, high)`` the first ``k`` rows by score, then id, as scores and ids.

    ``boxes`` may hold them, ``upper`` bounds their scores, ``wanted(rows)`` says
    which rows count. Boxes are taken by falling bound, eight first and then
    twice as many, until the next bound lies strictly below what any window can use.
    """
    queue = boxes[np.argsort(-upper[boxes], kind="stable")]
    low, high = windows[:, 0], windows[:, 1]
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = low.copy()
    spans = [(0, 0)] * len(windows)
    at, step = 0, 8
    while at < len(queue) and upper[queue[at]] >= need.min():
        some = queue[at : at + step]
        some = some[upper[some] >= need.min()]
        rows = shard.rows_of(some)
        new = (v[rows] @ anchor).astype(np.int64)
        ok = (new >= need.min()) & (new <= high.max())
        rows, new = rows[ok], new[ok]
        ok = wanted(rows)
        scores, ids = np.concatenate([scores, new[ok]]), np.concatenate([ids, shard.ids[rows[ok]]])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        keep = np.zeros(len(scores), bool)
        for w in range(len(windows)):
            a = int(np.searchsorted(-scores, -high[w]))
            b = min(a + k, int(np.searchsorted(-scores, -low[w], side="right")))
            spans[w] = (a, max(a, b))
            keep[a:b] = True
            if b - a == k:
                need[w] = scores[b - 1]
        moved = np.concatenate([[0], np.cumsum(keep)])
        spans = [(int(moved[a]), int(moved[b])) for a, b in spans]
        scores, ids = scores[keep], ids[keep]
        at, step = at + step, step * 2
    return [(scores[a:b], ids[a:b]) for a, b in spans]


def _search(one):
    """A cogroup function: leaves of a shard beside anchors of a block; ``one`` gives rows for each anchor."""

    def run(leaves: pa.Table, anchors: pa.Table) -> pa.Table:
        schema = one.schema
        if not leaves.num_rows or not anchors.num_rows:
            return schema.empty_table()
        dim = leaves.column("dim")[0].as_py()
        shard = Shard(leaves, dim)
        a = np.array(anchors.column("v").to_pylist(), np.int64).reshape(anchors.num_rows, dim)
        kind = shard.in_kind_for(a)
        a, v = a.astype(kind), shard.v.astype(kind)
        out: list[tuple] = []
        extra = anchors.drop_columns(["v"]).to_pylist()
        for start in range(0, len(a), 256):
            upper, lower = shard.bounds(a[start : start + 256])
            for i in range(len(upper)):
                out += one(shard, v, a[start + i], upper[i], lower[i], extra[start + i])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    return run


class Nearest:
    """The ``k`` best other rows of an anchor's label in a shard."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def __init__(self, k: int):
        self.k = k

    def __call__(self, shard, v, anchor, upper, lower, row):
        label, me = row["label"], row["id"]
        boxes = np.flatnonzero((shard.low_label <= label) & (shard.high_label >= label))
        if not len(boxes):
            return []
        far = np.iinfo(np.int64)
        wanted = lambda r: (shard.labels[r] == label) & (shard.ids[r] != me)
        ((scores, ids),) = best_first(shard, v, anchor, upper, boxes, wanted, np.array([[far.min + 1, far.max]]), self.k)
        return [(me, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


class Negatives:
    """For each positive of an anchor, the ``k`` best rows of other labels in a shard with a score between ``low`` and ``high`` percent of the positive's."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def __call__(self, shard, v, anchor, upper, lower, row):
        label, me = row["label"], row["id"]
        windows = [(-(-self.low * p["positive_score"] // 100), self.high * p["positive_score"] // 100, p) for p in row["positives"]]
        windows = [w for w in windows if w[0] <= w[1]]
        if not windows:
            return []
        w = np.array([x[:2] for x in windows], np.int64)
        mixed = (shard.low_label != label) | (shard.high_label != label)
        boxes = np.flatnonzero(mixed & (upper >= w[:, 0].min()) & (lower <= w[:, 1].max()))
        found = best_first(shard, v, anchor, upper, boxes, lambda r: shard.labels[r] != label, w, self.k)
        return [(me, p["positive_id"], i, p["positive_score"], s) for (scores, ids), (_, _, p) in zip(found, windows, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


def _meet(tree: DataFrame, shards: DataFrame, anchors: DataFrame, blocks: int, one) -> DataFrame:
    """Every shard beside every block of anchors of its dimension, in blocks of a bounded size."""
    left = tree.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    right = right.join(shards, "dim").drop("dim")
    kinds = {pa.int64(): "long"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in one.schema)

    def run(leaves: pa.Table, some: pa.Table) -> pa.Table:
        return _search(one)(leaves, some.drop_columns(["shard", "block"]))

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchor`` (a condition on the id) holds; their
    positives are the ``positives`` other rows of their label with the highest
    inner product; for each, the ``negatives`` best rows of other labels whose
    score is between ``low`` and ``high`` percent of the positive's. Ties go to
    the smaller id. Fewer are returned where there are fewer; a positive score
    below zero has an empty window.

    Null ids, labels and vectors and null or non-finite components take no part;
    of rows with one id one stays (``whole_vectors``). Only vectors with as many
    components as the anchor's are compared. Components beyond 2^20 are held
    there. Labels must be whole numbers. Empty table: no rows.

    Every shard meets every block of anchors: work grows with rows times anchors,
    less what the boxes rule out (little, where vectors have no clusters).
    """
    vectors = materialize(whole_vectors(rows, id_col, vector_col, label), "vectors")
    asked = vectors.where(anchor)
    count = vectors.count()
    blocks = max(1, -(-asked.count() // BLOCK_ANCHORS))
    tree = build_tree(vectors, count)
    shards = materialize(tree.select("shard", "dim").distinct(), "shards")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = _meet(tree, shards, asked, blocks, Nearest(positives)).withColumn("r", first).where(F.col("r") <= positives).drop("r")
    near = materialize(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    with_windows = asked.join(near, asked["id"] == near["anchor_id"]).select("id", "label", "v", "positives")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = _meet(tree, shards, with_windows, blocks, Negatives(negatives, low, high)).withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = materialize(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop(vectors, tree, shards, near)
    return out
