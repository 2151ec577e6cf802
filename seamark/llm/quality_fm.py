"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
all pairwise interactions at low rank, in time linear in the features (Rendle,
"Factorization Machines").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize
from .text import U64, WordHashes, offsets, text_slices

BITS, RANK = 16, 8
BUCKETS = 1 << BITS
#: Features of the text's structure, in this order after the hashed words; then one for each metadata column.
STRUCTURE = ("one", "log_words", "mean_word", "upper", "digits", "symbols", "bars", "shouts", "stops", "non_ascii", "lines", "distinct", "same_as_last", "top_word", "capital_words")
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 128, 0.05, 1e-5, 7


def structure(text: bytes, words: list[bytes], counts: np.ndarray, hashes: np.ndarray) -> list[float]:
    n, size = max(len(words), 1), max(len(text), 1)
    raw = np.frombuffer(text, np.uint8)
    table = np.bincount(raw, minlength=256)
    upper = int(table[65:91].sum())
    letters = max(upper + int(table[97:123].sum()), 1)
    same = int(np.count_nonzero(hashes[1:] == hashes[:-1])) if len(hashes) > 1 else 0
    return [
        1.0,
        np.log1p(len(words)) / 10,
        min(size / n / 10, 5.0),
        upper / letters,
        int(table[48:58].sum()) / size * 5,
        int(table[[35, 36, 37, 38, 42, 60, 62, 64]].sum()) / n,
        int(table[124]) / n,
        int(table[33]) / n,
        int(table[[46, 44, 59, 63]].sum()) / n,
        int(table[128:].sum()) / size,
        int(table[10]) / n * 5,
        len(counts) / n,
        same / n * 3,
        (int(counts.max()) if len(counts) else 0) / n * 3,
        sum(w[:1].isupper() for w in words) / n,
    ]


def features(texts: list[bytes], metadata: list[list[float]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, indices and values of each text's features; word weights have length one."""
    idx, val = [], []
    for t, meta in zip(texts, metadata, strict=True):
        words = t.split()
        h = cache.of([w.lower() for w in words])
        bucket, counts = np.unique((h >> U64(64 - BITS)).astype(np.int32), return_counts=True)
        weight = 1.0 + np.log(counts) if len(counts) else np.zeros(0)
        weight = weight / max(np.sqrt((weight**2).sum()), 1e-9)
        extra = structure(t, words, counts, h) + meta
        idx.append(np.concatenate([bucket, np.arange(BUCKETS, BUCKETS + len(extra), dtype=np.int32)]))
        val.append(np.concatenate([weight, extra]).astype(np.float32))
    ptr = offsets([len(x) for x in idx])
    return ptr, np.concatenate(idx) if idx else np.zeros(0, np.int32), np.concatenate(val) if val else np.zeros(0, np.float32)


class Machine:
    def __init__(self, width: int):
        rng = np.random.default_rng(SEED)
        self.w0 = 0.0
        self.w = np.zeros(width, np.float32)
        self.v = rng.normal(0, 0.02, (width, RANK)).astype(np.float32)

    def raw(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and the factor sums, by the sum-of-squares identity. Every row has features."""
        at = ptr[:-1]
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        y = self.w0 + np.add.reduceat(self.w[idx] * val, at) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), at))
        return y, s

    def fit(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> Machine:
        """AdaGrad on the logistic loss; the order of rows is shuffled by a fixed seed."""
        rng = np.random.default_rng(SEED)
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                pick = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
                p, i, x = offsets([ptr[r + 1] - ptr[r] for r in rows]), idx[pick], val[pick]
                out, s = self.raw(p, i, x)
                err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)
                own = np.repeat(np.arange(len(rows)), np.diff(p))
                e = (err[own] * x).astype(np.float32)
                used, back = np.unique(i, return_inverse=True)
                dw = np.bincount(back, e, len(used)).astype(np.float32) + DECAY * self.w[used]
                grad = e[:, None] * (s[own] - self.v[i] * x[:, None])
                dv = np.stack([np.bincount(back, grad[:, f], len(used)) for f in range(RANK)], 1).astype(np.float32) + DECAY * self.v[used]
                g0 += float(err.sum()) ** 2
                gw[used] += dw**2
                gv[used] += dv**2
                self.w0 -= RATE * float(err.sum()) / np.sqrt(g0)
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
        return self


def _metadata(b: pa.RecordBatch, first: int) -> list[list[float]]:
    """Numeric metadata as log(1 + |x|) / 10, null as 0."""
    columns = [b.column(i).to_pylist() for i in range(first, b.num_columns)]
    return [[float(np.log1p(abs(c[r]))) / 10 if c[r] is not None else 0.0 for c in columns] for r in range(b.num_rows)]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, y, idx, val``: places and values of each labelled row's features, as bytes."""
    cache = WordHashes()
    for b, texts in text_slices(batches, "text"):
        ptr, idx, val = features(texts, _metadata(b, 3), cache)
        cut = list(zip(ptr[:-1], ptr[1:], strict=True))
        parts = [pa.array([x[s:e].tobytes() for s, e in cut], pa.binary()) for x in (idx, val)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], names=["id", "y", "idx", "val"])


def _train(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, val, labels = [], [], []
        for b in batches:
            idx += [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
            val += [np.frombuffer(x, np.float32) for x in b.column(2).to_pylist()]
            labels += b.column(0).to_pylist()
        m = Machine(width)
        if labels:
            m.fit(offsets([len(x) for x in idx]), np.concatenate(idx), np.concatenate(val), np.asarray(labels, np.float64))
        yield pa.RecordBatch.from_pylist([{"w0": m.w0, "w": m.w.tobytes(), "v": m.v.tobytes()}], pa.schema([("w0", pa.float64()), ("w", pa.binary()), ("v", pa.binary())]))

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """A machine fitted on at most SAMPLE labelled rows where ``learn`` (over ``labels``) holds.

    Rows are drawn by a hash of the id. Null ids, and ids whose labels differ or
    are not 0 or 1, are not learned from; a repeated id counts once. The sample,
    bounded by a parameter, is broadcast to fetch its texts. Features are made where
    the texts are; the one task that fits gets features alone, 8 bytes for each
    distinct hashed word of a text and so at most 0.6 MB a row however long it is.
    """
    known = labels.where(learn & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"), F.count(label_col).alias("k"))
    known = known.where("y = z and y in (0, 1)").select("id", F.col("y").cast("double").alias("y")).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE)
    known = materialize(known, "labels")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    meta = [f"m{i}" for i in range(len(metadata))]
    rows = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in meta])
    width = BUCKETS + len(STRUCTURE) + len(metadata)
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.select("id", "y", "text", *meta).mapInArrow(_featurize, f"id {kind}, y double, idx binary, val binary")
    made = made.repartition(1).sortWithinPartitions("id").select("y", "idx", "val")
    m = made.mapInArrow(_train(width), "w0 double, w binary, v binary").first()
    drop(known)
    out = Machine(width)
    if m is None:  # no labelled rows: the machine as it starts
        return out
    out.w0, out.w, out.v = m["w0"], np.frombuffer(m["w"], np.float32), np.frombuffer(m["v"], np.float32).reshape(-1, RANK)
    return out


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, score`` in 0 to 1.

    Null or empty text is scored from its (zero) structure and metadata. A map
    over rows without a shuffle; the machine's size is fixed by BITS and RANK.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, WordHashes()
        for b, texts in text_slices(batches, "text", 1 << 20):
            y, _ = m.raw(*features(texts, _metadata(b, 2), cache))
            p = 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=[id_col, "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, score double")
