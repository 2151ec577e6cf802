"""The tree's boxes, its best-first search and the whole operator against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors=lambda i: i % 5 == 0, k=5, m=3, low=50, high=95):
    fine = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v = [math.floor(256 * float(np.float32(c))) for c in x]
            fine[i] = min(fine.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in fine.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, l) for i, (l, w) in fine.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            hit = [(t, i) for t, i, l in scored if l != label and low * -s <= 100 * -t <= high * -s][:m]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(hit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    return sorted(tuple(r) for r in hn.mine(df, F.col("id") % 5 == 0, F.col("label"), **kw).select(*OUT).collect())


def clustered(n, d, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    v = centers[label] + rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), [float(x) for x in v[i]], int(label[i])) for i in range(n)]


def shard_of(v, ids, labels):
    leaves = []
    for c in np.unique(labels):
        rows = np.flatnonzero(labels == c)
        leaves += [rows[x] for x in hn.tile(v[rows], 8)]
    table = pa.table({"lo": [v[r].min(axis=0).astype("<i4").tobytes() for r in leaves], "hi": [v[r].max(axis=0).astype("<i4").tobytes() for r in leaves], "low_label": [int(labels[r].min()) for r in leaves], "high_label": [int(labels[r].max()) for r in leaves], "ids": [ids[r].tobytes() for r in leaves], "labels": [labels[r].tobytes() for r in leaves], "vectors": [v[r].astype("<i4").tobytes() for r in leaves]})
    return hn.Shard(table, v.shape[1])


def test_leaves_hold_every_row_once_and_boxes_bound_scores():
    rng = np.random.default_rng(0)
    for n, d in ((1, 3), (500, 2), (1000, 16), (100, 0)):
        v = rng.integers(-300, 300, (n, d))
        leaves = hn.tile(v, 8)
        assert sorted(np.concatenate(leaves).tolist()) == list(range(n)) and max(map(len, leaves)) <= 8
        shard = shard_of(v, np.arange(n), np.zeros(n, np.int64))
        anchors = rng.integers(-300, 300, (7, d)).astype(np.float64)
        upper, lower = shard.bounds(anchors)
        scores = anchors @ shard.v.T
        for b in range(len(shard.lo)):
            own = scores[:, shard.ends[b] : shard.ends[b + 1]]
            assert (own <= upper[:, b : b + 1]).all() and (own >= lower[:, b : b + 1]).all()


def test_search_is_exact_and_leaves_boxes_out():
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (20, 4)) * 10
    v = np.concatenate([c + rng.integers(-5, 6, (50, 4)) for c in centers])
    ids, labels = rng.permutation(len(v)).astype(np.int64), rng.integers(0, 2, len(v)).astype(np.int64)
    shard = shard_of(v, ids, labels)
    read = []
    rows_of = shard.rows_of
    shard.rows_of = lambda boxes: read.append(len(boxes)) or rows_of(boxes)
    for anchor in v[:30]:
        upper, _ = shard.bounds(anchor[None].astype(np.float64))
        windows = np.array([[0, 10**7], [10**5, 10**6], [5, 4]])
        got = hn.best_first(shard, shard.v.astype(np.float64), anchor.astype(np.float64), upper[0], np.arange(len(shard.lo)), lambda r: shard.labels[r] == 1, windows, 4)
        scores = shard.v @ anchor
        for (low, high), (s, i) in zip(windows, got, strict=True):
            want = sorted((-int(x), int(j)) for x, j, l in zip(scores, shard.ids, shard.labels, strict=True) if l == 1 and low <= x <= high)[:4]
            assert list(zip((-s).tolist(), i.tolist(), strict=True)) == want
    assert sum(read) < 30 * len(shard.lo)


@pytest.mark.parametrize("n, d", [(120, 8), (400, 3)])
def test_operator_equals_brute_force_over_several_shards(spark, monkeypatch, n, d):
    monkeypatch.setattr(hn, "LEAST_ROWS", 20)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 15)
    rows = clustered(n, d)
    got = mined(spark, rows)
    assert got and got == brute(rows)
    assert mined(spark, rows, positives=2, negatives=1, low=10, high=100) == brute(rows, k=2, m=1, low=10, high=100)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    one, two = [0.5, 0.25], [0.25, 0.25]
    rows = [(i, one if i % 2 else two, i % 3) for i in range(40)]  # many equal scores
    rows += [(5, one, 1), (5, two, 0), (41, None, 1), (42, one, None), (None, one, 1), (43, [float("nan"), 1.0], 1), (44, [1.0, float("inf")], 1), (45, [None, 1.0], 2), (50, [], 1), (51, [], 2), (55, [0.5], 1), (56, [0.5], 1), (57, [0.4], 2), (60, [1e6, 1.0], 1), (61, [1e6, 2.0], 1), (62, [7e5, 2.0], 2), (65, [-1.0, -1.0], 1)]
    assert mined(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as shard", "4 as block", "'x' as dim")
    assert mined(spark, df) == brute(rows)
    assert mined(spark, []) == []


def test_huge_components_are_held():
    v = np.array([[hn.MOST] * 100], np.int64)
    assert shard_of(v, np.array([1]), np.array([1])).in_kind_for(v) is np.int64
    assert int((v @ v.T)[0, 0]) == 100 * hn.MOST**2
