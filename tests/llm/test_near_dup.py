import random

import numpy as np
import pytest

from seamark.llm import near_dup as nd
from seamark.llm.graph import connected_components

from . import brute


def family(seed, n, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = base.copy()
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs():
    texts = family(1, 40, 120, 14) + family(2, 12, 40, 6) + family(3, 12, 300, 30)
    texts += ["", None, " \n ", "one", "ONE", "two words", "Two  WORDS", "İ x", "i x", "z " * 9000, "z " * 9001]
    r = random.Random(5)
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, docs, width):
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in docs], "doc_id long, text string, n long, component_id string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, width).collect()), key=repr)
    assert got == brute.near_duplicates(docs, width)


def test_large_family_by_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "BLOCK", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, 2).collect()), key=repr)
    assert got == brute.near_duplicates(docs, 2)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words here now"), (7, "other words here now"), (7, "other words here now"), (None, "lonely text of mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, 2).collect()), key=repr)
    assert got == sorted([(None, 5, 3, False), (3, 5, 3, True), (3, 3, 3, True), (7, 3, 3, False), (7, 3, 3, False), (None, 3, None, True)], key=repr)
    assert nd.near_duplicates(df.limit(0), 2).collect() == []


def test_estimate_and_merge():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, 3000, np.uint64), r.integers(0, 2**64, 3000, np.uint64)
    both = np.concatenate([a[:2000], b])
    s = nd.sketch(np.concatenate([a, both]), np.array([0, 3000]))
    got = nd.joint_estimate(s[:1], s[1:], np.array([3000.0]), np.array([5000.0]))[0]
    assert abs(got - 2000 / 6000) < 0.12
    x, y, u = nd.sketch(np.concatenate([a, b, a, b]), np.array([0, 3000, 6000]))
    assert (nd.merge(x, y) == u).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {x["v"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for v in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
