"""Pieces against the tokenizer itself: every id once, gapless sequences, no padding."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seamark.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string"


def ids_of(text):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def holds(docs, pieces, width=2048):
    """Is each id of each row in one piece, each sequence gapless, and none in need of padding? ``docs``: (doc_id, text) of distinct ids."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        want, mine = ids_of(text), sorted(by_doc[d], key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(want[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want)
    gapless(pieces, width)


def gapless(pieces, width=2048):
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= width and n & (n - 1) == 0 for n in ends.values())
    return ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab 1.,\u2003\n\t'é  \u0085一s", max_size=30), min_size=1, max_size=6))
@example(["a \n \nb", "  x", "x  ", "x   y", "   y", "it's <|endoftext|> a", "a — b", "— ", " ", "", "a.\nb, c\nd.", "é.\n\nb", ".\na", "a\u2003\nb c", "a.\n"])
def test_ids_of_chunks_are_those_of_whole_texts(texts):
    cache = pk.chunk_cache(PATH)
    got = [np.frombuffer(x, cache.kind).tolist() for x in cache.encode([t.encode() for t in texts])]
    assert got == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_emptied(monkeypatch):
    cache = pk.ChunkIds(PATH)
    monkeypatch.setattr(pk.ChunkIds, "LIMIT", 3)
    for texts in (["a b c d"], ["e f", "g a b"], ["a"]):
        assert [np.frombuffer(x, cache.kind).tolist() for x in cache.encode([t.encode() for t in texts])] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeats_are_a_least_squares_solution():
    rng = np.random.default_rng(0)
    for width in (16, 64):
        h = np.append(0, rng.integers(0, 50, width - 1)).astype(np.int64)
        columns = pk.combinations(h)
        assert all(sum(n for n in c if n < width) == width or (c[1] == width and c[0] & (c[0] - 1) == 0) for c in columns.tolist())
        a = np.zeros((width, len(columns)))
        for j, c in enumerate(columns):
            for n in c[c < width]:
                a[n, j] += 1
        x = pk.repeats(h, columns, 20_000)
        slope = a.T @ (a @ x - h)  # at the optimum: none below zero, and zero where x is used
        assert (x >= 0).all() and slope.min() > -1e-3 and abs(slope @ x) < 1e-2 * max(1, h @ h) ** 0.5
        k = pk.whole_repeats(h, columns, x)
        assert (a @ k <= h).all()
        left = h - a @ k
        assert not any((left >= a[:, j]).all() for j in range(len(columns)))  # no combination is left


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60), st.integers(0, 60))
def test_rest_is_packed_without_padding(lengths, cut):
    pieces = [(i, 0, n) for i, n in enumerate(lengths)]
    first, k, left = pk.pack_rest(pieces[:cut], 32, False)
    then, _, none = pk.pack_rest(left + pieces[cut:], 32, True)
    placed = first + [(r, s, n, q + k, o) for r, s, n, q, o in then]
    assert none == []
    gapless([{"sequence_id": q, "offset": o, "length": n} for _, _, n, q, o in placed], 32)
    for i, n in enumerate(lengths):
        at = 0
        for _, s, m, _, _ in sorted(p for p in placed if p[0] == i):
            assert s == at
            at += m
        assert at == n


def test_query_on_given_documents(spark):
    from seamark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = [r.asDict() for r in QUERIES["op13_packing"](spark, sf).collect()]
    holds(docs, pieces)
    # most documents lie in as few pieces as their length allows
    n = {p["doc_id"]: -(-p["doc_tokens"] // 2048) for p in pieces}
    assert sum(k == sum(p["doc_id"] == d for p in pieces) for d, k in n.items()) >= 0.9 * len(docs)


def test_many_equal_lengths_over_many_tasks(spark):
    docs = [(i, "word " * (60 if i % 3 else 100) + "end") for i in range(600)] + [(-1, "long text " * 30_000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    for width in (256, 2048):
        holds(docs, [r.asDict() for r in pk.pack(df, PATH, width=width).collect()], width)


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    assert pk.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "x"), (1, ""), (1, ""), (2, "a b")], SCHEMA).selectExpr("*", "1 as row", "2 as part", "3 as rest", "'q' as ids", "5 as pieces")
    pieces = [r.asDict() for r in pk.pack(docs, PATH).collect()]
    gapless(pieces)
    tokens = {d: sorted(p["doc_tokens"] for p in pieces if p["doc_id"] == d and p["start"] == 0) for d in (None, 1, 2)}
    assert tokens == {None: [1, 2], 1: [1, 1], 2: [3]}
    assert sum(p["length"] for p in pieces) == 8
    assert sum(p["length"] for p in pk.pack(docs, PATH, end_id=None).collect()) == 3
