"""The pointer sort against Python's own, and the audit against plain arithmetic."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seamark.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for lang in {r[2] or "" for r in rows}:
        mine = [(words(r[1]), r[3] or "") for r in rows if (r[2] or "") == lang]
        df = Counter(w for ws, _ in mine for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        count = {s: Counter(w for ws, x in mine for w in ws if x == s and w in kept) for s in {s for _, s in mine}}
        everything = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s, c in count.items():
            f = lambda p, q: (p - q) ** 2 // q
            pair = [(sum(f(share(c, w), share(d, w)) for w in kept), h) for h, d in count.items() if h != s]
            term = [(f(share(c, w), share(everything, w)), w) for w in c if share(c, w) > share(everything, w)]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def audit(spark, rows, **kw):
    return sorted(tuple(r) for r in sa.divergence(spark.createDataFrame(rows, SCHEMA), **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abABzé一 .1", max_size=40), max_size=12))
def test_pointers_are_in_the_order_of_their_words(texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.concatenate([np.frombuffer(b"".join(raw), np.uint8), np.zeros(8, np.uint8)])
    starts, lengths = sa.word_pointers(data, bounds[:-1])
    want = [(bounds[i] + m.start(), m[0]) for i, r in enumerate(raw) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", r)]
    assert list(zip(starts.tolist(), lengths.tolist(), strict=True)) == [(p, len(w)) for p, w in want]
    order, head = sa.pointer_sort(data, starts, lengths)
    placed = sorted(want, key=lambda x: (x[1], x[0]))
    assert starts[order].tolist() == [p for p, _ in placed]
    assert head.tolist() == [i == 0 or placed[i - 1][1] != placed[i][1] for i in range(len(placed))]


def test_words_that_share_hundreds_of_letters():
    words = [b"a" * k + e for k in (7, 8, 9, 64, 300, 300, 1000) for e in (b"", b"b", b"c")] * 2
    data = np.concatenate([np.frombuffer(b" ".join(words), np.uint8), np.zeros(8, np.uint8)])
    starts, lengths = sa.word_pointers(data, np.zeros(1, np.int64))
    order, head = sa.pointer_sort(data, starts, lengths)
    found = [data[s : s + n].tobytes() for s, n in zip(starts[order], lengths[order], strict=True)]
    assert found == sorted(words)
    assert head.sum() == len(set(words))


def test_audit_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{w}{x}" for w in ("term", "wort", "été", "I") for x in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30))) + ("!" if i % 3 else ""), ["en", "de", None][i % 3], ["s1", "s2", None, "É", "z"][int(rng.integers(5))]) for i in range(80)]
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows, top=2, least_docs=1) == brute(rows, 1, 2)


def test_shards_do_not_show(spark, monkeypatch):
    rows = [(i, f"word{'abc'[i % 3]} other Word{'abc'[i % 3].upper()} plain{'xy'[i % 2]}", "en", f"s{i % 4}") for i in range(60)]
    want = brute(rows)
    for size in (1, 50, 1000):
        monkeypatch.setattr(sa, "SHARD_BYTES", size)
        batches = [b for b in sa.pa.Table.from_pylist([{"text": r[1], "lang": r[2], "source": r[3]} for r in rows]).to_batches(max_chunksize=7)]
        got = Counter()
        for b in sa._count(iter(batches)):
            for r in b.to_pylist():
                got[(r["source"], r["term"])] += r["n"]
        assert got == Counter((r[3], w.lower()) for r in rows for w in re.findall("[A-Za-z]+", r[1]))
    monkeypatch.undo()
    assert audit(spark, rows) == want


def test_many_sources_are_summed_in_blocks(spark, monkeypatch):
    rows = [(i, f"a{'x' * (i % 3)} common c", "en", f"s{i % 7}") for i in range(70)]
    monkeypatch.setattr(sa, "SOURCES", 3)  # blocks of sources in the plan; the workers keep theirs
    table = [{"lang": "en", "block": g, "p": [int(x) for x in np.random.default_rng(t).integers(1, 10**9, 7)]} for t in range(5) for g in range(3)]
    got = {}
    for b in sa._pairs(iter(sa.pa.Table.from_pylist(table, sa.pa.schema([("lang", sa.pa.string()), ("block", sa.pa.int32()), ("p", sa.pa.list_(sa.pa.int64()))])).to_batches())):
        got |= {(r["g"], r["h"]): r["value"] for r in b.to_pylist()}
    ps = [r["p"] for r in table if r["block"] == 0]
    assert got == {(g, h): sum((p[g] - p[h]) ** 2 // p[h] for p in ps) for g in range(7) for h in range(7)}
    monkeypatch.undo()
    assert audit(spark, rows) == brute(rows)


def test_nulls_empty_texts_long_texts_and_repeats(spark):
    assert audit(spark, []) == []
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, "...", "en", "t"), (3, "x " * 300_000 + "y" * 50_000, "de", "s"), (3, "x", "de", "s"), (3, "x", "de", "s"), (4, "y" * 50_000, "de", "")]
    assert audit(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as n", "3 as value", "'q' as item")
    assert sorted(tuple(r) for r in sa.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows)
