import random

import numpy as np

from seamark.llm import passages
from seamark.llm.text import WordHashes, shingle_hashes


def test_passages(spark):
    r = random.Random(4)
    noise = lambda n: [f"n{r.randrange(10**8)}" for _ in range(n)]
    shared, short = noise(70), noise(20)
    edited = shared.copy()
    edited[30] = "changed"
    docs = [(1, noise(100) + shared + noise(40)), (2, noise(33) + edited + noise(7)), (3, noise(300)), (4, noise(10) + short + noise(90)), (5, short + noise(60)), (6, shared + noise(5) + shared)]
    rows = [(i, " ".join(w)) for i, w in docs] + [(7, None), (8, ""), (None, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert {x["doc_id"] for x in got} == {1, 2, 6}
    assert {x["component_id"] for x in got} == {1}
    assert all(x["removed"] == (x["doc_id"] != 1) for x in got)
    first = next(x for x in got if x["doc_id"] == 1)
    assert (first["start_word"], first["n_words"]) == (100, 70)
    assert passages.repeated_passages(df.limit(0)).collect() == []


def test_passages_whose_parts_have_other_leaders(spark):
    """Two documents that share 80 words are found though both halves stand in earlier documents, which share less than 50."""
    r = random.Random(22)
    noise = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    docs = []
    for k in range(0, 160, 4):
        x, y = noise(40), noise(40)
        docs += [(k, noise(30) + x + noise(30)), (k + 1, noise(30) + y + noise(30)), (k + 2, noise(20) + x + y + noise(30)), (k + 3, noise(40) + x + y + noise(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    for parts in (1, 5):
        got = passages.repeated_passages(df.repartition(parts)).collect()
        assert {x["doc_id"] for x in got} == {k + j for k in range(0, 160, 4) for j in (2, 3)}
        for x in got:
            start = 20 if x["doc_id"] % 4 == 2 else 40
            assert start <= x["start_word"] <= start + 2 * passages.STEP and start + 80 - 2 * passages.STEP <= x["start_word"] + x["n_words"] <= start + 80


def test_many_copies_in_one_task(spark):
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(1000)}" for _ in range(80))
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(3)
    got = passages.repeated_passages(df).collect()
    assert len(got) == 300 and [x["doc_id"] for x in got if not x["removed"]] == [0]


def noise(r, n):
    return [f"n{r.randrange(10**9)}" for _ in range(n)]


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def brute(texts, least=50, similar=0.8):
    """Pairs of texts with a stretch of ``least`` words or more, equal at both ends, at a similarity of ``similar``: all stretches of all pairs."""
    out = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            place = {}
            for y, w in enumerate(b):
                place.setdefault(w, []).append(y)
            ends = [(x, y) for x, w in enumerate(a) for y in place.get(w, ())]
            if any(x2 - x1 + 1 >= least and y2 - y1 + 1 >= least and similarity(a[x1 : x2 + 1], b[y1 : y2 + 1]) >= similar for x1, y1 in ends for x2, y2 in ends):
                out.add((j, i))
    return out


def test_passages_against_all_stretches_of_all_pairs(spark):
    """Passages of 50 to 90 words with none to three words replaced, dropped or added."""
    r = random.Random(21)
    texts = []
    for k in range(60):
        shared = noise(r, r.randrange(50, 90))
        edited = shared.copy()
        for _ in range(k % 4):
            at = r.randrange(len(edited))
            edited[at : at + 1] = r.choice([[], noise(r, 1), [edited[at], *noise(r, 1)]])
        texts += [noise(r, 15) + shared + noise(r, 9), noise(r, 8) + edited + noise(r, 14)]
    want = brute(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    got = {(x["component_id"], x["doc_id"]) for x in rows if x["removed"]}
    assert got <= want and len(want) > 40
    assert len(got) >= 0.95 * len(want)
    words = dict(enumerate(texts))
    for x in rows:  # what is reported is really shared
        mate = x["doc_id"] ^ 1
        a = words[x["doc_id"]][x["start_word"] : x["start_word"] + x["n_words"]]
        assert len(a) >= 50 and len(set(a) & set(words[mate])) >= 0.85 * len(a)


def test_passages_do_not_depend_on_partitions(spark):
    """Passages once in one document and twice in another, common lines, and families: the same rows however they are dealt."""
    r = random.Random(5)
    line = noise(r, 30)
    rows = []
    for k in range(40):
        p = noise(r, 60)
        rows += [(2 * k, line + noise(r, 20) + p + noise(r, 9)), (2 * k + 1, p + noise(r, 30) + p + line + noise(r, 5))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = [sorted(tuple(x) for x in passages.repeated_passages(df.repartition(n)).collect()) for n in (1, 2, 16)]
    assert got[0] == got[1] == got[2]
    # the first is in the even document; the odd one's two places are both removed
    assert {(x[0], x[5]) for x in got[0]} == {(i, i % 2 == 1) for i in range(80)} and len(got[0]) == 120


def test_passages_of_repeated_ids_and_odd_rows(spark):
    r = random.Random(8)
    p, q = noise(r, 70), noise(r, 55)
    rows = [
        ("b", " ".join(p + noise(r, 30)), 1, "x"),
        ("b", " ".join(noise(r, 60) + q), 1, "x"),  # one id, two texts: each is compared by its own
        ("b", " ".join(noise(r, 30) + p), 1, "x"),
        ("c", " ".join(noise(r, 7) + q), 1, "x"),
        ("c", " ".join(noise(r, 7) + p), None, None),
        ("d", " ".join(["same"] * 400), 2, "y"),
        ("e", " ".join(["same"] * 90), 2, "y"),
        ("f", " ".join(noise(r, 60_000) + p), 2, "y"),
        (None, " ".join(p), 1, "x"),
        ("g", None, 1, "x"),
        ("h", "", 1, "x"),
    ]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id string, text string, start_word int, component_id string")
    got = sorted((x["doc_id"], x["start_word"], x["n_words"], x["component_id"], x["removed"]) for x in passages.repeated_passages(df).collect())
    want = [("b", 0, 70, "b", False), ("b", 30, 70, "b", True), ("b", 60, 55, "b", False), ("c", 7, 55, "b", True), ("c", 7, 70, "b", True), ("f", 60_000, 70, "b", True)]
    assert [x for x in got if x[0] not in "de"] == want
    assert {x[0] for x in got if x[3] == "d"} == {"d", "e"}


def agree(rows):
    """Do rows of one document that overlap by 25 words agree? Does every cluster keep something, and only of its first document?"""
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
    for mine in by_doc.values():
        mine.sort(key=lambda x: x["start_word"])
        for i, x in enumerate(mine):
            for y in mine[i + 1 :]:
                if min(x["start_word"] + x["n_words"], y["start_word"] + y["n_words"]) - y["start_word"] >= passages.MEET:
                    assert (x["component_id"], x["removed"]) == (y["component_id"], y["removed"]), (x, y)
    for c in {x["component_id"] for x in rows}:
        kept = [x for x in rows if x["component_id"] == c and not x["removed"]]
        assert kept and c == min(x["doc_id"] for x in rows if x["component_id"] == c)


def test_extents_of_one_stretch_are_one_cluster(spark):
    """B and C share other extents of A's stretch: three documents, one cluster, and only the first occurrence stays."""
    r = random.Random(31)
    docs, want = [], {}
    for k in range(0, 90, 3):
        x = noise(r, 120)
        a, b = r.randrange(0, 20), r.randrange(80, 121)
        c, d = r.randrange(0, 40), r.randrange(100, 121)
        parts = [noise(r, 20) + x + noise(r, 20), noise(r, 30) + x[a:b] + noise(r, 10), noise(r, 10) + x[c:d] + noise(r, 30)]
        docs += [(k + j, " ".join(w)) for j, w in enumerate(parts)]
        want |= {k + j: k for j in range(3)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [x.asDict() for x in passages.repeated_passages(df).collect()]
    agree(got)
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert all(x["removed"] == (x["doc_id"] % 3 != 0) for x in got)


def test_what_overlaps_a_kept_stretch_stays(spark):
    """A later document first holds y; its own x is a copy. Both overlap there, so neither is cut out of it, and nothing is lost."""
    r = random.Random(33)
    w = noise(r, 150)
    docs = [(1, noise(r, 20) + w[:90]), (2, noise(r, 10) + w), (3, w[60:] + noise(r, 20))]
    got = [x.asDict() for x in passages.repeated_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")).collect()]
    agree(got)
    assert {x["component_id"] for x in got} == {1}
    kept = {x["doc_id"] for x in got if not x["removed"]}
    assert 1 in kept and 3 not in kept  # w[60:] stays in 2, w[:90] in 1


def test_given_documents_agree(spark):
    from seamark.llm.queries import QUERIES

    rows = [x.asDict() for x in QUERIES["op7_passages"](spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) > 100
    agree(rows)


def test_paragraphs_of_many_texts_are_those_of_each_alone():
    """A plain walk: of 30 neighbouring word pairs the first with the least hash, and the least shingle of 20 words around it."""
    r = random.Random(41)
    words = [[f"w{r.randrange(m)}" for _ in range(n)] for n, m in ((0, 9), (49, 99), (50, 9**9), (300, 40), (400, 1), (1, 9), (700, 9**9))]
    cache = WordHashes()
    hashes = [cache.of([w.encode() for w in t]) for t in words]
    text, start, keys = passages.paragraphs(np.concatenate(hashes), np.array([len(h) for h in hashes]))
    want = []
    for t, h in enumerate(hashes):
        pair, grams, last, previous = shingle_hashes(h, 2), shingle_hashes(h, 5), None, None
        for at in range(len(h) - 30 if len(h) >= 50 else 0):
            least = at + int(pair[at : at + 30].argmin())
            s = min(max(least - 10, 0), len(h) - 20)
            key = [int((grams[s : s + 16] * m).min()) for m in passages._MULTIPLIERS]
            if s != last and key != previous:
                want.append((t, s, key))
                previous = key
            last = s
    low = [[int(x) for x in passages.splitmix(np.array(key, np.uint64) + passages.splitmix(np.arange(2, dtype=np.uint64)))] for _, _, key in want]
    assert [(t, s) for t, s, _ in want] == list(zip(text.tolist(), start.tolist(), strict=True)) and low == keys.tolist()


def test_edited_passages_whose_first_text_has_only_their_line(spark, monkeypatch):
    """A line of 22 words stands first in a text of its own, then in pairs that share an edited passage around it: all pairs are found."""
    r = random.Random(43)
    docs, want, n = [], set(), 0
    for k in range(12):
        line = noise(r, 22)
        docs.append((n, noise(r, 40) + line + noise(r, 40)))
        n += 1
        for j in range(3):
            left, right = noise(r, 20), noise(r, 22)
            edited = left + line + right
            at = (14, 17, 45, 48)[(k + j) % 4]
            edited[at : at + 1] = ([], noise(r, 1), [edited[at], *noise(r, 1)])[(k + j) % 3]
            docs += [(n, noise(r, 12) + left + line + right + noise(r, 30)), (n + 1, noise(r, 31) + edited + noise(r, 9))]
            want.add((n, n + 1))
            n += 2
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    for mates in (250, 2):  # all in one task, and in several
        monkeypatch.setattr(passages, "MATES", mates)
        got = {(x["component_id"], x["doc_id"]) for x in passages.repeated_passages(df).collect() if x["removed"]}
        assert got <= want and len(got) >= 0.95 * len(want), (mates, want - got)


def test_mates_led_anew_give_no_keys_for_another_round(spark, monkeypatch):
    """Gapped keys go to other tasks once: what the second round would write is read by no step."""
    r = random.Random(47)
    line = noise(r, 22)
    docs = [(0, noise(r, 40) + line + noise(r, 40))]
    for n in range(1, 25, 6):
        left, right = noise(r, 20), noise(r, 22)
        docs += [(n + j, noise(r, 12) + left + line + right + noise(r, 30)) for j in range(6)]
    keys, write = [], passages.materialize

    def materialize(table, name):
        out = write(table, name)
        if name == "checked":
            keys.append(out.where("wk is not null and e = 1").count())
        return out

    monkeypatch.setattr(passages, "MATES", 2)
    monkeypatch.setattr(passages, "materialize", materialize)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(x["component_id"], x["doc_id"]) for x in passages.repeated_passages(df).collect() if x["removed"]}
    assert got == {(n, n + j) for n in range(1, 25, 6) for j in range(1, 6)}
    assert keys[0] > 0 and keys[1] == 0, keys
