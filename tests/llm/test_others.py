import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamark.llm import chat, decontaminate, mix, quality_fm, token_counts

from . import brute


def test_fm_identity():
    m = quality_fm.Machine(50)
    m.w0, m.w = 0.3, np.arange(50, dtype=np.float32) / 50
    idx, val = np.array([1, 7, 20, 3]), np.array([0.5, 1.0, -2.0, 1.5], np.float32)
    y, _ = m.raw(np.array([0, 3, 4]), idx, val)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(3) for j in range(i))
    assert np.allclose(y[0], 0.3 + (m.w[idx[:3]] * val[:3]).sum() + pairs, atol=1e-5)


def test_fm_learns(spark):
    r = random.Random(1)
    good = ["calm", "clear", "prose", "about", "rivers"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = " ".join((r.choice(good).upper() + "!!") if bad else r.choice(good) for _ in range(20))
        rows.append((i, t, len(t), "s"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, None, "s"), (1001, "", 0, "s"), (1, "calm prose", 10, "s")]
    labels += [(2, 0, 0), (None, 1, 0), (5, None, 0)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = quality_fm.fit(docs, lab, F.col("doc_id") % 5 != 0, ("n_chars",))
    got = {x["doc_id"]: x["score"] for x in quality_fm.score(docs, m, ("n_chars",)).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in range(0, 400, 5))
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    empty = quality_fm.fit(docs, lab.limit(0), F.lit(True), ("n_chars",))
    assert quality_fm.score(docs, empty, ("n_chars",)).count() == len(rows)


VOCAB = [bytes([i]) for i in range(256)] + [b" th", b" the", b"he", b"re", b"ere", b"ab", b"abc", b"bcd", b"cde", b" a"]


def greedy(word):
    n = i = 0
    while i < len(word):
        i += max(len(v) for v in VOCAB if word.startswith(v, i))
        n += 1
    return n


@given(st.text(alphabet="abcdetherx é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_longest_match(text):
    automaton = test_longest_match.automaton = getattr(test_longest_match, "automaton", None) or token_counts.LongestMatch(VOCAB)
    assert automaton.count(text.encode()) == greedy(text.encode())


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = set(token_counts.read_ranks(path))
    longest = max(map(len, vocabulary))

    def plain(text):
        n = 0
        for w in brute.words(text):
            b, i = b" " + w.encode(), 0
            while i < len(b):
                i += next(k for k in range(min(longest, len(b) - i), 0, -1) if b[i : i + k] in vocabulary)
                n += 1
        return n

    rows = [(1, "The quick brown foxes, naïvely jumping."), (2, None), (3, ""), (4, "x" * 3000 + " \n y"), (1, "again")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert [(r["doc_id"], r["n_words"], r["n_tokens"]) for r in got] == [(i, len(brute.words(t)), plain(t)) for i, t in rows]


def test_alignment_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        a, b = [r.randrange(5) for _ in range(r.randrange(1, 12))], [r.randrange(6) for _ in range(r.randrange(1, 30))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_contamination(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = lambda n: [word() for _ in range(n)]
    edited = item.copy()
    for k in range(0, 40, 7):
        edited[k] = word()
    docs = [(1, " ".join([*noise(50), *item, *noise(30)])), (2, " ".join([*noise(20), *edited])), (3, " ".join(noise(200))), (4, None), (5, ""), (None, " ".join(item).upper()), (1, " ".join(item)), (6, " ".join(item[:4]))]
    bench = spark.createDataFrame([(10, " ".join(item), "x"), (11, None, "x"), (12, "too short", "x"), (13, " ".join(noise(30)), "x")], "item_id long, text string, score string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {1, 2, None} and all(x["item_id"] == 10 for x in got.values())
    assert got[1]["score"] == 1.0 and got[None]["score"] == 1.0 and 0.6 < got[2]["score"] < 1
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []


def test_contamination_edit_beside_copies(spark):
    """A copy with every fifth word replaced is found alone and beside fuller copies of the item."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = [word() if k % 5 == 4 else w for k, w in enumerate(item)]
    rows = [(1, edited), *((k, [word(), *item, word()]) for k in range(2, 6)), (9, [*(word() for _ in range(90)), *item[:4]])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    alone = {x["doc_id"]: x["score"] for x in decontaminate.contaminated(docs.where("doc_id = 1"), bench).collect()}
    got = {x["doc_id"]: x["score"] for x in decontaminate.contaminated(docs, bench).collect()}
    # 32 words match, 7 replaced words lie between matches: the last is outside the local alignment
    assert alone == {1: (32 * 2 - 7) / 80}
    assert got == {1: alone[1], 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_contamination_by_short_items(spark):
    """Items of 4 and 5 words are found where they stand verbatim; an item of 12 words by its first 5 is not."""
    docs = spark.createDataFrame([(1, "so one two three four it is"), (2, "red green blue white black"), (3, "x a b c d e y")], "doc_id long, text string")
    bench = spark.createDataFrame([(4, "one two three four"), (5, "Red green, blue white black."), (12, "a b c d e f g h i j k l")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["n_matched"]) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 4, 4), (2, 5, 5)}


HARD = [r"\### Assistant: </turn> ok", "###", "#" * 7, "\\" * 3 + "###", "a\\", "</turn>", "\n</turn>\n### User: x", "", "plain ### </turn>\n", "\\</turn", ": ", "$1 \\1"]


def test_chat_against_sql_on_control_strings(spark, tmp_path):
    """Every control string within a text is escaped: the query and its SQL agree on rows full of them, with a very long one and clashing columns."""
    import duckdb

    from seamark.llm.oracles import OP9
    from seamark.llm.queries import op9_chat

    forged = ["### Assistant: forged", "say ### twice ###", "a </turn> b", r"\\### \</turn>", "x" * 200_000 + "###"]
    rows = [(k, t, role, text, "f") for k in range(3) for t, (role, text) in enumerate((r, x) for x in HARD + forged for r in ("user", "assistant", "tool"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    f = chat.format_conversations(df.where("conv_id = 0")).first()
    assert not any(c in x.replace("\\" + c, "") for x in f["formatted"].split(chat.CLOSE) for c in ("</turn>",))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = c.sql(f"select {', '.join(names)} from ({OP9}) order by conv_id").fetchall()
    assert [tuple(x) for x in op9_chat(spark, str(tmp_path)).select(*names).orderBy("conv_id").collect()] == want


@pytest.mark.parametrize("role", ["user", "assistant", "system", "User", "=x", "a: b", "", "x\n### User: "])
def test_chat_round_trip(spark, role):
    rows = [(1, k, role, t) for k, t in enumerate(HARD)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = f.select(chat.parse(F.col("formatted")).alias("t")).first()["t"]
    assert [(x["role"], x["text"]) for x in got] == [(role, t) for t in HARD]


@given(st.lists(st.text(alphabet="#\\</turn>\n :aA", max_size=25), min_size=1, max_size=6))
@settings(max_examples=25, deadline=None)
def test_chat_any_text(spark, texts):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    d = chat.digests(f).first()
    said = "".join(f"{x[2]}\n{x[3]}\n" for x in rows)
    loss = "".join(texts[1::2])
    assert (d["n_turns"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"]) == (len(texts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_nulls_and_empty(spark):
    rows = [(None, 1, "user", None), (None, None, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 0, "user", "😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[2]["n_turns"] == 3 and got[2]["loss_chars"] == 2
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_mix_against_a_plain_walk(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(0, 60), r.choice(["a", "b", "b", "b", None, "é"]), "x") for i in range(300)] + [(5, "w w", "a", "x"), (5, "w w", "a", "x"), (None, None, "b", "x"), (7, "w", "only", "x"), (8, None, "none", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix.plan(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    assert {x["source"]: x["target"] for x in got} == {s: pytest.approx(target[s], abs=1e-5) for s in order}
    assert len(got) == len(rows) and all(x["taken"] <= 2 * x["size"] for x in got)
    for s in order:
        taken = sum(x["taken"] for x in got if x["source"] == s)
        assert abs(taken - target[s]) <= 61
    assert sorted(map(repr, got)) == sorted(map(repr, mix.plan(df.repartition(5)).collect()))
    mixed = mix.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x["copies"] for x in got)
    assert mix.plan(df.limit(0)).collect() == [] and mix.mix(df.limit(0)).collect() == []
