import math
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import kn_rules as kn
from seamark.llm import langid

from . import brute

ODD = ["", None, "one", "a b c d e a b c d e", "l\nl\n\nl\n l", "x # y * z $%&|<>", "é ü ß\tñ\x0bq", "a " * 30, "line one two three\n" * 5, "w\r\nw\r\n"]


@pytest.mark.parametrize("text", ODD)
def test_base_counts(text):
    assert kn.base_counts((text or "").encode()) == brute.base_counts(text)


def test_base_counts_random():
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choice(["a", "b", "c d", " ", "\n", "#", "é"]) + r.choice(["", " "]) for _ in range(r.randrange(80)))
        assert kn.base_counts(text.encode()) == brute.base_counts(text)


def test_codes_are_per_text():
    texts = ["ab", "", "xyz", "q\x00é漢"]
    codes, sizes = kn.codes_of([t.encode() for t in texts])
    assert sizes.tolist() == [2, 0, 3, 4]
    assert codes.tolist() == [c for t in texts if t for c in kn.codes_of([t.encode()])[0].tolist()]
    assert codes[:2].tolist() == [ord("a"), ord("a") << 10 | ord("b")]


def plain_kneser_ney(texts, least, usual=0):
    """Interpolated modified Kneser-Ney over document counts by dictionaries of tuples; all is counted before any is pruned."""
    level = {}
    for t in texts:
        s = [0] * 4 + [ord(c) for c in t]
        for g in {tuple(s[i - 4 : i + 1]) for i in range(4, len(s))}:
            level[g] = level.get(g, 0) + 1
    levels = {5: level}
    for size in (4, 3, 2, 1):
        levels[size] = {}
        for g in levels[size + 1]:
            levels[size][g[1:]] = levels[size].get(g[1:], 0) + 1

    common = {g for g, n in levels[5].items() if n >= usual}

    def prob(g, size):
        if size == 0:
            return 1 / 1024
        level = levels[size]
        t = [sum(v == k for v in level.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        d = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] and t[k] else min(0.5 * k, k - 0.05) for k in (1, 2, 3)]
        mine = {w[-1]: n for w, n in level.items() if w[:-1] == g[:-1]}
        total = sum(mine.values())
        value = {w: (n - d[min(n, 3) - 1]) / total for w, n in mine.items() if n >= least and any(c[5 - size :] == (*g[:-1], w) for c in common)}
        return value.get(g[-1], 0.0) + (1 - sum(value.values())) * prob(g[1:], size - 1)

    return lambda g: prob(g, 5)


@pytest.mark.parametrize("least, usual", [(0, 0), (2, 0), (0, 2), (2, 2)])
def test_kneser_ney_of_all_orders(spark, least, usual):
    texts = ["the cat sat on the mat and the hat", "a cat that sat", "the the the"]
    df = spark.createDataFrame([(t, None) for t in texts], "text string, lang string").withColumn("n", F.lit(0))
    counts = kn.count_ngrams(df).groupBy("lang", F.lit(0).alias("fold"), "code").agg(F.sum("n").alias("n")).withColumn("usual", F.col("n") >= usual)
    model = kn.collect_models(kn.weights(kn.all_orders(counts), least))[None, 0]
    plain = plain_kneser_ney(texts, least, usual)
    some = ["the c", "at th", "xxxxx", "the x", "cat s", "xxxxe"] + [t[i : i + 5] for t in texts for i in range(0, len(t) - 5, 3)]
    codes = np.array([kn.codes_of([g.encode()])[0][-1] for g in some])
    want = [math.log(plain(tuple(map(ord, g)))) for g in some]
    assert np.allclose(kn.log_p(model, codes), want, atol=1e-4)
    context = kn.codes_of([b"the "])[0][-1] << 10  # all that may follow adds up to one
    assert math.isclose(np.exp(kn.log_p(model, context | np.arange(1024))).sum(), 1, abs_tol=1e-4)


def test_least_count_keeps_so_many(spark):
    grams = spark.createDataFrame([(c, n) for c, n in enumerate([1] * 50 + [2] * 20 + [3] * 5 + [9])], "code long, n long")
    for most in (76, 75, 26, 25, 6, 5, 1, 0):
        least = kn.least_count(grams, most)
        assert grams.where(F.col("n") >= least).count() <= most < grams.where(F.col("n") >= least - 1).count() or least == 1


def test_rules(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    clean = [(i, " ".join(r.choice(vocabulary) for _ in range(60)), "en", "x") for i in range(300)]
    bad = [(900, " ".join("QZX!!" + "JKQ" * 3 + "$" for _ in range(60)) + " a b c d", "en", "x"), (901, "again and again we go " * 20, "en", "x"), (902, "too short", "en", "x"), (903, None, "en", "x"), (904, "", None, "x"), (905, clean[0][1], None, "x")]
    df = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, kept string")
    got = {x["doc_id"]: x for x in kn.quality_rules(df).collect()}
    assert len(got) == len(clean) + len(bad)
    assert sum(not got[i]["kept"] for i in range(300)) <= 3
    assert not got[900]["kept"] and (not got[900]["base_failed"] or got[900]["n_repeat_words"])
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903, 904))
    assert got[905]["kept"]
    assert kn.quality_rules(df.limit(0)).collect() == []


SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grams = kn.materialize(kn.all_orders(kn.usual(kn.count_ngrams(docs), docs)), "grams")
    return docs, grams, kn.quality_rules(docs)


def test_discounts_of_every_order_are_estimated_from_all_counts(spark, given_model):
    _, grams, _ = given_model
    d = {(r["lang"], r["fold"], r["size"]): (r["d1"], r["d2"], r["d3"]) for r in kn.discounts(grams).collect()}
    t = {(r["lang"], r["fold"], r["size"], r["n"]): r["count"] for r in grams.where("n <= 4").groupBy("lang", "fold", "size", "n").count().collect()}
    top = [k for k in d if k[2] == kn.ORDER]
    assert len(top) == 8
    for key in top:
        t1, t2, t3, t4 = (t[*key, n] for n in (1, 2, 3, 4))
        y = t1 / (t1 + 2 * t2)
        assert np.allclose(d[key], [1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3])
        assert 0 < d[key][0] < d[key][1] < d[key][2] < 3
    rare = grams.where(f"size = {kn.ORDER} and n <= 4")
    assert rare.count() > 0.5 * grams.where(f"size = {kn.ORDER}").count()  # what pruning leaves out did count


def test_verdicts_on_labels_that_did_not_pick_the_width(spark, given_model):
    _, _, verdicts = given_model
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    j = verdicts.where(~F.col("base_failed") & odd).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.01 * n[1, True]


def test_shuffled_letters_are_rejected_and_shuffled_words_score_worse(spark, given_model):
    docs, _, verdicts = given_model
    clean = docs.join(verdicts.where("kept and n_words between 150 and 600").select("doc_id"), "doc_id").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect()
    r = random.Random(3)
    made = []
    for x in clean:
        words = x["text"].split()
        r.shuffle(words)
        letters = "".join(r.sample(x["text"], len(x["text"])))
        made += [(-2 * x["doc_id"] - 2, " ".join(words), "en"), (-2 * x["doc_id"] - 1, letters, "en")]
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    got = {v["doc_id"]: v for v in kn.quality_rules(more).where("doc_id < 0 or doc_id in (%s)" % ", ".join(str(x["doc_id"]) for x in clean)).collect()}
    assert sum(not got[-2 * x["doc_id"] - 1]["kept"] for x in clean) == len(clean)
    # the given texts are chains of letters: the order of their words says little, but what it says is seen
    assert sum(got[-2 * x["doc_id"] - 2]["log_ppl"] > got[x["doc_id"]]["log_ppl"] for x in clean) >= 0.9 * len(clean)


def test_quartiles_are_exact(spark):
    values = np.random.default_rng(1).normal(2, 0.3, 999)
    df = spark.createDataFrame([("en", float(v)) for v in values] + [(None, 1.0)], "lang string, log_ppl double")
    got = {r["lang"]: (r["lower"], r["middle"], r["upper"]) for r in kn.quartiles(df.repartition(5)).collect()}
    assert np.allclose(got["en"], np.quantile(values, [0.25, 0.5, 0.75], method="inverted_cdf"), atol=1 / kn.STEPS)
    assert np.allclose(got[None], 1.0, atol=1 / kn.STEPS)


def naive_phrases(text, model):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in model:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_by_brute_force():
    r = random.Random(3)
    model = bytes(r.choice(b"abcd ") for _ in range(400))
    p = langid.Parser(model)
    texts = [bytes(r.choice(b"abcdz ") for _ in range(r.randrange(0, 700))) for _ in range(40)]
    got = langid.phrase_counts(texts, [p])[:, 0].tolist()
    assert got == [naive_phrases(t, model) if t else 0 for t in texts]


def test_long_texts_are_parsed_whole():
    """The phrases of long texts, whatever the places where pieces are cut, are those of the whole text."""
    r = random.Random(13)
    model = b"the quick brown fox jumps over the lazy dog " * 3 + bytes(r.choice(b"abcd ") for _ in range(3000))
    texts = [b"the quick brown " * 1000, model * 3, bytes(r.choice(b"abcdz ") for _ in range(20_000)), b"dog", b"", b"x" * 5000, (b"lazy dog the" + b"q") * 700]
    got = langid.phrase_counts(texts, [langid.Parser(model), langid.Parser(b"quick " * 20)])
    assert got[:, 0].tolist() == [naive_phrases(t, model) for t in texts]
    assert got[:, 1].tolist() == [naive_phrases(t, b"quick " * 20) for t in texts]


def test_sample_has_each_text_once(spark):
    rows = [(i, "copied words here and there " * 200, "en") for i in range(500)] + [(600 + i, f"own text number {chr(97 + i)} of few", "en") for i in range(20)]
    (lang, sample), = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert lang == "en" and sample.count(b"own text number") >= 18 and len(sample) <= langid.MOST_BYTES


def test_language(spark):
    r = random.Random(7)
    en, de = ["the", "with", "thing", "over", "mother"], ["und", "nicht", "schon", "über", "mutter"]
    rows = [(i, " ".join(r.choice(w) for _ in range(40)), lang) for i, (w, lang) in enumerate([(en, "en"), (de, "de")] * 40)]
    rows += [(900, "the mother with nothing", None), (901, "12 -- !!", "en"), (902, None, "de"), (903, "", None), (904, "nicht schon " * 5000, None), (904, "nicht schon " * 5000, None)]
    df = spark.createDataFrame([(*x, 0.5, "z") for x in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    samples = langid.fit(df, F.col("doc_id") < 60)
    assert [n for n, _ in samples] == ["de", "en"] and sum(len(s) for _, s in samples) <= langid.TOTAL_BYTES
    got = {x["doc_id"]: x for x in langid.identify(df, samples).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(60, 80))
    assert got[900]["lang_pred"] == "en" and got[904]["lang_pred"] == "de" and all(got[i]["lang_pred"] == "und" for i in (901, 902, 903))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.fit(df.limit(0), F.lit(True)) == []
    assert {x["lang_pred"] for x in langid.identify(df, []).collect()} == {"und"}


def test_languages_beyond_one_broadcast_are_scored_in_rounds_and_lose_no_ngram(spark, monkeypatch):
    r = random.Random(8)
    say = lambda k: " ".join("".join(r.choices("abcdefgh"[k:] + "xyz", k=5)) for _ in range(60))
    data = [(40 * k + i, say(k), lang) for k, lang in enumerate(["en", "de", "fr", None]) for i in range(40)] + [(900, "", "en"), (901, None, None), (902, say(0), "alone")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    want = sorted(map(tuple, kn.quality_rules(df).collect()))
    calls, collect = [], kn.collect_models

    def collected(weights):
        models = collect(weights)
        calls.append({(*key, size): [len(a) for a in arrays] for key, sizes in models.items() for size, arrays in sizes.items()})
        return models

    monkeypatch.setattr(kn, "collect_models", collected)
    kn.quality_rules(df)
    monkeypatch.setattr(kn, "rounds", partial(kn.rounds, most=1))
    assert sorted(map(tuple, kn.quality_rules(df).collect())) == want
    whole, *each = calls
    assert len(each) == len({k[:2] for k in whole}) and {k: v for part in each for k, v in part.items()} == whole


def test_every_ngram_is_scored_however_rare(spark):
    """Perplexity by a model of all n-grams, against dictionaries; rare ones are told apart from unknown ones."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcde", k=4)) for _ in range(12)) for _ in range(60)]
    texts += [f"rare {t}" for t in texts[:3]] + [f"rare{i} zq" for i in range(8)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    fold = {x["doc_id"]: x["fold"] for x in df.select("doc_id", kn.fold_of(F.col("text")).alias("fold")).collect()}
    got = {x["doc_id"]: x for x in kn.quality_rules(df).collect()}
    plain = {f: plain_kneser_ney([t for i, t in enumerate(texts) if fold[i] == f], 0) for f in (0, 1)}
    for i in [0, *range(60, len(texts))]:
        s = [0] * 4 + [ord(c) for c in texts[i]]
        want = [-math.log(plain[1 - fold[i]](tuple(s[k - 4 : k + 1]))) for k in range(4, len(s))]
        assert math.isclose(got[i]["log_ppl"], sum(want) / len(want), rel_tol=1e-4)
        assert got[i]["usual_log_ppl"] is not None


def test_a_model_beyond_one_broadcast_is_scored_by_slices(spark, monkeypatch):
    r = random.Random(8)
    say = lambda k: " ".join("".join(r.choices("abcdefgh"[k:] + "xyz", k=5)) for _ in range(60))
    data = [(40 * k + i, say(k), lang) for k, lang in enumerate(["en", None]) for i in range(40)] + [(900, "", "en"), (901, None, None), (902, say(0), "alone"), (0, say(0), "en")]
    data += [(i, t, lang) for i, t, lang in data[:3]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    want = sorted(map(tuple, kn.quality_rules(df).collect()), key=repr)
    sizes, collect = [], kn.collect_models

    def collected(weights):
        models = collect(weights)
        sizes.append(sum(len(a[4]) + len(a[6]) for m in models.values() for a in m.values()))
        return models

    monkeypatch.setattr(kn, "collect_models", collected)
    monkeypatch.setattr(kn, "MOST_GRAMS", 2000)
    monkeypatch.setattr(kn, "rounds", partial(kn.rounds, most=2000))
    got = sorted(map(tuple, kn.quality_rules(df).collect()), key=repr)
    assert len(sizes) > 8 and max(sizes) < 4000  # a slice is of whole pairs of symbols, of which there are about a hundred here
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))
