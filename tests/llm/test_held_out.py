"""Held-out accuracy of the registered queries, and edited benchmark copies against a plain alignment."""

import random
from pathlib import Path

import pytest

from seamark.llm import decontaminate
from seamark.llm.queries import QUERIES

DIR = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def sf_dir():
    if not DIR.is_dir():
        pytest.skip("no test tables")
    return str(DIR)


def test_quality_on_labels_that_were_not_learned(spark, sf_dir):
    got = QUERIES["op2_quality_fm"](spark, sf_dir).persist()
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3) or held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)").count() == 0
    held = [(r["quality"], r["score"]) for r in got.where("held_out").join(labels.where("quality is not null"), "doc_id").collect()]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert len(good) >= 50 and len(bad) >= 10
    assert above / (len(good) * len(bad)) > 0.9
    assert sum(g >= 0.3 for g in good) / len(good) > 0.95


def test_language_of_documents_that_were_not_learned(spark, sf_dir):
    got = QUERIES["op6_langid"](spark, sf_dir).persist()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1 or held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0
    both = got.where("held_out").join(docs.where("lang is not null and text is not null").select("doc_id", "lang"), "doc_id")
    right, n = both.where("lang = lang_pred").count(), both.count()
    assert n > 100 and right / n > 0.98


def plain_alignment(item, words):
    """The best local score: 2 for equal words, -1 for others and for a gap; and how many words match on the way."""
    best = (0, 0)
    above = [(0, 0)] * (len(words) + 1)
    for x in item:
        row = [(0, 0)]
        for j, y in enumerate(words):
            step = above[j]
            over = (step[0] + 2, step[1] + 1) if x == y else (step[0] - 1, step[1])
            cell = max(over, (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0))
            row.append(cell)
            best = max(best, cell)
        above = row
    return best


def test_edited_copies_against_a_plain_alignment(spark):
    """Every copy that a plain alignment with all items would reject is found, unless no four words in a row are left; nothing else is."""
    r = random.Random(31)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(900)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(8, 60))] for _ in range(15)]
    docs = []
    for i in range(260):
        words = []
        for w in r.choice(items) if i % 4 else []:
            u, edits = r.random(), (i % 8) / 24
            words += [] if u < edits / 3 else [r.choice(vocabulary)] if u < edits * 2 / 3 else [w, r.choice(vocabulary)] if u < edits else [w]
        lead, tail = ([r.choice(vocabulary) for _ in range(r.randrange(80))] for _ in range(2))
        docs.append((i, [*lead, *words, *tail]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(df, bench).collect()}
    want = {}
    for i, words in docs:
        for k, item in enumerate(items):
            score, matched = plain_alignment(item, words)
            if score / (2 * len(item)) >= decontaminate.LEAST_SCORE and matched >= min(decontaminate.LEAST_WORDS, len(item)):
                want[i, k] = score / (2 * len(item))
    assert len(want) > 120
    assert set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.03 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert not {i for i, _ in got} & {i for i, _ in docs if i % 4 == 0}
