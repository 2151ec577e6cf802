import random
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seamark.llm import decontaminate, kn_rules, mix
from seamark.llm.oracles import ORACLES
from seamark.llm.queries import QUERIES

from . import brute

DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sf_dir():
    if not DIR.is_dir():
        pytest.skip("no test tables")
    return str(DIR)


def test_stages_one_by_one(spark, sf_dir):
    """Each stage's decision against the operator or a plain version, on all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    verdict = {r["doc_id"] for r in kn_rules.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict and kept.columns == docs.columns

    single = stages["near duplicates"](spark, kept, sf_dir).cache()
    plain = brute.near_duplicates([(r["doc_id"], r["text"]) for r in kept.collect()], 5)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, _, k in plain if k)

    clean = stages["decontamination"](spark, single, sf_dir).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()}
    holds = {r["doc_id"] for r in single.collect() if any(t in r["text"] for t in items)}
    assert holds <= gone

    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    plan = {r["doc_id"]: r["copies"] for r in mix.plan(clean).collect()}
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: c for i, c in plan.items() if c}

    out = stages["token ids"](spark, mixed, sf_dir).collect()
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    assert len(out) == mixed.count() and all(r["n_tokens"] == n[r["doc_id"]] for r in out)


def test_stages_on_nulls_and_empty(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "some words " * 8, None, None, None), (2, "z" * 30000, "xx", "b", 3), (3, "some words " * 8, None, "a", 1), (4, f"before {item} after", "en", "b", 9)]
    stages = dict(corpus_pipeline.STAGES)

    def ids(name, data):
        return sorted((r["doc_id"] for r in stages[name](spark, spark.createDataFrame(data, schema), sf_dir).collect()), key=repr)

    assert set(ids("quality rules", rows)) <= {4}  # fewer than ten words, or the same words over and over
    assert ids("near duplicates", rows)[:2] == [1, 1] and 3 not in ids("near duplicates", rows)  # 3 is a copy of a row of 1
    assert ids("decontamination", rows) == [1, 1, 2, 3, None]
    assert ids("decontamination", [*rows, (None, item, "en", "a", 1), (3, item, "en", "a", 1)]) == [1, 1, 2]  # all rows of an id, or without one
    mixed = ids("mixing", rows)
    assert {1, 2, 3, 4} <= set(mixed) and all(mixed.count(i) <= 2 * [r[0] for r in rows].count(i) for i in set(mixed))  # at most twice
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in stages["token ids"](spark, spark.createDataFrame(rows, schema), sf_dir).collect()), key=repr)
    assert len(got) == 6 and (None, 1) in got and (1, 1) in got  # the end id alone
    for name in stages:
        assert ids(name, []) == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, tmp_path, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/q")
    c.execute(f"create table want as {ORACLES[name]}")
    columns = ", ".join(sorted(r[0] for r in c.sql("describe want").fetchall()))
    assert c.sql(f"(select {columns} from want except all select {columns} from '{tmp_path}/q/*.parquet') union all (select {columns} from '{tmp_path}/q/*.parquet' except all select {columns} from want)").fetchall() == []


def test_benchmark_item_in_text_is_found(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert {(d["doc_id"], i) for d in docs.collect() for i, t in items if t in d["text"]} <= found


def test_the_quality_stage_knows_rare_ngrams_too(spark, sf_dir):
    """Words with their letters shuffled fit what is usual in a noisy language; that their n-grams are rarer than others shows only in all n-grams."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(300)]
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(60)]
        rows.append((1000 + k, " ".join("".join(r.sample(w, len(w))) if r.random() < k / 60 else w for w in words)))
        rows.append((2000 + k, " ".join(w if r.random() > k / 60 else w[::-1].upper() for w in words)))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    kept = {x["doc_id"] for x in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    assert not kept & set(range(1055, 1060))
    assert len(kept & set(range(300))) >= 297 and len(kept & set(range(1000, 1030))) >= 29
