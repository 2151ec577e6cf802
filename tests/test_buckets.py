"""Versions of buckets: what a write touches, what a crash or a second writer leaves; digest trees against the full comparison."""

import random

import pytest
from pyspark.sql import functions as F

from seamark.operators import buckets as bk
from seamark.operators import digests as dg
from seamark.operators import verify as ve
from seamark.operators.changes import apply_changes

from .conftest import rows

KEYED = "k long, a string, b double"


def data(spark, n=2000, start=0):
    return spark.range(start, start + n).selectExpr("id as k", "concat('v', id) as a", "id / 7 as b")


def table(spark, path, bits=6):
    return bk.BucketTable(spark, f"file://{path}/t", ["k"], bits)


def folders(t):
    return {r["bucket"]: r["folder"] for r in t.manifest().collect()}


def test_a_batch_for_one_bucket_writes_one_folder(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read() is None
    assert t.replace(data(spark)) == 0
    before = folders(t)
    assert len(before) == 64 and t.manifest().agg(F.sum("n")).first()[0] == 2000
    k = data(spark).where(t._bucket(data(spark)) == 5).first()["k"]
    assert t.upsert(spark.createDataFrame([(k, "new", 1.0)], KEYED)) == 1
    after = folders(t)
    assert [b for b in before if before[b] != after[b]] == [5]
    written = [p.name for p in (tmp_path / "t/rows").glob("0000000001-*/_b=*")]
    assert written == ["_b=5"]
    assert t.read().where("a = 'new'").count() == 1 and t.read().count() == 2000
    assert rows(t.read(0)) == rows(data(spark))  # the version before is still whole
    m = t.manifest().where("bucket = 5").first()
    own = [r[0] for r in t.read().where(t._bucket(t.read()) == 5).select(F.concat(F.lit('["'), F.col("k").cast("string"), F.lit('"]'))).collect()]
    assert (m["n"], m["low_key"], m["high_key"]) == (len(own), min(own), max(own))


def test_two_writers_at_once_cannot_both_commit(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.replace(data(spark, 100))
    a, b = spark.createDataFrame([(1, "one", 0.0)], KEYED), spark.createDataFrame([(1, "two", 0.0)], KEYED)
    raced = []

    def slow(now):  # the other writer commits while this one works
        if not raced:
            raced.append(two.upsert(b))
        return bk.upsert(now, a, ["k"])

    with pytest.raises(bk.Conflict):
        one.apply(a, slow)
    assert one.numbers() == [0, 1] and one.read().where("k = 1").first()["a"] == "two"
    raced.clear()
    assert one.apply(a, slow, tries=2) == 3  # done again on the other's version
    assert one.read().where("k = 1").first()["a"] == "one" and one.read().count() == 100


def test_a_crash_before_the_claim_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.replace(data(spark, 50), ("w", 1))

    def crash(*_):
        raise RuntimeError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(bk.BucketTable, "_claim", crash)
        with pytest.raises(RuntimeError):
            t.upsert(spark.createDataFrame([(1, "lost", 0.0)], KEYED), batch=("w", 2))
    assert rows(t.read()) == rows(data(spark, 50))
    assert t.upsert(spark.createDataFrame([(1, "kept", 0.0)], KEYED), batch=("w", 2)) == 1
    assert t.upsert(spark.createDataFrame([(1, "again", 0.0)], KEYED), batch=("w", 2)) == 1  # held already
    assert t.read().where("k = 1").first()["a"] == "kept"
    assert t.vacuum() > 0
    assert t.numbers() == [1] and t.read().count() == 50
    assert len(list((tmp_path / "t/rows").glob("*/_b=*"))) == len(folders(t))


def test_empty_batches_nulls_added_columns_and_lookup(spark, tmp_path):
    t = table(spark, tmp_path, bits=2)
    assert t.upsert(spark.createDataFrame([], KEYED)) == 0 and t.read().count() == 0
    t.upsert(spark.createDataFrame([(None, "null key", None), (1, "x", 1.0)], KEYED))
    t.upsert(spark.createDataFrame([(None, "changed", None)], KEYED))
    assert rows(t.read()) == rows(spark.createDataFrame([(None, "changed", None), (1, "x", 1.0)], KEYED))
    wider = t.read().schema.add("c", "integer")
    new = spark.createDataFrame([(2, "y", 2.0, 5)], wider)
    t.apply(new, lambda now: bk.upsert(now, new, ["k"]), schema=wider)
    assert rows(t.read()) == rows(spark.createDataFrame([(None, "changed", None, None), (1, "x", 1.0, None), (2, "y", 2.0, 5)], wider))
    assert rows(t.lookup(spark.createDataFrame([(2,), (9,)], "k long"))) == [(2, "y", 2.0, 5)]
    t.delete(spark.createDataFrame([(1,), (None,)], "k long"))
    assert [r["k"] for r in t.read().orderBy("k").collect()] == [None, 2]
    with pytest.raises(ValueError):
        bk.BucketTable(spark, str(tmp_path), [])


@pytest.mark.parametrize("seed", range(2))
def test_following_a_log_in_batches_equals_one_fold(spark, tmp_path, seed):
    from .test_changes import SCHEMA, log_of

    start = spark.createDataFrame([(k, f"old{k}", k) for k in range(4)], "k long, a string, b long")
    log = log_of(seed, 60)
    t = table(spark, tmp_path, bits=3)
    t.replace(start)
    for i in range(0, 60, 20):
        t.follow(spark.createDataFrame(log[i : i + 20], SCHEMA), batch=("log", i))
        t.follow(spark.createDataFrame(log[i : i + 20], SCHEMA), batch=("log", i))
    assert rows(t.read()) == rows(apply_changes(start, spark.createDataFrame(log, SCHEMA), ["k"]))


def wrong(df):
    return sorted((r["_k"], r["class"], tuple(tuple(d) for d in r["diff"] or ())) for r in df.collect())


def test_digest_trees_find_what_the_full_join_finds(spark):
    rng = random.Random(4)
    source = [(i, f"v{i}", i / 3) for i in range(3000)]
    copy = [(i, a if rng.random() > 0.01 else a + "!", b if rng.random() > 0.01 else None) for i, a, b in source if rng.random() > 0.005] + [(5000 + i, "extra", 0.0) for i in range(7)]
    # another type of key, and NULLs on both sides
    e = spark.createDataFrame([*source, (None, "n", None)], KEYED)
    a = spark.createDataFrame([*copy, (None, None, None)], KEYED).withColumn("k", F.col("k").cast("string"))
    for bits in (1, 8, 16):
        assert wrong(dg.compare_by_digest(e, a, ["k"], bits=bits)) == wrong(ve.compare(e, a, ["k"]).where("class <> 'same'"))
    none = e.limit(0)
    for x, y in ((e, none), (none, e), (none, none)):
        got = dg.compare_by_digest(x, y, ["k"])
        assert wrong(got) == wrong(ve.compare(x, y, ["k"]).where("class <> 'same'"))
        leaves = dg.tree(x, ["k"], ["a", "b"])
        assert dg.report_by_digest(leaves, got).first() == ve.report(ve.compare(x, y, ["k"])).first()


def test_only_ranges_that_differ_are_joined(spark):
    e = data(spark, 20_000)
    a = e.withColumn("b", F.when(F.col("k").isin(5, 600, 7000), -1.0).otherwise(F.col("b")))
    ranges = dg.descend(dg.tree(e, ["k"], ["a", "b"]), dg.tree(a, ["k"], ["a", "b"]))
    assert ranges.count() == 3
    joined = dg.in_ranges(e, ranges, ["k"], dg.LEAF_BITS).count()
    assert 3 <= joined <= 15  # 20,000 rows over 65,536 ranges
    assert dg.compare_ranges(e, a, ranges, ["k"]).where("class = 'different'").count() == 3


def test_repeated_keys_are_sets_and_trees_merge(spark):
    e = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0), (2, "z", 1.0)], KEYED)
    assert dg.compare_by_digest(e, e.orderBy(F.desc("a")), ["k"]).count() == 0
    assert dg.compare_by_digest(e, e.where("a <> 'y'"), ["k"]).where("class <> 'same'").count() == 1
    half = dg.merge(dg.tree(e.where("a = 'x'"), ["k"], ["a", "b"]), dg.tree(e.where("a <> 'x'"), ["k"], ["a", "b"]))
    assert dg.differing(half, dg.tree(e, ["k"], ["a", "b"])).count() == 0
    low = dg.tree(e, ["k"], ["a", "b"], bits=4)
    assert dg.differing(dg.roll_up(dg.tree(e, ["k"], ["a", "b"]), 16, 4), low).count() == 0
    with pytest.raises(ValueError):
        dg.tree(e, [], ["a"])


def test_tables_are_compared_by_the_trees_beside_them(spark, tmp_path):
    e, a = (bk.BucketTable(spark, f"file://{tmp_path}/{n}", ["k"], 5) for n in ("e", "a"))
    e.replace(data(spark, 3000))
    a.replace(data(spark, 3000))
    assert dg.differing(e.nodes(), a.nodes()).count() == 0 and bk.compare_tables(e, a).count() == 0
    a.upsert(spark.createDataFrame([(17, "other", 1.0), (9999, "extra", 1.0)], KEYED))
    a.delete(spark.createDataFrame([(40,)], "k long"))
    assert dg.differing(e.nodes(), a.nodes()).count() <= 3
    assert wrong(bk.compare_tables(e, a)) == wrong(ve.compare(e.read(), a.read(), ["k"]).where("class <> 'same'"))
    # the kept tree of a version that grew by writes is that of its rows
    assert dg.differing(a.leaves(), dg.tree(a.read(), ["k"], ["a", "b"])).count() == 0


def test_a_counted_write_is_one_rewrite(spark, tmp_path):
    t = table(spark, tmp_path, bits=2)
    t.replace(data(spark, 20))
    new = spark.createDataFrame([(0, "v0", 0.0), (1, "changed", 0.0), (50, "new", 0.0), (2, None, None)], KEYED)
    t.write(new, spark.createDataFrame([(3,), (4,), (99,), (None,)], "k long"), batch=("w", 1))
    assert t.version().counts == {"inserted": 1, "updated": 2, "same": 1, "deleted": 2}
    assert sorted(r["k"] for r in t.read().collect()) == [k for k in range(20) if k not in (3, 4)] + [50]
    assert t.read().where("k = 2").first()["a"] is None
    from pyspark.sql import Observation

    from seamark.operators.writes import counted_write

    plan = counted_write(data(spark), new, new.select("k"), ["k"], Observation())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Join") == 2  # the target once; the rows and the ids beside it


def test_fan_out_survives_a_crash_after_any_step(spark, tmp_path, monkeypatch):
    from seamark.operators.writes import VersionedTable, fan_out_once

    batch = data(spark, 5)
    add = lambda now, more: more if now is None else now.union(more)
    a, b = (VersionedTable(spark, f"file://{tmp_path}/{n}") for n in "ab")
    write, steps = VersionedTable.write, []

    def dies(self, df, i=-1):
        steps.append(self.path)
        write(self, df, i)
        if len(steps) == 1:
            raise KeyboardInterrupt("the process dies after a's pointer is there")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "write", dies)
        with pytest.raises(KeyboardInterrupt):
            fan_out_once(batch, 3, {"a": (a, add), "b": (b, add)})
    assert fan_out_once(batch, 3, {"a": (a, add), "b": (b, add)}) == ["b"]
    assert fan_out_once(batch, 3, {"a": (a, add), "b": (b, add)}) == []
    assert a.read().count() == b.read().count() == 5
