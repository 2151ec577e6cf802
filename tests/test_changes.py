"""Folding a change log equals applying it change by change."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seamark.operators import changes as ch
from seamark.operators.accounting import alert_throttle
from seamark.operators.writes import VersionedTable, split_ids, upsert

from .conftest import rows

SCHEMA = "op string, k long, a string, b long, unchanged array<string>, pos struct<n:long>"


def log_of(seed, n=80):
    r = random.Random(seed)
    out = []
    for i in range(n):
        op = r.choices(["insert", "update", "delete", "truncate"], [4, 5, 3, 0.3])[0]
        k = None if op == "truncate" else r.randrange(8)
        missing = [c for c in ("a", "b") if op == "update" and r.random() < 0.4]
        a = None if "a" in missing or r.random() < 0.2 else f"v{i}"
        b = None if "b" in missing or r.random() < 0.2 else i
        out.append((op, k, a, b, missing, (i,)))
    return out


def sequential(target, log, policy):
    t = {k: {"a": a, "b": b, "gone": g} for k, a, b, g in target}
    for op, k, a, b, missing, _ in log:
        if op == "truncate":
            if policy == "delete":
                t.clear()
        elif op == "delete":
            if policy == "delete":
                t.pop(k, None)
            elif policy == "soft" and k in t:
                t[k]["gone"] = True
        else:
            row = t.setdefault(k, {"a": None, "b": None, "gone": False if policy == "soft" else None})
            if "a" not in missing:
                row["a"] = a
            if "b" not in missing:
                row["b"] = b
            if policy == "soft":
                row["gone"] = False
    return sorted(((k, v["a"], v["b"], v["gone"]) for k, v in t.items()), key=repr)


@pytest.mark.parametrize("policy", ["delete", "soft", "ignore"])
@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed, policy):
    start = [(k, f"old{k}", k, False if policy == "soft" else None) for k in range(4)]
    target = spark.createDataFrame(start, "k long, a string, b long, gone boolean")
    log = log_of(seed)
    got = ch.apply_changes(target, spark.createDataFrame(log, SCHEMA), ["k"], policy, mark="gone" if policy == "soft" else None)
    assert rows(got) == sequential(start, log, policy)


def test_positions(spark):
    df = spark.createDataFrame([("0/FF",), ("0/100",), ("1/0",), ("A/1#B/2",)], "p string")
    got = [r.p for r in df.orderBy(ch.pg_position(F.col("p"))).collect()]
    assert got == ["0/FF", "0/100", "1/0", "A/1#B/2"]
    df = spark.createDataFrame([("bin.000009:7",), ("bin.000010:2",), ("bin.000010:2:1",)], "p string")
    assert [r.p for r in df.orderBy(ch.mysql_position(F.col("p"))).collect()] == ["bin.000009:7", "bin.000010:2", "bin.000010:2:1"]


def test_runs(spark):
    log = [("t", "insert", 1, (1,)), ("t", "insert", 2, (2,)), ("t", "insert", 1, (3,)), ("t", "delete", 2, (4,)), ("u", "delete", 9, (5,))]
    df = spark.createDataFrame(log, "t string, op string, k long, pos struct<n:long>")
    got = {(r.t, r.pos.n): r.run for r in ch.delivery_runs(df, "t", ["k"]).collect()}
    assert got == {("t", 1): 0, ("t", 2): 0, ("t", 3): 1, ("t", 4): 2, ("u", 5): 0}


def test_runs_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(ch, "STRETCH", 7)
    rng = random.Random(5)
    log = [(rng.choice([None, "t", "u"]), rng.choice(["insert", "insert", "insert", "delete"]), rng.randrange(6), (n,)) for n in range(150)]
    want, seen, run, last = {}, {}, {}, {}
    for t, op, k, (n,) in log:
        if t not in run:
            run[t] = -1
        if op != last.get(t) or k in seen[t]:
            run[t], seen[t], last[t] = run[t] + 1, set(), op
        seen[t].add(k)
        want[n] = run[t]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "t string, op string, row_index long, pos struct<n:long>").repartition(5)
    assert {r.pos.n: r.run for r in ch.delivery_runs(df, "t", ["row_index"]).collect()} == want


def test_throttle_counts_from_the_last_sent(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:04:00", "2024-01-01 00:05:00", "2024-01-01 00:09:59", "2024-01-01 00:10:01"]
    df = spark.createDataFrame([("x", a) for a in at], "k string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = sorted((str(r["at"]), r["suppressed"]) for r in alert_throttle(df, ["k"], 300).collect())
    assert got == [("2024-01-01 00:00:00", 0), ("2024-01-01 00:05:00", 1), ("2024-01-01 00:10:01", 1)]


def test_upsert_needs_keys(spark):
    df = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        upsert(df, df, [])
    good, bad = split_ids(spark.createDataFrame([(1,), (None,)], "k long"), ["k"])
    assert (good.count(), bad.count()) == (1, 1)


def test_versions_are_idempotent(spark, tmp_path):
    v = VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1,)], "k long")
    assert v.apply(lambda now: df, 0)
    assert v.apply(lambda now: now.union(df), 1)
    assert not v.apply(lambda now: now.union(df), 1)
    assert v.read().count() == 2


def test_throttle_equals_a_plain_walk_at_any_batch_size_in_one_pass(spark):
    r = random.Random(5)
    span, start = 60, dt.datetime(2024, 1, 1)
    data = [(k, start + dt.timedelta(seconds=r.randrange(4_000))) for k in [None, *range(12)] for _ in range(r.choice([1, 3, 300]))]
    want = []
    for k in {k for k, _ in data}:
        last, held = None, 0
        for at in sorted(at for x, at in data if x == k):
            if last is None or (at - last).total_seconds() >= span:
                want.append((k, at, held))
                last, held = at, 0
            else:
                held += 1
    df = spark.createDataFrame(data, "k int, at timestamp_ntz")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert rows(alert_throttle(df, ["k"], span)) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = alert_throttle(df, ["k"], span)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan  # a Python call for each batch of rows, not for each burst
