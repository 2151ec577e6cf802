"""The spool: landed once, bounded, delivered once after crashes, trimmed by dropping folders."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.operators.writes import VersionedTable
from seamark.streaming.follow import read_changes
from seamark.streaming.spool import Full, Spool

from .conftest import rows

SCHEMA = T.StructType().add("id", "long").add("pos", T.StructType().add("round", "integer").add("at", "long"))


def changes(spark, low, high, step=1):
    return spark.range(low, high, step).select("id", F.struct(F.lit(1).cast("int").alias("round"), F.col("id").alias("at")).alias("pos"))


def folders(path):
    return {p.name for p in Path(f"{path}/segments").iterdir()}


class Sink:
    """An append that keeps the numbers it applied; can die after the write."""

    def __init__(self, spark, path):
        self.table, self.dies, self.calls = VersionedTable(spark, path), False, []

    def __call__(self, df, number):
        self.calls.append(number)
        self.table.apply(lambda now: df if now is None else now.unionByName(df), number)
        if self.dies:
            self.dies = False
            raise KeyboardInterrupt


def test_a_batch_is_landed_once(spark, tmp_path):
    s = Spool(spark, str(tmp_path), SCHEMA)
    assert s.land(changes(spark, 0, 10), 0) and not s.land(changes(spark, 0, 10), 0)
    assert s.land(changes(spark, 0, 0), 1) and s.land(changes(spark, 10, 12), 0, "other")
    state = s.state()
    assert (state.rows, len(state.segments), state.landed) == (12, 2, {"": 1, "other": 0})
    assert [(x.low, x.high) for x in state.segments] == [([1, 0], [1, 9]), ([1, 10], [1, 11])]
    assert len(folders(tmp_path)) == 2
    with pytest.raises(ValueError):
        s.land(changes(spark, 0, 1).withColumn("pos", F.lit(None).cast("struct<round int, at long>")), 2)


def test_the_bound_holds(spark, tmp_path):
    s, sink = Spool(spark, f"{tmp_path}/s", SCHEMA, max_rows=25), Sink(spark, f"{tmp_path}/t")
    for i in range(2):
        s.land(changes(spark, i * 10, i * 10 + 10), i)
    with pytest.raises(Full):
        s.land(changes(spark, 20, 30), 2)
    with pytest.raises(ValueError):
        s.land(changes(spark, 20, 60), 2)
    assert s.state().rows == 20 and len(folders(f"{tmp_path}/s")) == 2  # what found no room left nothing
    assert s.deliver(sink, max_rows=10) and s.land(changes(spark, 20, 30), 2)
    tight = Spool(spark, f"{tmp_path}/b", SCHEMA, max_bytes=10)
    with pytest.raises(ValueError):
        tight.land(changes(spark, 0, 10), 0)


@pytest.mark.parametrize("more", [False, True])
def test_a_crash_after_the_write(spark, tmp_path, more):
    s, sink = Spool(spark, f"{tmp_path}/s", SCHEMA), Sink(spark, f"{tmp_path}/t")
    s.land(changes(spark, 0, 10), 0)
    sink.dies = True
    with pytest.raises(KeyboardInterrupt):
        s.deliver(sink)
    if more:  # rows that come between, even of earlier positions, are not taken for delivered
        s.land(changes(spark, -5, 0), 1)
    again = Spool(spark, f"{tmp_path}/s", SCHEMA)
    while again.deliver(sink):
        pass
    assert sink.calls == [0, 0, 1] if more else sink.calls == [0, 0]
    assert sorted(r["id"] for r in sink.table.read().collect()) == list(range(-5 if more else 0, 10))
    assert folders(f"{tmp_path}/s") == set() and again.state().segments == []


def test_overlapping_segments_go_together_and_limits_hold(spark, tmp_path):
    s = Spool(spark, str(tmp_path), SCHEMA)
    for i, (low, high) in enumerate([(20, 30), (0, 10), (5, 15), (40, 50)]):
        s.land(changes(spark, low, high), i)
    seen = []
    while s.deliver(lambda df, n: seen.append(sorted(r["id"] for r in df.collect())), max_rows=25):
        pass
    assert [(x[0], x[-1], len(x)) for x in seen] == [(0, 14, 20), (20, 49, 20)]


def test_linger(spark, tmp_path):
    now = [100.0]
    s = Spool(spark, str(tmp_path), SCHEMA, clock=lambda: now[0])
    s.land(changes(spark, 0, 3), 0)
    assert not s.deliver(lambda df, n: None, at_least=5, linger=60)
    now[0] = 160.0
    assert s.deliver(lambda df, n: None, at_least=5, linger=60)
    assert not s.deliver(lambda df, n: None)


def test_compaction_by_ranges(spark, tmp_path):
    s = Spool(spark, str(tmp_path), SCHEMA)
    for i in range(6):
        s.land(changes(spark, i, 54, 6), i)  # every segment overlaps every other
    assert s.compact(20) and not s.compact(20)
    found = sorted(s.state().segments, key=lambda x: x.low)
    assert len(found) == 3 and sum(x.n for x in found) == 54 and len(folders(tmp_path)) == 1
    assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False))
    seen = []
    while s.deliver(lambda df, n: seen.extend(r["id"] for r in df.collect()), max_rows=30):
        assert s.state().rows == 54 - len(seen)
    assert sorted(seen) == list(range(54))


def test_compaction_leaves_a_delivery_alone(spark, tmp_path):
    s = Spool(spark, str(tmp_path), SCHEMA)
    for i in range(4):
        s.land(changes(spark, i * 10, i * 10 + 5), i)
    pending = []

    def write(df, n):
        pending.extend(s.state().pending)
        assert s.compact(100)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        s.deliver(write, max_rows=10)
    assert set(pending) <= {x.folder for x in s.state().segments} and len(s.state().segments) == 3
    Path(f"{tmp_path}/segments/orphan").mkdir()
    assert s.sweep() == 1 and s.state().rows == 20
    got = []
    while s.deliver(lambda df, n: got.append(df.count())):
        pass
    assert got == [10, 10]


def test_a_stream_waits_for_room(spark, tmp_path):
    """Without relief the stream stops before the batch that finds no room, and goes on there later."""
    for i in range(4):
        changes(spark, i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    size = max(p.stat().st_size for p in Path(f"{tmp_path}/in").glob("*.parquet"))
    s, sink = Spool(spark, f"{tmp_path}/s", SCHEMA, max_rows=20), Sink(spark, f"{tmp_path}/t")
    stream = lambda: read_changes(spark, f"{tmp_path}/in", SCHEMA, bytes_per_batch=size)
    with pytest.raises(Exception, match="beyond 20"):
        s.follow(stream(), f"{tmp_path}/c").awaitTermination()
    assert (s.state().rows, len(s.state().segments)) == (20, 2)  # a file each: the limit in bytes is honoured
    depths = []

    def relieve():
        depths.append(s.state().rows)
        return s.deliver(sink, max_rows=10)

    q = s.follow(stream(), f"{tmp_path}/c", relieve)
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [10, 10]
    assert depths == [20, 20] and s.state().rows == 20
    while s.deliver(sink):
        pass
    assert rows(sink.table.read().select("id")) == sorted(((i,) for i in range(40)), key=repr)
