"""Streams: state that goes, restarts, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.operators.accounting import alert_throttle
from seamark.streaming import echo
from seamark.streaming.throttle import ROCKSDB, Throttle, stream_throttle

from .conftest import rows

ALERTS = "channel string, kind string, at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def alert(key, seconds):
    return (key, None if key == "n" else "k", DAY + dt.timedelta(seconds=seconds))


def throttled(spark, path, batches, **kw):
    """Each batch lands as files, and the query is started anew from its checkpoint."""
    for b in batches:
        spark.createDataFrame(b, ALERTS).write.mode("append").parquet(f"{path}/in")
        out = stream_throttle(spark.readStream.schema(ALERTS).parquet(f"{path}/in"), ["channel", "kind"], seconds=100, **kw)
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def state(spark, path):
    return sorted(r["channel"] for r in spark.read.format("statestore").option("stateVarName", "sent").load(f"{path}/c").select("key.channel").collect())


def test_throttle_equals_the_batch_operator_and_forgets_silent_keys(spark, tmp_path, rocksdb):
    batches = [
        [alert("a", s) for s in (0, 10, 99)] + [alert("n", s) for s in (5, 200)] + [alert("quiet", 20)],
        [alert("a", s) for s in (100, 150)] + [alert("n", 250)],
        [alert("later", 5_000)],
        [alert("later", 5_050)],
    ]
    got = throttled(spark, tmp_path, batches, forget=2_000, late=500)
    everything = spark.createDataFrame([x for b in batches for x in b], ALERTS)
    assert rows(got) == rows(alert_throttle(everything, ["channel", "kind"], 100))
    # a and n held one each and were forgotten 2,000 seconds after their last alert; quiet held none and went with its window
    assert state(spark, tmp_path) == ["later"]


def test_a_count_is_kept_until_its_key_is_forgotten(spark, tmp_path, rocksdb):
    batches = [[alert("a", 0), alert("a", 50), alert("b", 0)], [alert("c", 1_000)], [alert("c", 1_001)]]
    throttled(spark, tmp_path, batches, forget=2_000)
    assert state(spark, tmp_path) == ["a", "c"]  # b held none: nothing to keep; a still has one to tell
    got = throttled(spark, tmp_path, [[alert("a", 1_500)]], forget=2_000)
    assert rows(got.where("channel = 'a'").select("suppressed")) == [(0,), (1,)]


def test_late_alerts_are_held_and_too_late_ones_dropped(spark, tmp_path, rocksdb):
    got = throttled(spark, tmp_path, [[alert("a", 1_000)], [alert("a", 950)], [alert("a", 10), alert("a", 1_200)]], forget=5_000, late=500)
    assert rows(got.select("suppressed")) == [(0,), (1,)]  # 950 is held; 10 is behind the watermark


def test_keys_that_share_an_entry_of_the_store_are_throttled_and_forgotten_alone(spark, tmp_path, rocksdb):
    r = random.Random(4)
    kinds = ["x", "y", None, "z"]
    batches = [[(r.choice(["a", "b", None]), r.choice(kinds), DAY + dt.timedelta(seconds=1_000 * i + r.randrange(900))) for _ in range(60)] for i in range(3)]
    got = throttled(spark, tmp_path / "one", batches, forget=5_000, late=1_000, together=["channel"])
    everything = spark.createDataFrame([x for b in batches for x in b], ALERTS)
    assert rows(got) == rows(alert_throttle(everything, ["channel", "kind"], 100))
    assert rows(got) == rows(throttled(spark, tmp_path / "each", batches, forget=5_000, late=1_000))
    entries = {n: spark.read.format("statestore").option("stateVarName", "sent").load(f"{tmp_path}/{n}/c").count() for n in ("one", "each")}
    assert entries["one"] <= 3 < entries["each"]
    # quiet kinds of one channel go while its others stay: x held one, y held none
    two = [[("a", "x", at(0)), ("a", "x", at(50)), ("a", "y", at(0))], [("b", "x", at(1_000))], [("b", "x", at(1_001))]]
    throttled(spark, tmp_path / "two", two, forget=2_000, together=["channel"])
    held = {x["channel"]: x["rest0"] for x in spark.read.format("statestore").option("stateVarName", "sent").load(f"{tmp_path}/two/c").select("key.channel", "value.rest0").collect()}
    assert held == {"a": ["x"], "b": ["x"]}
    got = throttled(spark, tmp_path / "two", [[("a", "x", at(1_500)), ("a", "y", at(1_500))]], forget=2_000, together=["channel"])
    assert rows(got.where("channel = 'a'").select("kind", "suppressed")) == [("x", 0), ("x", 1), ("y", 0), ("y", 0)]
    for wrong in ([], ["other"]):
        with pytest.raises(ValueError):
            stream_throttle(spark.readStream.schema(ALERTS).parquet(str(tmp_path)), ["channel", "kind"], together=wrong)


def test_a_group_calls_the_store_a_few_times_whatever_it_has_kept():
    """Each call is a message to the JVM, and these are what the query's time goes to."""

    class Store:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, t):
            self.calls.append("register")
            self.timers.add(t)

        def deleteTimer(self, t):
            self.calls.append("delete")
            self.timers.remove(t)  # only timers that exist

    store = Store()
    work = Throttle(["u"], [T.StructField("k", T.StringType())], 100, 1_000, True)
    work.init(store)
    for i in range(4):
        store.calls.clear()
        sent = list(work.handleInputRows((7,), iter([Row(u=7, k=k, micros=(150 * i + s) * 1_000_000) for k in "abcde" for s in (0, 20, 110)]), None))
        assert len(sent) == (10 if i == 0 else 5) and len(store.calls) <= 4 and len(store.timers) == 1


def test_processing_time_state_has_a_ttl(spark, tmp_path, rocksdb):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with processing time there is always one more
    got = throttled(spark, tmp_path, [[alert("a", 0), alert("a", 50)], [alert("a", 200)]], forget=100, event_time=False)
    assert rows(got.select("suppressed")) == [(0,), (1,)]
    with pytest.raises(ValueError):
        stream_throttle(spark.readStream.schema(ALERTS).parquet(str(tmp_path)), ["channel"], seconds=10, forget=5)


CHANGES = "op string, id long, v string, at timestamp_ntz"
WRITES = "table string, k string, op string, reading string, origins array<string>, at timestamp_ntz"


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def echoes(spark, path, steps):
    """Each step is (changes, writes) and a run of the query; rows given, and rows that the join still holds."""
    for c, w in steps:
        spark.createDataFrame(c, CHANGES).write.mode("append").parquet(f"{path}/c")
        spark.createDataFrame([("t", f'["{i}"]', op, "" if op in ("delete", echo.HEARTBEAT) else f'["{v}"]', ["a"], when) for op, i, v, when in w], WRITES).write.mode("append").parquet(f"{path}/w")
        out = echo.recognise_stream(spark.readStream.schema(CHANGES).parquet(f"{path}/c"), spark.readStream.schema(WRITES).parquet(f"{path}/w"), "t", ["id"], ["v"], ["id", "at"], late="60 seconds", ttl=100)
        q = out.writeStream.format("parquet").option("path", f"{path}/o").option("checkpointLocation", f"{path}/s").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["op"], r["id"], r["at"]): r["is_echo"] for r in spark.read.schema(out.schema).parquet(f"{path}/o").collect()}
    join = [o for o in q.lastProgress["stateOperators"] if "Join" in o["operatorName"]]
    return got, sum(o["numRowsTotal"] for o in join)


def test_echoes_of_two_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    beat = lambda s: ([(echo.HEARTBEAT, None, None, at(s))], [(echo.HEARTBEAT, None, None, at(s))])
    steps = [
        ([("update", 1, "x", at(10)), ("update", 2, "y", at(10)), ("delete", 3, None, at(10)), ("update", 4, "x", at(150))], [("insert", 1, "x", at(0)), ("update", 1, "x", at(5)), ("update", 2, "other", at(5)), ("delete", 3, None, at(5)), ("update", 4, "x", at(1))]),
        ([], [("insert", 5, "z", at(160))]),  # written, and the change comes later
        ([("insert", 5, "z", at(170))], []),
        beat(5_000),
        ([("update", 6, "late", at(20))], []),  # behind the watermark: dropped
        beat(9_000),
    ]
    try:
        got, held = echoes(spark, tmp_path, steps)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {("update", 1, at(10)): True, ("update", 2, at(10)): False, ("delete", 3, at(10)): True, ("update", 4, at(150)): False, ("insert", 5, at(170)): True}
    assert got == want
    assert held <= 4  # heartbeats alone


def test_ordered_echoes_forget_their_ledgers(spark, tmp_path):
    schema = "kind string, k string, reading string, at timestamp"
    steps = [[("write", "a", "v", at(0)), ("write", "b", "v", at(0)), ("change", "b", "v", at(1))], [("write", "c", "v", at(5_000))], [("write", "c", "v", at(5_001))]]
    for rows_ in steps:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = echo.recognise_in_order(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r["is_echo"] for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/o").collect()] == [True]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # c's; a's has expired, b's was used up
