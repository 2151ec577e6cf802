"""Alert throttling on a stream: what ``accounting.alert_throttle`` does, with the state kept per key by Spark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Throttle(StatefulProcessor):
    """One alert in ``seconds``, counted from the last sent; the next one tells how many were held back.

    State of a group: for each of its keys (the columns ``rest``) when it was last
    sent, in microseconds, and how many were held since. With event time a key is
    dropped once ``seconds`` have passed and nothing was held, which changes no
    later result; or after ``forget`` seconds without an alert sent, when the count
    held is given up: a group has one timer, at the first time that one of its keys
    goes. With processing time the state store's own TTL of ``forget`` seconds does it.

    Each call to the store is a message to the JVM, so a group reads its state once
    and knows its timer from the state.
    """

    def __init__(self, by: list[str], rest: list[T.StructField], seconds: int, forget: int, event_time: bool):
        self.by, self.rest, self.seconds, self.forget, self.event_time = by, rest, seconds, forget, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [f.name for f in self.rest]
        self.row = Row(*self.by, *self.names, "micros", "suppressed")
        ttl = None if self.event_time else self.forget * 1000
        columns = [*((f"rest{i}", f.dataType) for i, f in enumerate(self.rest)), ("last", T.LongType()), ("held", T.LongType())]
        self.sent = handle.getValueState("sent", T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in columns]), ttl)

    def read(self) -> dict[tuple, tuple[int, int]]:
        """``last`` and ``held`` of each key of the group."""
        return {tuple(k): (last, held) for *k, last, held in zip(*(self.sent.get() or ()), strict=True)}

    def write(self, state: dict[tuple, tuple[int, int]]) -> None:
        keys, sent = zip(*state, strict=True) if self.rest else (), zip(*state.values(), strict=True)
        self.sent.update(tuple(map(list, (*keys, *sent))))

    def due(self, last: int, held: int) -> int:
        """When a key's state goes, in milliseconds of event time."""
        return last // 1000 + (self.forget if held else self.seconds) * 1000

    def first(self, state: dict[tuple, tuple[int, int]]) -> int | None:
        return min((self.due(*s) for s in state.values()), default=None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        alerts: dict[tuple, list[int]] = {}
        for r in rows:
            alerts.setdefault(tuple(r[c] for c in self.names), []).append(r["micros"])
        state = self.read()
        before = self.first(state)
        for k, micros in alerts.items():
            last, held = state.get(k, (None, 0))
            for m in sorted(micros):
                if last is None or m - last >= self.seconds * 1_000_000:
                    yield self.row(*key, *k, m, held)
                    last, held = m, 0
                else:  # also what comes late, from before the last sent
                    held += 1
            state[k] = last, held
        self.write(state)
        if self.event_time and (now := self.first(state)) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = {k: s for k, s in self.read().items() if self.due(*s) > timerValues.getCurrentWatermarkInMs()}
        if left:
            self.write(left)
            self.handle.registerTimer(self.first(left))
        else:
            self.sent.clear()
        return iter([])


def stream_throttle(alerts: DataFrame, keys: list[str], at: str = "at", seconds: int = 300, forget: int = 86_400, late: int = 0, event_time: bool = True, together: list[str] | None = None) -> DataFrame:
    """A stream of alerts -> those that are sent: ``keys, at, suppressed``.

    Alerts of one micro-batch are taken in time order; batches in the order they
    come. An alert earlier than the last one sent is held back and counted. With
    event time, alerts more than ``late`` seconds behind the watermark are
    dropped by Spark, and state goes by timers; without, by the store's TTL (an
    ``availableNow`` run then needs ``spark.sql.streaming.noDataMicroBatches.enabled``
    off, or it never finds itself done). The
    session's state store must be RocksDB (``ROCKSDB``). A NULL key is a key.

    ``together``: those of ``keys`` whose values share one entry of the state store, which
    is read and written once a batch for all keys that agree in them (by default
    each key has its own). It saves time where these are few, a user's kinds of
    alert for example; where they are many, one task has them all. The other
    keys must then be text, whole numbers, booleans or dates. With the store's TTL
    they go together.
    """
    if forget < seconds:
        raise ValueError("a key cannot be forgotten before its window ends")
    by = keys if together is None else together
    rest = [alerts.schema[k] for k in keys if k not in by]
    if not by or not set(by) <= set(keys) or not all(isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)) for f in rest):
        raise ValueError("keys that share an entry are told apart by text, whole numbers, booleans or dates")
    kind = alerts.schema[at].dataType
    rows = alerts.select(*keys, F.col(at).cast("timestamp").alias("_at")).withColumn("micros", F.unix_micros("_at"))
    if event_time:
        rows = rows.withWatermark("_at", f"{late} seconds")
    schema = T.StructType([alerts.schema[k] for k in keys]).add("micros", "long").add("suppressed", "long")
    work = Throttle(by, rest, seconds, forget, event_time)
    out = rows.groupBy(*by).transformWithState(work, schema, "append", "EventTime" if event_time else "ProcessingTime")
    return out.select(*keys, F.timestamp_micros("micros").cast(kind).alias(at), "suppressed")
