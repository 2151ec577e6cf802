"""A bounded spool between a source of changes and its targets.

Changes are landed in segments of whole micro-batches; an index tells each
segment's positions, rows and bytes. The index is a small numbered file, and a
step (land, begin and end of a delivery, compact) commits by claiming the next
number, so several writers may work on one spool and a crash leaves the state
before or after a step. What was delivered is trimmed by dropping its segments'
folders; no row is rewritten for it.

* A batch is landed once, whatever is repeated: its id stands in the index.
* Landing never takes the spool beyond its bound: ``Full`` is raised and the
  stream's offsets stay, so the source is asked again when there is room.
* A delivery is written down (its number and segments) before it is made. After
  a crash the same rows come again under the same number, which a target that
  keeps the numbers it applied (``VersionedTable``, ``BucketTable``) passes over.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import Claims, Conflict

#: Index files that are kept, for those who are reading one.
KEPT = 10


class Full(RuntimeError):
    """No room until something is delivered."""


@dataclass(frozen=True)
class Segment:
    folder: str
    low: list
    high: list
    n: int
    size: int
    at: float


@dataclass(frozen=True)
class State:
    segments: list[Segment] = field(default_factory=list)
    #: The last landed batch of each source.
    landed: dict[str, int] = field(default_factory=dict)
    #: Deliveries made, and the folders of the one under way.
    deliveries: int = 0
    pending: list[str] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(s.n for s in self.segments)

    @property
    def size(self) -> int:
        return sum(s.size for s in self.segments)


def _plain(v) -> list:
    """A position as a list that JSON keeps and Python orders: whole numbers and text, single or in a struct."""
    if isinstance(v, Row):
        return [x for f in v for x in _plain(f)]
    if not isinstance(v, (int, str)):
        raise TypeError("positions are made of whole numbers and text")
    return [v]


class Spool:
    """``path`` holds changes of ``schema`` with a position ``order`` that is never NULL; at most ``max_rows`` and ``max_bytes``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: str = "pos", max_rows: int | None = None, max_bytes: int | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.schema, self.order = spark, path.rstrip("/"), schema, order
        self.max_rows, self.max_bytes, self.clock = max_rows, max_bytes, clock
        self._index = Claims(spark, f"{self.path}/index")

    # state

    def state(self) -> State:
        return self._now()[1]

    def _now(self) -> tuple[int, State]:
        known = self._index.numbers()
        if not known:
            return -1, State()
        s = json.loads(self._index.read(known[-1]))
        return known[-1], State([Segment(**x) for x in s["segments"]], s["landed"], s["deliveries"], s["pending"])

    def _step(self, change: Callable[[State], State | None]) -> State | None:
        """Commit ``change(state)``, again on the newer state if another writer was first; None gives up."""
        while True:
            number, state = self._now()
            new = change(state)
            if new is None:
                return None
            try:
                self._index.claim(number + 1, json.dumps(asdict(new)))
            except Conflict:
                continue
            self._index.forget(number + 2 - KEPT)
            return new

    def _measured(self, folder: str, at: float, by: str | None = None) -> list[Segment]:
        """Segments that were just written: one, or one for each value of ``by``."""
        schema = T.StructType([*self.schema.fields, *([T.StructField(by, T.IntegerType())] if by else [])])
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        found = df.groupBy(*([by] if by else [])).agg(F.min(self.order).alias("low"), F.max(self.order).alias("high"), F.count("*").alias("n"), F.count_if(F.col(self.order).isNull()).alias("null")).collect()  # a row for each segment
        if any(r["null"] for r in found):
            raise ValueError("a change without a position")
        names = [(r, f"{folder}/{by}={r[by]}" if by else folder) for r in found if r["n"]]
        fs = self._index.fs()
        return [Segment(name, _plain(r["low"]), _plain(r["high"]), r["n"], fs.getContentSummary(self._at(name)).getLength(), at) for r, name in names]

    def _at(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")

    def _drop(self, folders: list[str]) -> None:
        for f in folders:
            self._index.fs().delete(self._at(f), True)

    # landing

    def land(self, batch: DataFrame, batch_id: int, source: str = "", relieve: Callable[[], bool] | None = None) -> bool:
        """Store a batch; False if it was landed before. ``ValueError`` if there never is room for it.

        Where there is none now, ``relieve`` (a delivery; False: nothing to
        deliver) makes some while the written batch waits; else ``Full``.
        """
        if self.state().landed.get(source, -1) >= batch_id:
            return False
        folder = f"segments/{uuid.uuid4().hex}"
        batch.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        new = self._measured(folder, self.clock())

        def add(state: State) -> State | None:
            if state.landed.get(source, -1) >= batch_id:
                return None
            grown = replace(state, segments=[*state.segments, *new], landed={**state.landed, source: batch_id})
            for limit, now, all_ in ((self.max_rows, sum(s.n for s in new), grown.rows), (self.max_bytes, sum(s.size for s in new), grown.size)):
                if limit is not None and now > limit:
                    raise ValueError("one batch is larger than the spool")
                if limit is not None and new and all_ > limit:
                    raise Full(f"{all_} beyond {limit}")
            return grown

        try:
            while True:
                try:
                    done = self._step(add)
                    break
                except Full:
                    if relieve is None or not relieve():
                        raise
        except Exception:
            self._drop([folder])
            raise
        if done is None or not new:
            self._drop([folder])
        return done is not None

    def follow(self, changes: DataFrame, checkpoint: str, relieve: Callable[[], bool] | None = None, source: str = "", available_now: bool = True, seconds: int = 1) -> StreamingQuery:
        """Land a stream, with ``relieve`` as in ``land``; without it the stream stops before a batch that finds no room."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.land(batch, batch_id, source, relieve)

        w = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()

    # delivering

    def read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def _next(self, state: State, rows: int | None, size: int | None) -> list[Segment]:
        """Segments from the first position on, within the limits; those whose positions overlap go together."""
        groups: list[list[Segment]] = []
        top: list = []
        for s in sorted(state.segments, key=lambda s: (s.low, s.high)):
            if groups and s.low <= top:
                groups[-1].append(s)
                top = max(top, s.high)
            else:
                groups.append([s])
                top = s.high
        taken = groups[0]
        for g in groups[1:]:
            both = [*taken, *g]
            if (rows is not None and sum(x.n for x in both) > rows) or (size is not None and sum(x.size for x in both) > size):
                break
            taken = both
        return taken

    def deliver(self, write: Callable[[DataFrame, int], None], max_rows: int | None = None, max_bytes: int | None = None, at_least: int = 1, linger: float = 0.0) -> bool:
        """Hand the next changes to ``write(rows, number)`` and trim them; False if there are none to deliver yet.

        The limits are in whole segments, one group at least. Fewer than
        ``at_least`` rows wait until the oldest has been there for ``linger`` seconds.
        """

        def begin(state: State) -> State | None:
            if state.pending:
                return state  # a delivery that did not end comes again as it was
            waiting = state.rows < at_least and all(self.clock() - s.at < linger for s in state.segments)
            if not state.segments or waiting:
                return None
            return replace(state, pending=[s.folder for s in self._next(state, max_rows, max_bytes)])

        state = self._step(begin)
        if state is None:
            return False
        number, folders = state.deliveries, state.pending
        write(self.read(folders), number)

        def end(state: State) -> State | None:
            if state.deliveries != number:
                return None
            return replace(state, segments=[s for s in state.segments if s.folder not in folders], deliveries=number + 1, pending=[])

        self._step(end)
        self._drop(folders)
        return True

    # upkeep

    def compact(self, rows_each: int) -> bool:
        """Deal segments of fewer than half of ``rows_each``, and those that overlap them, anew by ranges of the position; False if there is nothing to gain.

        New segments do not overlap, hold sorted rows, and take the oldest age of those they replace. What is being delivered is left alone.
        """
        state = self.state()
        free = [s for s in state.segments if s.folder not in state.pending]
        small = [s for s in free if 2 * s.n < rows_each]
        old = [s for s in free if s in small or any(s.low <= x.high and x.low <= s.high for x in small)]
        n = -(-sum(s.n for s in old) // rows_each)
        if len(old) < 2 or n >= len(old):
            return False
        folder, dealt = f"segments/{uuid.uuid4().hex}", self.read([s.folder for s in old])
        dealt.repartitionByRange(n, self.order).sortWithinPartitions(self.order).withColumn("_s", F.spark_partition_id()).write.partitionBy("_s").parquet(f"{self.path}/{folder}")
        new = self._measured(folder, min(s.at for s in old), "_s")
        gone = {s.folder for s in old}

        def swap(state: State) -> State | None:
            if not gone <= {s.folder for s in state.segments} - set(state.pending):
                return None
            return replace(state, segments=[*[s for s in state.segments if s.folder not in gone], *new])

        done = self._step(swap) is not None
        self._drop(sorted(gone) if done else [folder])
        return done

    def sweep(self) -> int:
        """Delete folders that the index does not name, left by crashes; only while nobody writes. Returns their number."""
        fs, used = self._index.fs(), {s.folder for s in self.state().segments}
        if not fs.exists(self._at("segments")):
            return 0
        names = [f"segments/{s.getPath().getName()}" for s in fs.listStatus(self._at("segments"))]
        stale = [f for f in names if f not in used and not any(u.startswith(f"{f}/") for u in used)]
        self._drop(stale)
        return len(stale)
