"""Following a change log: landing, micro-batches, idempotent application."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicate import Filter
from ..operators.changes import apply_changes, stream_filter
from ..operators.writes import VersionedTable, ensure_target


@dataclass
class FollowSpec:
    keys: list[str]
    columns: list[str]
    filters: list[Filter] = field(default_factory=list)
    policy: str = "delete"
    mark: str | None = None
    at: str | None = None


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, fmt: str = "parquet", bytes_per_batch: int | None = None) -> DataFrame:
    """Landed changes as a stream, limited in files or in their bytes for each micro-batch (one file at least)."""
    if files_per_batch and bytes_per_batch:
        raise ValueError("a limit in files or one in bytes")
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        r = r.option("maxBytesPerTrigger", bytes_per_batch)
    return r.load(path)


def apply_batch(target: VersionedTable, spec: FollowSpec) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: filter, fold and apply one micro-batch; a batch that was applied before does nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        changes = stream_filter(batch, spec.filters)

        def change(current: DataFrame | None) -> DataFrame:
            empty = batch.select(*spec.columns).limit(0)
            now = ensure_target(batch.sparkSession, current, empty)
            return apply_changes(now, changes, spec.keys, spec.policy, spec.mark, spec.at)

        target.apply(change, batch_id)

    return run


def follow(changes: DataFrame, target: VersionedTable, spec: FollowSpec, checkpoint: str, available_now: bool = True, seconds: int | None = None) -> StreamingQuery:
    """Apply a stream of changes to a target; one micro-batch at a time, offsets committed after the target.

    A restart after a failure repeats at most the last batch, which its id makes harmless.
    """
    w = changes.writeStream.foreachBatch(apply_batch(target, spec)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds or 1} seconds")
    return w.start()


def land(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store changes durably before anything is delivered; delivery reads the landing table as its stream."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth(landed: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: ``depth``: landed changes beyond the last delivered position."""
    last = delivered.agg(F.max("pos").alias("last"))
    return landed.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("last").isNull() | (F.col("pos") > F.col("last"))).alias("depth"))  # one row


def trim(landed: DataFrame, upto) -> DataFrame:
    """The landing table without what was delivered."""
    return landed.where(F.col("pos") > upto)
