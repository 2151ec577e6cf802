"""Applying rows to a target: upserts, deletes, versions.

Plain Parquet has no row-level change, so a write is a join that gives the new
table, written beside the old one and then swapped in by a pointer row
(``VersionedTable``). Where the table format has MERGE, ``merge_into`` passes
the work on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import key_text, kind_of, same


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return left.withColumn("_k", key_text(keys, left.schema)), right.withColumn("_k", key_text(keys, right.schema))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], unchanged: str | None = None, mark: str | None = None) -> DataFrame:
    """The target after insert-or-update by key; running it again changes nothing.

    ``rows`` holds one row for each key (see ``changes.latest_per_key``). With
    ``unchanged``, columns named there keep the target's value. Columns that the
    rows don't have stay as they are. ``mark`` is the soft-delete column, which
    an upsert clears.
    """
    if not keys:
        raise ValueError("an upsert needs keys")
    t, r = _on(target, rows, keys)
    j = t.alias("t").join(r.withColumn("_new", F.lit(True)).alias("r"), "_k", "full_outer")
    new = F.col("r._new").isNotNull()
    out = []
    for f in target.schema.fields:
        old = F.col(f"t.`{f.name}`")
        if f.name == mark:
            empty = F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(None)
            value = F.when(new, empty.cast(f.dataType)).otherwise(old)
        elif f.name not in rows.columns:
            value = old
        else:
            take = new if not unchanged else new & ~F.array_contains(F.coalesce(F.col(f"r.`{unchanged}`"), F.array().cast("array<string>")), f.name)
            value = F.when(take, F.col(f"r.`{f.name}`").cast(f.dataType)).otherwise(old)
        out.append(value.alias(f.name))
    return j.select(*out)


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose columns are keys alone: inserted if absent, else nothing."""
    t, r = _on(target, rows, keys)
    missing = r.join(t.select("_k"), "_k", "left_anti").drop("_k").dropDuplicates(keys)
    return target.unionByName(missing, allowMissingColumns=True)


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def split_ids(ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usable ids, and those with a NULL in the key, which are errors."""
    null = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    return ids.where(~null), ids.where(null)


def delete_by_key(target: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The target without the keys of ``ids``; without key columns nothing is deleted. NULL keys never match."""
    if not keys:
        return target
    good, _ = split_ids(ids, keys)
    t, r = _on(target, good, keys)
    return t.join(r.select("_k"), "_k", "left_anti").drop("_k")


def soft_delete(target: DataFrame, ids: DataFrame, keys: list[str], column: str, at: str | None = None) -> DataFrame:
    """Matched rows are marked with a time or with true; no row is created, and unmatched ids do nothing."""
    good, _ = split_ids(ids, keys)
    t, r = _on(target, good, keys)
    j = t.join(r.select("_k", F.lit(True).alias("_gone")).distinct(), "_k", "left")
    kind = target.schema[column].dataType
    mark = (F.lit(at) if at is not None else F.lit(True)).cast(kind)
    return j.withColumn(column, F.when(F.col("_gone"), mark).otherwise(F.col(column))).select(*target.columns)


def truncate(target: DataFrame, policy: str = "delete") -> tuple[DataFrame, str | None]:
    """An empty target; refused, with a notice, where deletes are soft or ignored."""
    if policy != "delete":
        return target, f"a truncate is not mirrored: deletes are {policy}"
    return target.limit(0), None


def keep_ops(changes: DataFrame, policy: str) -> DataFrame:
    """Under the delete policy ``ignore`` the target keeps its rows: deletes and truncates are left out."""
    return changes.where(~F.col("op").isin("delete", "truncate")) if policy == "ignore" else changes


def skip_unchanged(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ from the target in some written column, or are not there; compared by kind."""
    t, r = _on(target, rows, keys)
    cols = [c for c in rows.columns if c in target.columns and c not in keys]
    j = r.alias("r").join(t.withColumn("_there", F.lit(True)).alias("t"), "_k", "left")
    equal = F.col("t._there").isNotNull()
    for c in cols:
        equal = equal & same(F.col(f"r.`{c}`"), F.col(f"t.`{c}`"), rows.schema[c].dataType, target.schema[c].dataType, kind_of(target.schema[c].dataType))
    return j.where(~equal).select("r.*").drop("_k")


def write_counts(target: DataFrame, rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys an upsert of ``rows`` and a delete of ``ids`` insert, update, leave alike and delete."""
    t, r = _on(target, rows, keys)
    changed = skip_unchanged(target, rows, keys)
    c = changed.withColumn("_k", key_text(keys, changed.schema)).select("_k", F.lit(True).alias("_c"))
    j = r.select("_k").join(t.select("_k", F.lit(True).alias("_t")), "_k", "left").join(c, "_k", "left")
    up = j.agg(F.count_if(F.col("_t").isNull()).alias("inserted"), F.count_if(F.col("_t").isNotNull() & F.col("_c").isNotNull()).alias("updated"), F.count_if(F.col("_c").isNull()).alias("same"))
    d = ids.select(key_text(keys, ids.schema).alias("_k")).distinct().join(t.select("_k"), "_k", "left_semi").agg(F.count("*").alias("deleted"))
    return up.crossJoin(d)  # one row each


def counted_write(target: DataFrame, rows: DataFrame, ids: DataFrame, keys: list[str], counts: Observation) -> DataFrame:
    """The target after an upsert of ``rows`` and a delete of ``ids``; ``counts`` learns ``inserted, updated, same, deleted`` as the result is written.

    One rewrite: the counts are what ``write_counts`` gives, but without a join of their own.
    """
    t, r = _on(target, rows, keys)
    good, _ = split_ids(ids, keys)
    gone = good.select(key_text(keys, good.schema).alias("_k")).distinct().withColumn("_gone", F.lit(True))
    j = t.withColumn("_old", F.lit(True)).alias("t").join(r.withColumn("_new", F.lit(True)).alias("r"), "_k", "full_outer").join(gone, "_k", "left")
    new, old, away = F.col("r._new").isNotNull(), F.col("t._old").isNotNull(), F.col("_gone").isNotNull()
    alike = F.lit(True)
    for c in rows.columns:
        if c in target.columns and c not in keys:
            alike = alike & same(F.col(f"r.`{c}`"), F.col(f"t.`{c}`"), rows.schema[c].dataType, target.schema[c].dataType, kind_of(target.schema[c].dataType))
    j = j.observe(counts, F.count_if(new & ~old).alias("inserted"), F.count_if(new & old & ~alike).alias("updated"), F.count_if(new & old & alike).alias("same"), F.count_if(old & away).alias("deleted"))
    value = lambda f: F.when(new, F.col(f"r.`{f.name}`").cast(f.dataType)).otherwise(F.col(f"t.`{f.name}`")) if f.name in rows.columns else F.col(f"t.`{f.name}`")
    return j.where(~away).select(*[value(f).alias(f.name) for f in target.schema.fields])


def ensure_target(spark: SparkSession, existing: DataFrame | None, shaped: DataFrame, create: bool = True) -> DataFrame:
    """The target, or an empty one of the source's shape where it is missing and may be made."""
    if existing is not None:
        return existing
    if not create:
        raise ValueError("the target does not exist")
    return spark.createDataFrame([], shaped.schema)


def add_columns(target: DataFrame, wanted: T.StructType) -> DataFrame:
    """Missing columns are added, nullable; none is retyped or dropped."""
    return target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in target.columns])


class VersionedTable:
    """A table as numbered Parquet versions and a pointer: readers see one whole version.

    ``apply`` is idempotent by batch id, which is what ``foreachBatch`` needs.
    The pointer is a row appended after its data is complete; the newest counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointer(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema("version long, dir string, batch long").parquet(f"{self.path}/pointer") if fs.exists(hadoop) else None

    def latest(self) -> tuple[int, str, int] | None:
        p = self._pointer()
        r = p.orderBy(F.desc("version")).first() if p is not None else None
        return (r["version"], r["dir"], r["batch"]) if r else None

    def read(self) -> DataFrame | None:
        now = self.latest()
        return self.spark.read.parquet(f"{self.path}/{now[1]}") if now else None

    def write(self, df: DataFrame, batch: int = -1) -> None:
        now = self.latest()
        version = now[0] + 1 if now else 0
        name = f"v{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(version, name, batch)], "version long, dir string, batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def apply(self, change: Callable[[DataFrame | None], DataFrame], batch: int) -> bool:
        """Write ``change(current)`` unless this batch was applied before."""
        now = self.latest()
        if now and now[2] >= batch:
            return False
        self.write(change(self.read()), batch)
        return True


def fan_out(batch: DataFrame, batch_id: int, targets: dict[str, Callable[[DataFrame, int], None]], done: VersionedTable) -> list[str]:
    """Write one batch to several targets; those that committed it before are skipped on retry. Returns the names written now.

    The batch is computed once. The first failure is raised after the others were tried, so that the batch is retried.
    """
    spark = batch.sparkSession
    log = done.read()
    before = {r["target"] for r in log.where(F.col("batch_id") == batch_id).collect()} if log is not None else set()
    batch = batch.persist()
    written, failure = [], None
    try:
        for name, write in targets.items():
            if name in before:
                continue
            try:
                write(batch, batch_id)
            except Exception as e:  # noqa: BLE001 - any target may fail in its own way
                failure = failure or e
                continue
            row = spark.createDataFrame([(batch_id, name)], "batch_id long, target string")
            now = done.read()
            done.write(now.union(row) if now is not None else row)
            written.append(name)
    finally:
        batch.unpersist()
    if failure:
        raise failure
    return written


def fan_out_once(batch: DataFrame, batch_id: int, targets: dict[str, tuple[VersionedTable, Callable[[DataFrame | None, DataFrame], DataFrame]]]) -> list[str]:
    """Write one batch to several versioned targets, each exactly once. Returns the names written now.

    ``change(current, batch)`` gives a target's next version. The batch's id
    stands in the target's own pointer row, which appears with the data or not at
    all; so a crash at any moment leaves no target that was written and does not
    know it, and a retry, or a second writer that comes later, repeats no append.
    The first failure is raised after the others were tried.
    """
    batch = batch.persist()
    written, failure = [], None
    try:
        for name, (table, change) in targets.items():
            try:
                if table.apply(lambda now, change=change: change(now, batch), batch_id):
                    written.append(name)
            except Exception as e:  # noqa: BLE001 - any target may fail in its own way
                failure = failure or e
    finally:
        batch.unpersist()
    if failure:
        raise failure
    return written


def merge_into(rows: DataFrame, table: str, keys: list[str]) -> None:
    """Pass-through for table formats that have MERGE."""
    on = " and ".join(f"{table}.`{k}` = source.`{k}`" for k in keys)
    rows.alias("source").mergeInto(table, F.expr(on)).whenMatched().updateAll().whenNotMatched().insertAll().merge()
