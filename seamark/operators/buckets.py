"""A table dealt by key into buckets, where a write rewrites only the buckets it touches.

A version is a manifest: one row for each bucket with its folder, key range,
number of rows and digest. A write reads the buckets that its keys fall in,
writes them anew, and links all others from the version before. The version's
number is claimed by one atomic step of the file system, so of two writers that
started from one version only one commits, and a crash before that step leaves
the old version as it was.

The folder must be on a file system where a file can appear under a name only
if none is there: HDFS and its like (rename), or a local or network disk (link).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import key_text
from .changes import apply_changes
from .claims import Claims, Conflict
from .digests import LEAF_BITS, SUMS, compare_ranges, differing, key_hash, merge, place, row_digest, sums
from .writes import counted_write, delete_by_key, soft_delete, upsert

MANIFEST = "bucket int, folder string, low_key string, high_key string, n long, low long, high long, x long"
BUCKET_BITS = 6


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    schema: T.StructType
    #: The last batch that each writer applied.
    batches: dict[str, int] = field(default_factory=dict)
    #: What the write counted, if it did.
    counts: dict[str, int] = field(default_factory=dict)


class BucketTable:
    """Versions of a table keyed by ``keys`` in 2^``bits`` buckets, by ranges of the key's hash.

    Buckets are even, however keys are spread. NULL is a key value like others.
    Digests of leaves stand beside each bucket's rows (see ``digests``).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bits: int = BUCKET_BITS):
        if not keys:
            raise ValueError("a table of buckets needs keys")
        if not 0 < bits <= LEAF_BITS:
            raise ValueError(f"from 1 to {LEAF_BITS} bits")
        self.spark, self.path, self.keys, self.bits = spark, path.rstrip("/"), keys, bits
        self._versions = Claims(spark, f"{self.path}/versions")

    # versions

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Committed versions, in order."""
        return self._versions.numbers()

    def version(self, number: int | None = None) -> Version | None:
        known = self.numbers()
        if not known or (number is not None and number not in known):
            return None
        number = known[-1] if number is None else number
        v = json.loads(self._versions.read(number))
        return Version(number, v["manifest"], T.StructType.fromJson(v["schema"]), v["batches"], v.get("counts", {}))

    def _claim(self, number: int, text: str) -> None:
        self._versions.claim(number, text)

    def manifest(self, version: Version | None = None) -> DataFrame:
        """Buckets of a version: at most 2^bits rows."""
        v = version or self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{v.manifest}") if v else self.spark.createDataFrame([], MANIFEST)

    # reading

    def _rows(self, v: Version, buckets: list[int] | None = None) -> DataFrame:
        m = self.manifest(v)
        m = m if buckets is None else m.where(F.col("bucket").isin(buckets))
        folders = [f"{self.path}/{r['folder']}" for r in m.select("folder").collect()]  # a name for each bucket
        return self.spark.read.schema(v.schema).parquet(*folders) if folders else self.spark.createDataFrame([], v.schema)

    def read(self, number: int | None = None) -> DataFrame | None:
        v = self.version(number)
        return self._rows(v) if v else None

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Rows with the keys of ``ids``: only their buckets are read."""
        v = self.version()
        found = self._rows(v, self._buckets_of(ids))
        k = ids.select(key_text(self.keys, ids.schema).alias("_k")).distinct()
        return found.withColumn("_k", key_text(self.keys, found.schema)).join(k, "_k", "left_semi").drop("_k")

    def _bucket(self, df: DataFrame):
        return place(key_hash(self.keys, df.schema), self.bits).cast("int")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket(rows).alias("b")).distinct().collect()]  # at most 2^bits

    # writing

    def apply(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None, batch: tuple[str, int] | None = None, tries: int = 1, counts: Callable[[], dict] | None = None) -> int:
        """Commit ``change(rows of the touched buckets)`` as the next version; returns its number.

        ``rows`` tells which buckets are touched: those of its keys. ``batch`` is
        a writer's name and its batch number; a batch that the current version
        already holds does nothing. ``counts`` is asked once the rows are written,
        and its answer stands in the version. ``schema`` is the table's if there is none
        yet, and may add columns. If another writer commits first, the work is
        done again on its version, ``tries`` times in all; then ``Conflict``.
        """
        touched = self._buckets_of(rows)
        for left in range(tries - 1, -1, -1):
            now = self.version()
            if now and batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now.number
            try:
                return self._commit(now, change, schema or (now.schema if now else rows.schema), touched, batch, counts)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one try")

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """All buckets anew."""
        now = self.version()
        return self._commit(now, lambda _: rows, rows.schema, None, batch)

    def _commit(self, now: Version | None, change: Callable[[DataFrame], DataFrame], schema: T.StructType, touched: list[int] | None, batch: tuple[str, int] | None, counts: Callable[[], dict] | None = None) -> int:
        number = now.number + 1 if now else 0
        tag = f"{number:010d}-{uuid.uuid4().hex[:12]}"
        current = self.spark.createDataFrame([], schema)
        if now and touched:
            current = self._rows(Version(now.number, now.manifest, schema, now.batches), touched)
        old = self.manifest(now)
        old = old.where(~F.col("bucket").isin(touched)) if touched else (old if touched == [] else old.limit(0))
        if touched != []:
            old = old.unionByName(self._write(change(current), tag, touched))
        old.coalesce(1).write.parquet(f"{self.path}/manifests/{tag}")
        batches = dict(now.batches) if now else {}
        if batch:
            batches[batch[0]] = batch[1]
        self._claim(number, json.dumps({"manifest": f"manifests/{tag}", "schema": json.loads(schema.json()), "batches": batches, "counts": counts() if counts else {}}))
        return number

    def _write(self, new: DataFrame, tag: str, touched: list[int] | None) -> DataFrame:
        """Rows and leaf digests of the new buckets, in a folder each; their manifest rows."""
        b = self._bucket(new)
        n = len(touched) if touched is not None else 1 << self.bits
        new.withColumn("_b", b).repartition(n, "_b").write.partitionBy("_b").parquet(f"{self.path}/rows/{tag}")
        written = self.spark.read.schema(T.StructType([*new.schema.fields, T.StructField("_b", T.IntegerType())])).parquet(f"{self.path}/rows/{tag}")
        values = [c for c in new.columns if c not in self.keys]
        digested = written.select("_b", place(key_hash(self.keys, written.schema), LEAF_BITS).alias("node"), key_text(self.keys, written.schema).alias("k"), row_digest(written, self.keys, values).alias("d"))
        leaves = digested.groupBy("_b", "node").agg(*sums(F.col("d")), F.min("k").alias("low_key"), F.max("k").alias("high_key"))
        leaves.repartition(1 if n < 64 else n // 64, "_b").write.partitionBy("_b").parquet(f"{self.path}/leaves/{tag}")
        leaves = self.spark.read.schema("node long, n long, low long, high long, x long, low_key string, high_key string, _b int").parquet(f"{self.path}/leaves/{tag}")
        total = leaves.groupBy("_b").agg(F.min("low_key").alias("low_key"), F.max("high_key").alias("high_key"), F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("x").alias("x"))
        return total.select(F.col("_b").alias("bucket"), F.concat(F.lit(f"rows/{tag}/_b="), F.col("_b").cast("string")).alias("folder"), "low_key", "high_key", *SUMS)

    def upsert(self, rows: DataFrame, unchanged: str | None = None, mark: str | None = None, batch: tuple[str, int] | None = None, tries: int = 1) -> int:
        """``writes.upsert`` on the touched buckets alone."""
        schema = None if self.numbers() else T.StructType([f for f in rows.schema.fields if f.name != unchanged])
        return self.apply(rows, lambda now: upsert(now, rows, self.keys, unchanged, mark), schema, batch, tries)

    def delete(self, ids: DataFrame, column: str | None = None, at: str | None = None, batch: tuple[str, int] | None = None, tries: int = 1) -> int:
        """The keys of ``ids`` go, or are marked in ``column``."""
        change = (lambda now: soft_delete(now, ids, self.keys, column, at)) if column else (lambda now: delete_by_key(now, ids, self.keys))
        return self.apply(ids, change, None, batch, tries)

    def write(self, rows: DataFrame, ids: DataFrame, batch: tuple[str, int] | None = None, tries: int = 1) -> int:
        """Upsert ``rows`` and delete ``ids`` as one version, which tells how many keys were inserted, updated, alike and deleted."""
        seen: list[Observation] = []

        def change(now: DataFrame) -> DataFrame:
            seen.append(Observation())
            return counted_write(now, rows, ids, self.keys, seen[-1])

        both = rows.select(*self.keys).unionByName(ids.select(*self.keys))
        return self.apply(both, change, None if self.numbers() else rows.schema, batch, tries, lambda: seen[-1].get if seen else {})

    def follow(self, changes: DataFrame, policy: str = "delete", mark: str | None = None, at: str | None = None, batch: tuple[str, int] | None = None, schema: T.StructType | None = None, tries: int = 1) -> int:
        """Fold a change log (``changes.apply_changes``); a log with a truncate touches every bucket."""
        if changes.where("op = 'truncate'").isEmpty():
            return self.apply(changes, lambda now: apply_changes(now, changes, self.keys, policy, mark, at), schema, batch, tries)
        now = self.version()
        if now and batch and now.batches.get(batch[0], -1) >= batch[1]:
            return now.number
        target = self._rows(now) if now else self.spark.createDataFrame([], schema)
        return self._commit(now, lambda _: apply_changes(target, changes, self.keys, policy, mark, at), target.schema, None, batch)

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions before the newest ``keep``, and every folder that none of those left uses; returns the number of folders.

        Only for a time without writers: what a running writer has not committed yet looks unused.
        """
        fs, gone, known = self._fs(), 0, self.numbers()
        left = [self.version(n) for n in known[-keep:]]
        used = {v.manifest for v in left} | {r["folder"] for v in left for r in self.manifest(v).select("folder").collect()}
        for n in known[:-keep]:
            fs.delete(self._hadoop(f"versions/{n:010d}"), False)
        tags = {u.split("/")[1] for u in used}
        for kind in ("manifests", "rows", "leaves"):
            for tag in fs.listStatus(self._hadoop(kind)):
                name = tag.getPath().getName()
                buckets = [s.getPath().getName() for s in fs.listStatus(tag.getPath()) if s.isDirectory()]
                stale = [f"{kind}/{name}"] if name not in tags or (kind == "manifests" and f"{kind}/{name}" not in used) else [f"{kind}/{name}/{b}" for b in buckets if f"rows/{name}/{b}" not in used]
                for s in stale:
                    gone += bool(fs.delete(self._hadoop(s), True))
        return gone

    # comparing

    def nodes(self, version: Version | None = None) -> DataFrame:
        """The tree's level of buckets, from the manifest."""
        return self.manifest(version).select(F.col("bucket").cast("long").alias("node"), *SUMS)

    def leaves(self, buckets: list[int] | None = None, version: Version | None = None) -> DataFrame:
        """Leaves of some buckets, or all: small files beside the rows."""
        m = self.manifest(version)
        m = m if buckets is None else m.where(F.col("bucket").isin(buckets))
        folders = [f"{self.path}/leaves/{r['folder'].removeprefix('rows/')}" for r in m.select("folder").collect()]
        schema = "node long, n long, low long, high long, x long"
        return merge(self.spark.read.schema(schema).parquet(*folders)) if folders else self.spark.createDataFrame([], schema)


def compare_tables(expected: BucketTable, actual: BucketTable, **how) -> DataFrame:
    """What differs between the current versions of two tables of equal keys and bits, as ``verify.compare`` classes it.

    Manifests first; leaf digests only of buckets that differ; rows only of
    leaves that differ. Copies in sync cost two small files.
    """
    if (expected.keys, expected.bits) != (actual.keys, actual.bits):
        raise ValueError("tables of other keys or buckets have other ranges")
    e, a = expected.version(), actual.version()
    buckets = [r["node"] for r in differing(expected.nodes(e), actual.nodes(a)).collect()]  # at most 2^bits
    ranges = differing(expected.leaves(buckets, e), actual.leaves(buckets, a))
    return compare_ranges(expected._rows(e, buckets), actual._rows(a, buckets), ranges, expected.keys, **how).where("class <> 'same'")
