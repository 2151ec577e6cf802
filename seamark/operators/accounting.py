"""Failure accounting: deliveries, retries, isolation of bad rows, dead letters, retention, alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import key_text


def last_status(deliveries: DataFrame) -> DataFrame:
    """The last delivery of each (job, sequence): ``job, sequence, status, n_rows``."""
    g = deliveries.groupBy("job", "sequence").agg(F.max_by(F.struct("status", "n_rows"), "at").alias("d"))
    return g.select("job", "sequence", "d.status", "d.n_rows")


def job_counters(deliveries: DataFrame) -> DataFrame:
    """Rows sent, failed and skipped for each job, each sequence by its last status."""
    rows = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n_rows"))), F.lit(0))
    return last_status(deliveries).groupBy("job").agg(rows("success").alias("sent"), rows("failed").alias("failed"), rows("skipped").alias("skipped"), F.count("*").alias("sequences"))


def unsettled(batches: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Batches (``job, sequence``) that were neither sent nor skipped: what a resumed job still sends."""
    settled = last_status(deliveries).where(F.col("status").isin("success", "skipped"))
    return batches.join(settled, ["job", "sequence"], "left_anti")


def skip(deliveries: DataFrame, sequences: DataFrame, batch_size: int, total_rows: int, at: str) -> DataFrame:
    """Skipped rows for sequences without a delivery; the last batch may be short, none lies beyond the end."""
    new = sequences.join(deliveries.select("job", "sequence").distinct(), ["job", "sequence"], "left_anti")
    n = F.least(F.lit(batch_size), F.lit(total_rows) - F.col("sequence") * batch_size)
    return new.select("job", "sequence", F.lit("skipped").alias("status"), n.cast("long").alias("n_rows"), F.lit(at).cast("timestamp_ntz").alias("at")).where("n_rows > 0")


def failed_rows(snapshot: DataFrame, deliveries: DataFrame, job: str) -> DataFrame:
    """Rows of a snapshot (``chunked_snapshot``) whose sequence failed last."""
    failed = last_status(deliveries).where((F.col("job") == job) & (F.col("status") == "failed")).select("sequence")
    return snapshot.join(failed, "sequence", "left_semi")


def resend_captured(captures: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Recorded bodies as rows with their op (a delete stays a delete), and the captures refused because they were cut or don't parse."""
    p = captures.withColumn("_row", F.from_json("body", schema))
    bad = F.col("truncated") | F.try_parse_json("body").isNull()
    good = p.where(~bad).select("op", "_row.*")
    reason = F.when(F.col("truncated"), "the capture was cut").otherwise("the capture does not parse")
    return good, p.where(bad).select("id", reason.alias("reason"))


def isolate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``_reason``: the first target rule that the row breaks (rule name), NULL for a good row."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]) if rules else F.lit(None).cast("string")
    return rows.withColumn("_reason", reason)


def isolate_duplicates(rows: DataFrame, keys: list[str], reason: str = "unique") -> DataFrame:
    """Rows of a key that stands more than once are bad: counted by key, not gathered."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return rows.join(n, keys, "left").withColumn("_reason", F.when(F.col("_n") > 1, reason)).drop("_n")


def isolation_verdict(isolated: DataFrame, limit: int = 100) -> DataFrame:
    """One row: ``good, bad, systemic``; systemic when nothing is good or too many are bad."""
    good, bad = F.count_if(F.col("_reason").isNull()), F.count_if(F.col("_reason").isNotNull())
    return isolated.agg(good.alias("good"), bad.alias("bad"), ((bad > 0) & ((good == 0) | (bad > limit))).alias("systemic"))


def park(isolated: DataFrame, bridge: str, op: str, pos: Column, at: str) -> DataFrame:
    """Bad rows in full, for the dead-letter table: ``bridge, op, pos, row (JSON), error, status, at``."""
    cols = [c for c in isolated.columns if c != "_reason"]
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return isolated.where(F.col("_reason").isNotNull()).select(F.lit(bridge).alias("bridge"), F.lit(op).alias("op"), pos.alias("pos"), body.alias("row"), F.col("_reason").alias("error"), F.lit("pending").alias("status"), F.lit(at).cast("timestamp_ntz").alias("at"))


def pending(dead: DataFrame, limit: int = 10_000) -> DataFrame:
    """``bridge, entries, n_rows, full`` of pending dead letters."""
    return dead.where("status = 'pending'").groupBy("bridge").agg(F.count("*").alias("entries"), F.sum("n_rows").alias("n_rows")).withColumn("full", F.col("n_rows") >= limit)


def refresh_verdicts(parked: DataFrame, source: DataFrame, keys: list[str], in_filter: Column, deletes: bool, force: bool = False) -> DataFrame:
    """What a retry does for each parked key: ``upsert`` the row as it is now, ``delete`` it, ``nothing``, or ``needs force``.

    ``in_filter`` is the source filter over the source's columns.
    """
    p = parked.withColumn("_k", key_text(keys, parked.schema))
    s = source.select(key_text(keys, source.schema).alias("_k"), in_filter.alias("_in"), F.lit(True).alias("_there"))
    j = p.join(s, "_k", "left")
    absent = F.lit("delete") if deletes else F.lit("delete" if force else "needs force")
    v = F.when(F.col("_there").isNull(), absent).when(~F.coalesce("_in", F.lit(False)), "nothing").otherwise("upsert")
    return j.withColumn("verdict", v).drop("_k", "_in", "_there")


def replay_recorded(dead: DataFrame, schema: str) -> DataFrame:
    """Recorded rows of pending dead letters, for append targets and sources without a key."""
    return dead.where("status = 'pending'").select(F.from_json("row", schema).alias("r")).select("r.*")


def close_letters(dead: DataFrame, which: Column, status: str, at: str) -> DataFrame:
    """The dead-letter table with the chosen pending letters ``forced`` or ``discarded``."""
    hit = which & (F.col("status") == "pending")
    return dead.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "settled_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("settled_at") if "settled_at" in dead.columns else F.lit(None).cast("timestamp_ntz"))})


def failure_export(deliveries: DataFrame, reason: str = "error") -> DataFrame:
    """Failed deliveries as records for CSV or NDJSON, cells made safe for spreadsheets."""
    from .exports import csv_safe

    last = deliveries.where("status = 'failed'")
    return last.select("job", "sequence", "n_rows", csv_safe(F.col(reason)).alias("error"))


def retention(details: DataFrame, jobs: DataFrame, now: dt.datetime, days: int, newest: int, protected: DataFrame) -> DataFrame:
    """Delivery details that are kept.

    A finished job's details go whole once it ended more than ``days`` ago. A
    live job's go row by row by age, and beyond the ``newest`` most recent.
    Parked sequences (``protected``: job, sequence) stay.
    """
    cut = F.lit(str(now - dt.timedelta(days=days))).cast("timestamp_ntz")
    ended = jobs.where(F.col("finished_at").isNotNull()).select("job", "finished_at")
    finished = details.join(ended.where(F.col("finished_at") >= cut), "job", "left_semi")
    # a filter on the rank alone lets every task keep its newest before the shuffle; older rows than the cut rank behind all others
    w = Window.partitionBy("job").orderBy(F.desc("at"), F.desc("sequence"))
    live = details.where(F.col("at") >= cut).join(ended, "job", "left_anti").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest).drop("_r")
    kept = finished.unionByName(live).join(protected, ["job", "sequence"], "left_anti")
    return kept.unionByName(details.join(protected, ["job", "sequence"], "left_semi")).select(*details.columns)


def expire_letters(dead: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """Settled dead letters go after ``days``; pending ones stay."""
    cut = F.lit(str(now - dt.timedelta(days=days))).cast("timestamp_ntz")
    return dead.where((F.col("status") == "pending") | (F.col("settled_at") >= cut))


def last_verifications(runs: DataFrame, k: int = 10) -> DataFrame:
    """The newest ``k`` verification runs of each bridge."""
    w = Window.partitionBy("bridge").orderBy(F.desc("at"), F.desc("run"))
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def audit_page(log: DataFrame, equal: dict[str, str], after: tuple | None, limit: int) -> DataFrame:
    """Audit rows by equality filters, newest first, strictly after ``(at, id)``."""
    for c, v in equal.items():
        log = log.where(F.col(c) == v)
    if after:
        at, i = F.lit(str(after[0])).cast("timestamp_ntz"), F.lit(after[1])
        log = log.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("id") < i)))
    return log.orderBy(F.desc("at"), F.desc("id")).limit(limit)


#: Parts of names whose values are secret.
SECRET = r"(?i)(authorization|password|passwd|secret|token|api_?key|credential|private_?key)"


def audit_redact(details: Column) -> Column:
    """Values of secret-named entries of a map, replaced."""
    return F.transform_values(details, lambda k, v: F.when(k.rlike(SECRET) & v.isNotNull(), F.lit("[redacted]")).otherwise(v))


def summary_metrics(bridges: DataFrame, jobs: DataFrame, deliveries: DataFrame, dead: DataFrame) -> DataFrame:
    """``metric, label, value``: bridges by trigger, jobs by status, rows by outcome, dead rows."""
    parts = [
        bridges.groupBy(F.col("trigger").alias("label")).agg(F.count("*").alias("value")).select(F.lit("bridges").alias("metric"), "label", "value"),
        jobs.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("value")).select(F.lit("jobs").alias("metric"), "label", "value"),
        last_status(deliveries).groupBy(F.col("status").alias("label")).agg(F.sum("n_rows").alias("value")).select(F.lit("rows").alias("metric"), "label", "value"),
        dead.where("status = 'pending'").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("value")).select(F.lit("dead rows").alias("metric"), F.lit("pending").alias("label"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sent_alerts(first: np.ndarray, micros: np.ndarray, span: int) -> np.ndarray:
    """Which of the alerts are sent, each ``span`` or more after the last sent; they stand by key and time, and ``first`` marks each key's first.

    An alert that comes ``span`` or more after the one before it is always sent,
    so the rows between two such are walked side by side, one step of all at once.
    """
    sent = np.zeros(len(micros), bool)
    gap = np.diff(micros, prepend=micros[:1])
    apart = first | (gap >= span)
    apart[:1] = True
    clock = np.cumsum(np.where(apart, span, gap))
    now = np.flatnonzero(apart)
    ends = np.append(now[1:], len(micros))
    while len(now):
        sent[now] = True
        now = np.maximum(np.searchsorted(clock, clock[now] + span), now + 1)
        inside = now < ends
        now, ends = now[inside], ends[inside]
    return sent


def _throttle(seconds: int):
    span = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = 0, 0  # when the last alert was sent, and which of its key's it was
        for b in batches:
            at, n = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_numpy()
            if not len(n):
                continue
            known = at.is_valid().to_numpy(zero_copy_only=False)
            micros = at.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy()
            # alerts without a time come first in their key, and each is sent; so is the first with one
            first = (n == 1) | ~known | ~np.append(True, known[:-1])
            start = 0 if first[0] else 1
            if start:  # the last sent stands before its key's other alerts
                first, micros = np.append(True, first), np.append(last, micros)
            sent = np.flatnonzero(sent_alerts(first, micros, span)[start:])
            if not len(sent):
                continue
            before = np.append(number, n[sent[:-1]])
            held = np.where(n[sent] == 1, 0, n[sent] - before - 1)
            last, number = micros[start:][sent[-1]], n[sent[-1]]
            out = b.take(pa.array(sent))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(held, pa.int64())], names=[*out.schema.names[:-1], "suppressed"])

    return run


def alert_throttle(alerts: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """Alerts that are sent: for each key one in ``seconds``, counted from the last *sent*; each carries how many were held back since.

    Each task walks its keys' alerts as one sorted stream of batches, whatever
    the number of keys and of a key's alerts. Only key and time move. An alert
    without a time is sent.
    """
    order = Window.partitionBy(*keys).orderBy("at")
    number = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = alerts.select(*keys, "at").withColumn("_n", number).sortWithinPartitions(*keys, "at", "_n")
    schema = T.StructType([alerts.schema[c] for c in (*keys, "at")]).add("suppressed", "long")
    return rows.mapInArrow(_throttle(seconds), schema)


def level_changes(levels: DataFrame) -> DataFrame:
    """Only rows whose level differs from the bridge's row before (the first counts)."""
    before = F.lag("level").over(Window.partitionBy("bridge").orderBy("at"))
    return levels.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("level"))).drop("_before")
