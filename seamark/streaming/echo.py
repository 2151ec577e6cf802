"""Loop prevention: a ledger of what was written where, and incoming changes that only echo it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.canonical import canonical, key_text

TTL_SECONDS, PER_KEY, DIGEST_OVER = 300, 20, 2048


def reading(df: DataFrame, columns: list[str]) -> Column:
    """The row's canonical values as one text; a digest where that is long. Two copies of a row have the same reading."""
    text = F.to_json(F.array(*[canonical(F.col(c), df.schema[c].dataType) for c in columns]))
    return F.when(F.length(text) > DIGEST_OVER, F.sha2(text, 256)).otherwise(text)


def announce(ledger: DataFrame | None, rows: DataFrame, table: str, keys: list[str], columns: list[str], op: str, origins: list[str], at: Column) -> DataFrame:
    """The ledger after writing ``rows``: ``table, k, op, reading, origins, at``; the newest PER_KEY of a key are kept."""
    value = F.lit("") if op in ("delete", "truncate") else reading(rows, columns)
    key = F.lit(table) if op == "truncate" else key_text(keys, rows.schema)
    new = rows.select(F.lit(table).alias("table"), key.alias("k"), F.lit(op).alias("op"), value.alias("reading"), F.array(*map(F.lit, origins)).cast("array<string>").alias("origins"), at.alias("at"))
    new = new.distinct() if op == "truncate" else new
    everything = ledger.unionByName(new) if ledger is not None else new
    r = F.row_number().over(Window.partitionBy("table", "k").orderBy(F.desc("at"), "reading"))
    return everything.withColumn("_r", r).where(F.col("_r") <= PER_KEY).drop("_r")


def recognise(changes: DataFrame, ledger: DataFrame, table: str, keys: list[str], columns: list[str], at: str = "at") -> DataFrame:
    """Changes with ``is_echo`` and the echoed entry's ``echo_at`` and ``echo_origins``.

    A change echoes an entry of its table and key, written at most TTL before
    it, with the same reading (a delete or truncate: the same op). Of several
    the earliest matches.
    """
    op = F.when(F.col("op").isin("insert", "update"), "upsert").otherwise(F.col("op"))
    c = changes.withColumns({"_k": F.when(F.col("op") == "truncate", F.lit(table)).otherwise(key_text(keys, changes.schema)), "_v": F.when(F.col("op").isin("delete", "truncate"), F.lit("")).otherwise(reading(changes, columns)), "_op": op})
    c = c.withColumn("_at", F.col(at))
    e = ledger.where(F.col("table") == table).select("k", "reading", F.when(F.col("op").isin("insert", "update"), "upsert").otherwise(F.col("op")).alias("e_op"), F.col("origins").alias("e_origins"), F.col("at").alias("e_at"))
    hit = (F.col("_k") == F.col("k")) & (F.col("_v") == F.col("reading")) & (F.col("_op") == F.col("e_op")) & (F.col("e_at") <= F.col("_at")) & (F.col("e_at") >= F.col("_at") - F.expr(f"interval {TTL_SECONDS} seconds"))
    on = ["_k", "_v", "_op", "_at"]
    j = c.select(*on).distinct().join(e, hit).groupBy(*on).agg(F.min_by(F.struct("e_at", "e_origins"), "e_at").alias("m"))
    return c.join(j, on, "left").select(*changes.columns, F.col("m.e_at").isNotNull().alias("is_echo"), F.col("m.e_at").alias("echo_at"), F.col("m.e_origins").alias("echo_origins"))


def consume(ledger: DataFrame, echoed: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """The ledger without the entries that echoes matched, and older ones of their keys."""
    used = echoed.where("is_echo").withColumn("k", F.when(F.col("op") == "truncate", F.lit(table)).otherwise(key_text(keys, echoed.schema))).groupBy("k").agg(F.max("echo_at").alias("upto"))
    j = ledger.join(used.withColumn("table", F.lit(table)), ["table", "k"], "left")
    return j.where(F.col("upto").isNull() | (F.col("at") > F.col("upto"))).select(*ledger.columns)


def route(changes: DataFrame, source: str, targets: Column, origins: Column) -> DataFrame:
    """``forward`` is false when every target is already among the origins; ``origins`` grows by the source."""
    return changes.withColumns({"forward": ~F.forall(targets, lambda t: F.array_contains(origins, t)), "origins": F.array_union(origins, F.array(F.lit(source)))})


#: An op that only moves time on: its rows let both sides' watermarks pass, and are not given on.
HEARTBEAT = "heartbeat"


def recognise_stream(changes: DataFrame, writes: DataFrame, table: str, keys: list[str], columns: list[str], identity: list[str], at: str = "at", late: str = "10 minutes", ttl: int = TTL_SECONDS) -> DataFrame:
    """A stream of changes beside a stream of ledger entries -> changes with ``is_echo``, by an interval join of both.

    A change echoes an entry of its table, key, op and reading written at most
    ``ttl`` seconds before it. An echo is given as soon as both are there; what
    is none, once the watermark says that no entry can come any more. Each side
    has a watermark of ``late``, so entries are held for ``ttl`` and the lateness,
    and changes for the lateness, and no longer. Rows later than that are
    dropped. ``identity`` tells changes apart: one that several entries match is
    given once. Entries are not consumed: for that, see ``recognise_in_order``.
    A source without traffic sends rows of op ``HEARTBEAT`` on both sides.
    """
    op = F.when(F.col("op").isin("insert", "update"), "upsert").otherwise(F.col("op"))
    value = F.when(F.col("op").isin("delete", "truncate", HEARTBEAT), F.lit("")).otherwise(reading(changes, columns))
    key = F.when(F.col("op") == "truncate", F.lit(table)).otherwise(key_text(keys, changes.schema))
    c = changes.withColumns({"_k": key, "_v": value, "_op": op, "_at": F.col(at).cast("timestamp")}).withWatermark("_at", late)
    e = writes.where((F.col("table") == table) | (F.col("op") == HEARTBEAT)).select("k", "reading", op.alias("e_op"), F.col("at").cast("timestamp").alias("e_at")).withWatermark("e_at", late)
    hit = (F.col("_k") == F.col("k")) & (F.col("_v") == F.col("reading")) & (F.col("_op") == F.col("e_op")) & (F.col("e_at") <= F.col("_at")) & (F.col("e_at") >= F.col("_at") - F.expr(f"interval {ttl} seconds"))
    j = c.join(e, hit, "left_outer").select(*changes.columns, "_at", F.col("e_at").isNotNull().alias("is_echo"))
    return j.dropDuplicatesWithinWatermark(identity).where(F.col("op") != HEARTBEAT).drop("_at")


def recognise_in_order(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of writes and changes (``kind`` write or change, ``k``, ``reading``, ``at``) -> changes with ``is_echo``.

    Entries are consumed in order: a match takes the entry and all older ones
    of its key. The state of a key is its ledger, at most PER_KEY entries; it
    goes when nothing is held, and TTL_SECONDS after the last entry at the latest.
    """

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[tuple[str, pd.Timestamp]] = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(groups)).sort_values(["at", "kind"], ascending=[True, False])
        out = []
        for r in rows.itertuples():
            held = [(v, t) for v, t in held if (r.at - pd.Timestamp(t)).total_seconds() <= TTL_SECONDS]
            if r.kind == "write":
                held = [*held, (r.reading, r.at)][-PER_KEY:]
                continue
            hit = next((i for i, (v, _) in enumerate(held) if v == r.reading), None)
            out.append((key[0], r.reading, r.at, hit is not None))
            if hit is not None:
                held = held[hit + 1 :]
        if held:
            state.update(([v for v, _ in held], [pd.Timestamp(t).to_pydatetime() for _, t in held]))
            end = int(pd.Timestamp(held[-1][1]).timestamp() * 1000) + TTL_SECONDS * 1000
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["k", "reading", "at", "is_echo"])

    return events.withWatermark("at", watermark).groupBy("k").applyInPandasWithState(step, "k string, reading string, at timestamp, is_echo boolean", "readings array<string>, times array<timestamp>", "append", GroupStateTimeout.EventTimeTimeout)
