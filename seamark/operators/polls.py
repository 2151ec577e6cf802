"""Incremental reads: by an increasing column, by a time with lookback, by keys not seen yet.

Each poll returns the new rows and the next cursor as a one-row DataFrame, so
state stays in tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import key_text
from ..functions.predicate import Filter, predicate
from ..sources.tables import chunked_snapshot


def poll_increment(df: DataFrame, column: str, cursor: Column, limit: int | None = None, key: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows beyond the cursor (all, when it is NULL), and the new cursor; NULLs never move it."""
    c = F.col(f"`{column}`")
    rows = df.where(cursor.isNull() | (c > cursor))
    if limit is not None:
        rows = at_most(rows, column, list(key), limit)
    return rows, rows.agg(F.max(c).alias("m")).select(F.coalesce(F.greatest("m", cursor), F.col("m"), cursor).alias("cursor"))


def poll_timestamp(df: DataFrame, column: str, keys: list[str], cursor: Column, lookback_seconds: int, emitted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows from ``cursor - lookback`` on that were not emitted with that time.

    ``emitted`` holds ``k, at`` of rows already given. Returns the new rows, the
    next cursor (never backwards, never NULL by NULLs) and the emitted table
    trimmed to the window.
    """
    c = F.col(f"`{column}`")
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_seconds))
    window = df.where(cursor.isNull() | (c >= cursor - back)).withColumns({"_k": key_text(keys, df.schema), "_at": c})
    new = window.join(emitted.select(F.col("k").alias("_k"), F.col("at").alias("_at")), ["_k", "_at"], "left_anti")
    nxt = new.agg(F.max("_at").alias("m")).select(F.coalesce(F.greatest("m", cursor), cursor, F.col("m")).alias("cursor"))
    kept = emitted.union(new.select(F.col("_k").alias("k"), F.col("_at").alias("at")))
    trimmed = kept.crossJoin(F.broadcast(nxt)).where(F.col("at") >= F.col("cursor") - back).select("k", "at")  # one row
    return new.drop("_k", "_at"), nxt, trimmed


def poll_snapshot(df: DataFrame, keys: list[str], seen: DataFrame, max_tracked: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key was not seen, and the seen set ``k, n`` (n: arrival number of the poll), oldest dropped beyond ``max_tracked``."""
    now = seen.agg(F.coalesce(F.max("n"), F.lit(-1)).alias("last"))
    new = df.withColumn("_k", key_text(keys, df.schema)).join(seen.select(F.col("k").alias("_k")), "_k", "left_anti")
    grown = seen.select("k", "n").union(new.select("_k").distinct().crossJoin(F.broadcast(now)).select(F.col("_k").alias("k"), (F.col("last") + 1).alias("n")))
    if max_tracked is not None:
        grown = chunked_snapshot(grown, [("n", False), ("k", True)], max_tracked).where(F.col("row_index") < max_tracked).select("k", "n")
    return new.drop("_k"), grown


def initial_cursor(df: DataFrame, filters: list[Filter], strategy: str, column: str | None, keys: list[str], start: str = "now") -> DataFrame:
    """The first cursor under the source's filters: nothing for ``beginning``; for ``now`` the greatest value, or the keys seen.

    increment: ``cursor``. timestamp: ``cursor, k`` for the boundary's keys. snapshot: ``k``.
    """
    found = df.where(predicate(filters, df.schema))
    if start == "beginning":
        found = found.limit(0)
    if strategy == "snapshot":
        return found.select(key_text(keys, df.schema).alias("k"))
    top = found.agg(F.max(f"`{column}`").alias("cursor"))
    if strategy == "increment":
        return top
    edge = found.crossJoin(F.broadcast(top)).where(F.col(f"`{column}`") == F.col("cursor"))  # one row
    return edge.select("cursor", key_text(keys, df.schema).alias("k"))


def usable_cursor(stored: dict | None, strategy: str, column: str | None) -> dict | None:
    """A cursor of another strategy or column is discarded."""
    return stored if stored and stored.get("strategy") == strategy and stored.get("column") == column else None


def at_most(rows: DataFrame, column: str, key: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows in cursor order, but ties of the last value stay together with it, so none is lost.

    The last value is found from counts by ranges of the cursor, so no task
    holds ``limit`` rows, however many they are. ``key`` breaks ties and so never
    moves that value.
    """
    c = F.col(f"`{column}`")
    places = chunked_snapshot(rows.select(c.alias("_edge")).where(c.isNotNull()), [("_edge", True)], max(limit, 1))
    edge = places.where(F.col("row_index") < limit).agg(F.max("_edge").alias("_edge"))
    return rows.crossJoin(F.broadcast(edge)).where(c <= F.col("_edge")).drop("_edge")  # one row
