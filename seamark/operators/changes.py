"""Change logs: normalising, ordering and folding changes into a target.

A change row has ``op`` (insert, update, delete, truncate), the row's columns,
``pos`` (an orderable struct) and, optionally, ``unchanged``: names of columns
the change did not carry, which is different from NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, key_text
from ..functions.predicate import Filter, change_predicate
from ..sources.tables import chunked_snapshot

EMPTY = "array<string>"


def unchanged_of(df: DataFrame) -> Column:
    return F.coalesce(F.col("unchanged"), F.array().cast(EMPTY)) if "unchanged" in df.columns else F.array().cast(EMPTY)


def normalize_pg(changes: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Logical-decoding messages as JSON (``tag``, ``new``, ``old``, ``key``, ``lsn``): ``op, columns, unchanged, pos``.

    A delete takes the old image, else the key. A column absent from the new
    image was not sent, so it is unchanged. Other tags are left out.
    """
    m = changes.select(F.from_json("value", "tag string, new map<string,string>, old map<string,string>, key map<string,string>, lsn string").alias("m")).select("m.*")
    m = m.where(F.col("tag").isin("insert", "update", "delete", "truncate"))
    image = F.when(F.col("tag") == "delete", F.coalesce("old", "key")).otherwise(F.col("new"))
    m = m.withColumn("image", image)
    names = F.array(*map(F.lit, columns))
    absent = F.when(F.col("tag") == "update", F.array_except(names, F.map_keys("image"))).otherwise(F.array().cast(EMPTY))
    return m.select(F.col("tag").alias("op"), *[F.col("image")[c].cast(kind if c == columns[0] else "string").alias(c) for c in columns], absent.alias("unchanged"), pg_position(F.col("lsn")).alias("pos"))


def normalize_mysql(events: DataFrame, columns: list[str], key_kind: str) -> DataFrame:
    """Row events (``type`` write, update or delete; ``rows`` of values or before/after pairs): a change for each row, in place."""
    shape = "type string, file string, at long, rows array<struct<before:map<string,string>,after:map<string,string>,values:map<string,string>>>"
    e = events.select(F.from_json("value", shape).alias("e")).select("e.*").where(F.col("type").isin("write", "update", "delete"))
    e = e.select("type", "file", "at", F.posexplode("rows").alias("row", "r"))
    image = F.coalesce("r.after", "r.values", "r.before")
    op = F.when(F.col("type") == "write", "insert").otherwise(F.col("type"))
    pos = F.struct(mysql_file(F.col("file")).alias("file"), F.col("at"), F.col("row").cast("long").alias("row"))
    return e.select(op.alias("op"), *[image[c].cast(key_kind if c == columns[0] else "string").alias(c) for c in columns], pos.alias("pos"))


def normalize_document(events: DataFrame) -> DataFrame:
    """Change-stream events: insert, update and replace (an update); an update whose document is gone is skipped; a delete takes its pre-image, else its key."""
    e = events.select(F.from_json("value", "operationType string, fullDocument string, fullDocumentBeforeChange string, documentKey string").alias("e")).select("e.*")
    op = F.when(F.col("operationType").isin("update", "replace"), "update").otherwise(F.col("operationType"))
    doc = F.when(op == "delete", F.coalesce("fullDocumentBeforeChange", "documentKey")).otherwise(F.col("fullDocument"))
    return e.select(op.alias("op"), F.get_json_object("documentKey", "$._id").alias("_id"), doc.alias("doc")).where(F.col("op").isin("insert", "update", "delete") & F.col("doc").isNotNull())


#: Keyspace events that remove a key.
REMOVED = ("del", "unlink", "expired", "evicted")


def normalize_keyspace(events: DataFrame, event: str = "event") -> DataFrame:
    return events.withColumn("op", F.when(F.col(event).isin(*REMOVED), "delete").otherwise("update"))


def pg_position(lsn: Column) -> Column:
    """``hi/lo`` hexadecimal, or ``commit#lsn`` of these: a struct in log order."""

    def number(x: Column) -> Column:
        hi, lo = F.substring_index(x, "/", 1), F.substring_index(x, "/", -1)
        return F.conv(hi, 16, 10).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + F.conv(lo, 16, 10).cast("decimal(20,0)")

    two = F.contains(lsn, F.lit("#"))
    first = F.when(two, F.substring_index(lsn, "#", 1)).otherwise(lsn)
    return F.struct(number(first).cast("decimal(20,0)").alias("commit"), number(F.substring_index(lsn, "#", -1)).cast("decimal(20,0)").alias("lsn"))


def mysql_file(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).cast("long")


def mysql_position(text: Column) -> Column:
    """``file:pos[:row]``: a struct in log order; a form without a row is row 0."""
    parts = F.split(text, ":")
    return F.struct(mysql_file(parts[0]).alias("file"), parts[1].cast("long").alias("at"), F.coalesce(F.get(parts, F.lit(2)).cast("long"), F.lit(0)).alias("row"))


def row_moves(changes: DataFrame, keys: list[str], before: str = "before") -> DataFrame:
    """An update that changes its key becomes a delete of the old key and an update flagged ``key_changed``.

    ``before`` is a struct with the key columns before the change (NULL when
    unknown). Keys are compared by kind.
    """
    moved = F.col(before).isNotNull() & (F.col("op") == "update")
    differs = F.lit(False)
    for k in keys:
        t = changes.schema[k].dataType
        differs = differs | ~canonical(F.col(k), t).eqNullSafe(canonical(F.col(f"{before}.{k}"), t))
    moved = moved & differs
    rest = [c for c in changes.columns if c not in (*keys, "op", before)]
    old = F.struct(F.lit("delete").alias("op"), F.lit(False).alias("key_changed"), F.lit(0).alias("step"), *[F.col(f"{before}.{k}").alias(k) for k in keys])
    new = F.struct(F.col("op"), moved.alias("key_changed"), F.lit(1).alias("step"), *[F.col(k) for k in keys])
    return changes.withColumn("_x", F.explode(F.when(moved, F.array(old, new)).otherwise(F.array(new)))).select("_x.*", *rest)


def complete_rows(changes: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Unchanged columns filled from the source's current row; where the row is gone they stay unchanged."""
    c = changes.withColumn("_k", key_text(keys, changes.schema))
    s = source.withColumn("_k", key_text(keys, source.schema)).withColumn("_found", F.lit(True))
    j = c.alias("c").join(s.alias("s"), "_k", "left")
    fill = F.col("s._found").isNotNull()
    carried = F.coalesce(F.col("c.unchanged"), F.array().cast(EMPTY))
    out = []
    for name in changes.columns:
        if name == "unchanged":
            out.append(F.when(fill, F.array().cast(EMPTY)).otherwise(carried).alias(name))
        elif name in source.columns and name not in keys:
            out.append(F.when(fill & F.array_contains(carried, name), F.col(f"s.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            out.append(F.col(f"c.{name}").alias(name))
    return j.select(*out)


def drop_replays(changes: DataFrame, watermark: Column) -> DataFrame:
    """Only changes after the last processed position."""
    return changes.where(F.col("pos") > watermark)


def last_truncate(changes: DataFrame) -> DataFrame:
    """One row: ``_cleared``, the last truncate's position, NULL if there is none."""
    return changes.where("op = 'truncate'").agg(F.max("pos").alias("_cleared"))


def fold(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The net effect for each key: ``_k``, last ``op``, ``last_pos``, whether the key was ``deleted``, and each
    column's last carried value (``c``) with ``c__set`` (was it carried since the key's last delete or truncate?).

    One aggregate over the log: a delete touches every column and resets it, so
    a column's last touch tells both. A hot key is fine: all of it is partial.
    """
    c = changes.where("op <> 'truncate'").withColumn("_k", key_text(keys, changes.schema))
    c = c.crossJoin(F.broadcast(last_truncate(changes))).where(F.col("_cleared").isNull() | (F.col("pos") > F.col("_cleared")))  # one row
    gone = F.col("op") == "delete"
    return c.groupBy("_k").agg(F.max_by("op", "pos").alias("op"), F.max("pos").alias("last_pos"), F.max(gone).alias("deleted"), *_touches(changes, columns, gone)).select("_k", "op", "last_pos", "deleted", *_touched(columns))


def _touches(changes: DataFrame, columns: list[str], resets: Column) -> list[Column]:
    """For each column its last touch: carried by a change, or reset by one."""
    missing = unchanged_of(changes)
    out = []
    for name in columns:
        touched = resets | ((F.col("op") != "delete") & ~F.array_contains(missing, name))
        out.append(F.max_by(F.when(touched, F.struct(resets.alias("reset"), F.col(name).alias("v"))), F.when(touched, F.col("pos"))).alias(f"{name}__touch"))
    return out


def _touched(columns: list[str]) -> list[Column]:
    out = []
    for name in columns:
        touch = F.col(f"{name}__touch")
        out += [touch["v"].alias(name), (touch.isNotNull() & ~F.coalesce(touch["reset"], F.lit(False))).alias(f"{name}__set")]
    return out


def latest_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key, whole: later changes of a key win."""
    k = key_text(keys, changes.schema)
    return changes.groupBy(k.alias("_k")).agg(F.max_by(F.struct(*changes.columns), "pos").alias("c")).select("c.*")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], policy: str = "delete", mark: str | None = None, at: str | None = None) -> DataFrame:
    """The target after an ordered log, in one rewrite that equals applying the changes one by one.

    A truncate is a barrier: only what follows it counts, and old rows go.
    A delete resets its key; later carried columns start from NULL. Policies:
    ``delete``; ``soft`` marks rows in ``mark`` (a time ``at``, or true), and an
    upsert clears the mark; ``ignore`` leaves deletes and truncates out.
    """
    if policy != "delete":
        changes = changes.where("op <> 'truncate'")
    if policy == "ignore":
        changes = changes.where("op <> 'delete'")
    columns = [c for c in target.columns if c in changes.columns]
    if policy == "soft":
        return _apply_soft(target, changes, keys, columns, mark, at)
    f = fold(changes, keys, columns)
    t = target.withColumn("_k", key_text(keys, target.schema)).withColumn("_old", F.lit(True))
    if policy == "delete":
        t = t.crossJoin(F.broadcast(last_truncate(changes))).where("_cleared is null").drop("_cleared")  # one row
    j = t.alias("t").join(f.alias("f"), "_k", "full_outer")
    keep = F.col("f.op").isNull()
    survives = F.col("t._old").isNotNull() & ~F.coalesce(F.col("f.deleted"), F.lit(False))
    j = j.where(keep | (F.col("f.op") != "delete"))
    out = []
    for name in target.columns:
        if name in columns:
            old = F.when(survives, F.col(f"t.{name}"))
            out.append(F.when(F.coalesce(F.col(f"f.{name}__set"), F.lit(False)), F.col(f"f.{name}").cast(target.schema[name].dataType)).otherwise(old).alias(name))
        else:
            out.append(F.when(survives, F.col(f"t.{name}")).alias(name))
    return j.select(*out)


def _apply_soft(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], mark: str, at: str | None) -> DataFrame:
    """Soft deletes keep a row's values: a delete marks it, and does not reset its columns. A key never upserted is not made."""
    c = changes.withColumn("_k", key_text(keys, changes.schema))
    f = c.groupBy("_k").agg(F.max_by("op", "pos").alias("op"), F.max(F.col("op") != "delete").alias("upserted"), *_touches(changes, columns, F.lit(False)))
    f = f.select("_k", "op", "upserted", *_touched(columns))
    t = target.withColumn("_k", key_text(keys, target.schema)).withColumn("_old", F.lit(True))
    j = t.alias("t").join(f.alias("f"), "_k", "full_outer").where(F.col("t._old").isNotNull() | F.col("f.upserted"))
    kind = target.schema[mark].dataType.simpleString()
    marked = (F.lit(at) if at is not None else F.lit(True)).cast(kind)
    clear = F.lit(False).cast(kind) if kind == "boolean" else F.lit(None).cast(kind)
    out = []
    for name in target.columns:
        if name == mark:
            out.append(F.when(F.col("f.op") == "delete", marked).when(F.col("f.op").isNotNull(), clear).otherwise(F.col(f"t.{name}")).alias(name))
        elif name in columns:
            out.append(F.when(F.coalesce(F.col(f"f.{name}__set"), F.lit(False)), F.col(f"f.{name}").cast(target.schema[name].dataType)).otherwise(F.col(f"t.{name}")).alias(name))
        else:
            out.append(F.col(f"t.{name}").alias(name))
    return j.select(*out)


#: Rows of a log that one window partition holds when places in it are summed.
STRETCH = 65_536


def _running(numbered: DataFrame, flag: str, out: str) -> DataFrame:
    """``numbered`` with ``out``: how many rows up to this one have ``flag``, by stretches and one total for each."""
    inner = Window.partitionBy("sequence").orderBy("row_index")
    before = Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    totals = numbered.groupBy("sequence").agg(F.count_if(flag).alias("_n"))
    totals = totals.select("sequence", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(totals, "sequence").withColumn(out, F.col("_before") + F.count_if(flag).over(inner)).drop("_before")


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places where a run must end within rows of one op: a key came back after the last cut. Rows come in order, state is two numbers."""
    segment, start = None, -1
    for b in batches:
        out = []
        for s, i, again in zip(b["segment"], b["row_index"], b["again"], strict=True):
            if s != segment:
                segment, start = s, -1
            if again >= start:
                start = i
                out.append(i)
        yield pd.DataFrame({"row_index": pd.Series(out, dtype="int64"), "cut": True})


def delivery_runs(changes: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """``changes`` with ``run``: an ordered log cut into runs of one op in which no key repeats (for append targets).

    The log is numbered by ranges. A run ends where the op changes, or where a
    key came back since the run's start; only rows whose key came back under one
    op are walked in order, as a stream of two numbers each, so no task holds a
    table's log. Needed for append targets only: keyed targets use ``apply_changes``.
    """
    rows = changes.select(F.col(table).alias("of"), "pos", "op", key_text(keys, changes.schema).alias("k"), F.struct(*changes.columns).alias("row"))
    whole = chunked_snapshot(rows, [("of", True), ("pos", True), ("k", True)], STRETCH)
    log = whole.select("of", "op", "k", "row_index", "sequence")
    kind = F.struct("of", "op")
    edges = log.groupBy((F.col("sequence") + 1).alias("sequence")).agg(F.max_by(kind, "row_index").alias("edge"))
    last = F.coalesce(F.lag(kind).over(Window.partitionBy("sequence").orderBy("row_index")), F.col("edge"))
    log = log.join(edges, "sequence", "left").withColumn("new", ~kind.eqNullSafe(last)).drop("edge")
    log = _running(log, "new", "segment")
    again = F.lag("row_index").over(Window.partitionBy("segment", "k").orderBy("row_index"))
    back = log.select("segment", "row_index", again.alias("again")).where("again is not null")
    back = back.repartition("segment").sortWithinPartitions("segment", "row_index")
    cuts = back.mapInPandas(_cuts, "row_index long, cut boolean")
    log = log.join(cuts, "row_index", "left").withColumn("starts", F.col("new") | F.coalesce("cut", F.lit(False)))
    log = _running(log.select("of", "row_index", "sequence", "starts"), "starts", "nth")
    first = log.groupBy("of").agg(F.min("nth").alias("first"))
    runs = log.alias("l").join(first.alias("f"), F.col("l.of").eqNullSafe(F.col("f.of"))).select("row_index", (F.col("nth") - F.col("first")).alias("run"))
    return whole.select("row_index", "row").join(runs, "row_index").select("row.*", "run")


def filter_ops(changes: DataFrame, ops: list[str]) -> tuple[DataFrame, DataFrame]:
    """Changes whose op is enabled, and a notice for each truncate that is not mirrored."""
    notices = changes.where((F.col("op") == "truncate") & F.lit("truncate" not in ops)).select(F.lit("a truncate was not mirrored").alias("notice"), "pos")
    return changes.where(F.col("op").isin(*ops)), notices


def stream_filter(changes: DataFrame, filters: list[Filter]) -> DataFrame:
    """Source filters on every change; works on batches and streams. What is filtered out still advances the position."""
    absent = F.col("absent") if "absent" in changes.columns else F.array().cast(EMPTY)
    return changes.where(change_predicate(filters, changes.schema, absent, F.col("op") == "delete", unchanged_of(changes)))


def snapshot_then_follow(snapshot: DataFrame, changes: DataFrame, start: Column, keys: list[str]) -> DataFrame:
    """A copy taken at ``start``, then the changes after it; what both hold is absorbed by the upsert."""
    return apply_changes(snapshot, changes.where(F.col("pos") > start), keys)


def column_signature(rows: DataFrame, fields: str) -> DataFrame:
    """``signature, n``: sets of columns that rows (a map column) carry; more than the stored one triggers a drift check."""
    return rows.groupBy(F.array_join(F.array_sort(F.map_keys(fields)), ",").alias("signature")).agg(F.count("*").alias("n"))
