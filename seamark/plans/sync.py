"""Queries of writes, polls, verification and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicate import Filter
from ..functions.scratch import folder
from ..functions.shaping import Mask, Text
from ..operators import digests as dg
from ..operators import polls as po
from ..operators import verify as ve
from ..operators import writes as wr
from ..operators.buckets import BucketTable, compare_tables
from .registry import Tables, plan

COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def key():
    return F.col("o_orderkey")


def orders(t: Tables):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def target_copy(t: Tables):
    """Orders with planted differences: keys dropped, prices raised, keys beyond the source added."""
    o = orders(t)
    kept = o.where(key() % 101 != 0).withColumn("o_totalprice", F.when(key() % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.union(o.where(key() % 89 == 0).withColumn("o_orderkey", key() + 10_000_000))


_TARGET = f"""target as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 97 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice from orders where o_orderkey % 101 <> 0
union all select o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 89 = 0)"""


def rows_in(t: Tables):
    """Rows to write: every fourth order with a new price, and keys not in the target."""
    o = orders(t)
    return o.where(key() % 4 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)


_ROWS = "rows_in as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 4 = 0)"


@plan("w1_upsert", f"with {_TARGET}, {_ROWS} select * from rows_in union all select * from target where o_orderkey not in (select o_orderkey from rows_in)")
def w1(t: Tables):
    return wr.upsert(target_copy(t), rows_in(t), ["o_orderkey"])


@plan("w1_upsert_twice", f"with {_TARGET}, {_ROWS} select * from rows_in union all select * from target where o_orderkey not in (select o_orderkey from rows_in)")
def w1b(t: Tables):
    once = wr.upsert(target_copy(t), rows_in(t), ["o_orderkey"])
    return wr.upsert(once, rows_in(t), ["o_orderkey"])


@plan(
    "w2_sparse_upsert",
    f"""with {_TARGET}, {_ROWS} select r.o_orderkey, r.o_custkey, case when r.o_orderkey % 8 = 0 then t.o_orderstatus else r.o_orderstatus end o_orderstatus, r.o_totalprice
from rows_in r left join target t using (o_orderkey) union all select * from target where o_orderkey not in (select o_orderkey from rows_in)""",
)
def w2(t: Tables):
    r = rows_in(t).withColumns({"unchanged": F.when(key() % 8 == 0, F.array(F.lit("o_orderstatus"))), "o_orderstatus": F.when(key() % 8 != 0, F.col("o_orderstatus"))})
    return wr.upsert(target_copy(t), r, ["o_orderkey"], unchanged="unchanged")


@plan("w3_insert_absent", f"with {_TARGET} select * from target union all select o_orderkey, null, null, null from orders where o_orderkey % 101 = 0")
def w3(t: Tables):
    return wr.insert_absent(target_copy(t), orders(t).select("o_orderkey"), ["o_orderkey"])


@plan("w4_append", f"with {_TARGET}, {_ROWS} select * from target union all select * from rows_in")
def w4(t: Tables):
    return wr.append(target_copy(t), rows_in(t))


def ids(t: Tables):
    o = t("orders").where(key() % 5 == 0)
    return o.select(F.when(key() % 10 != 0, key()).alias("o_orderkey"))


@plan("w5_delete_by_key", f"with {_TARGET} select * from target where not (o_orderkey < 10000000 and o_orderkey % 10 = 5)")
def w5(t: Tables):
    return wr.delete_by_key(target_copy(t), ids(t), ["o_orderkey"])


@plan("w5_null_keys", "select count(*) filter (where o_orderkey % 10 = 5) good, count(*) filter (where o_orderkey % 10 = 0) bad from orders")
def w5b(t: Tables):
    good, bad = wr.split_ids(ids(t), ["o_orderkey"])
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@plan("w6_soft_delete", f"with {_TARGET} select o_orderkey, (o_orderkey < 10000000 and o_orderkey % 10 = 5 and o_orderkey % 4 <> 0) as gone from target union all select o_orderkey, false from orders where o_orderkey % 4 = 0 and o_orderkey % 101 = 0")
def w6(t: Tables):
    marked = wr.soft_delete(target_copy(t).withColumn("gone", F.lit(False)), ids(t), ["o_orderkey"], "gone")
    return wr.upsert(marked, rows_in(t), ["o_orderkey"], mark="gone").select("o_orderkey", "gone")


@plan("w7_ignore_deletes", "select o_orderkey, 'update' as op from orders where o_orderkey % 3 <> 0")
def w7(t: Tables):
    return wr.keep_ops(orders(t).select("o_orderkey", F.when(key() % 3 == 0, "delete").otherwise("update").alias("op")), "ignore")


@plan("w8_truncate", f"with {_TARGET} select 0::bigint as after_delete, count(*) as after_soft, 'a truncate is not mirrored: deletes are soft' as notice from target")
def w8(t: Tables):
    gone, _ = wr.truncate(target_copy(t))
    kept, notice = wr.truncate(target_copy(t), "soft")
    return gone.agg(F.count("*").alias("after_delete")).crossJoin(kept.agg(F.count("*").alias("after_soft"))).withColumn("notice", F.lit(notice))  # one row each


@plan("w10_versions", f"with {_TARGET}, {_ROWS} select * from rows_in union all select * from target where o_orderkey not in (select o_orderkey from rows_in)")
def w10(t: Tables):
    v = wr.VersionedTable(t.spark, folder(t.spark, "versions"))
    v.apply(lambda now: target_copy(t), 0)
    for _ in range(2):  # the second is a repeat and does nothing
        v.apply(lambda now: wr.upsert(now, rows_in(t), ["o_orderkey"]), 1)
    return v.read()


@plan(
    "w10_bucket_versions",
    f"""with {_TARGET}, {_ROWS}, up as (select * from rows_in union all select * from target where o_orderkey not in (select o_orderkey from rows_in))
select * from up where o_orderkey % 1000 <> 7""",
)
def w10b(t: Tables):
    """A copy in 64 buckets; an upsert, the same batch once more, and a delete, each a version of the buckets it touches."""
    v = BucketTable(t.spark, folder(t.spark, "buckets"), ["o_orderkey"])
    v.replace(target_copy(t), ("copy", 0))
    for _ in range(2):  # the second is a repeat and does nothing
        v.upsert(rows_in(t), batch=("feed", 1))
    v.delete(target_copy(t).where(key() % 1000 == 7).select("o_orderkey"), batch=("feed", 2))
    return v.read()


@plan(
    "w10_bucket_manifest",
    f"""with {_TARGET}, {_ROWS}, up as (select * from rows_in union all select * from target where o_orderkey not in (select o_orderkey from rows_in))
select count(*) n_rows, min('["' || o_orderkey || '"]') low_key, max('["' || o_orderkey || '"]') high_key, 3::bigint as versions from up""",
)
def w10c(t: Tables):
    """What the manifest of a version says, after a version of few buckets: row counts and key ranges of all of them."""
    v = BucketTable(t.spark, folder(t.spark, "buckets"), ["o_orderkey"])
    v.replace(target_copy(t))
    v.upsert(rows_in(t))
    v.upsert(rows_in(t).where(key() < 20))
    return v.manifest().agg(F.sum("n").alias("n_rows"), F.min("low_key").alias("low_key"), F.max("high_key").alias("high_key")).withColumn("versions", F.lit(len(v.numbers())).cast("long"))


@plan("w9_fan_out", "select o_orderkey, 'a' as target from orders where o_orderkey % 4 = 0 union all select o_orderkey, 'b' from orders where o_orderkey % 4 = 0")
def w9(t: Tables):
    spark = t.spark
    a, b, done = (wr.VersionedTable(spark, folder(spark, n)) for n in ("a", "b", "done"))
    batch = rows_in(t).select("o_orderkey")
    failed: list[int] = []

    def to_b(df, i):
        if not failed:
            failed.append(i)
            raise RuntimeError("the first try fails")
        b.write(df, i)

    def to_a(df, i):
        now = a.read()
        a.write(df if now is None else now.union(df), i)  # an append: a second one would show

    for _ in range(2):
        try:
            wr.fan_out(batch, 7, {"a": to_a, "b": to_b}, done)
        except RuntimeError:
            continue
    return a.read().withColumn("target", F.lit("a")).union(b.read().withColumn("target", F.lit("b")))


@plan("w9_fan_out_once", "select o_orderkey, 'a' as target from orders where o_orderkey % 4 = 0 union all select o_orderkey, 'b' from orders where o_orderkey % 4 = 0")
def w9b(t: Tables):
    """Two append targets, a batch that fails at the second, and two retries: the batch ids in the targets' own pointers keep every row single."""
    spark = t.spark
    a, b = (wr.VersionedTable(spark, folder(spark, n)) for n in ("a", "b"))
    batch = rows_in(t).select("o_orderkey")
    add = lambda now, more: more if now is None else now.union(more)
    tries: list[int] = []

    def fails_once(now, more):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("the first try fails")
        return add(now, more)

    for _ in range(3):
        try:
            wr.fan_out_once(batch, 7, {"a": (a, add), "b": (b, fails_once)})
        except RuntimeError:
            continue
    return a.read().withColumn("target", F.lit("a")).union(b.read().withColumn("target", F.lit("b")))


@plan("w11_ensure_target", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 as o_totalprice from orders where o_orderkey % 4 = 0")
def w11(t: Tables):
    r = rows_in(t)
    return wr.upsert(wr.ensure_target(t.spark, None, r), r, ["o_orderkey"])


@plan("w12_add_columns", "select n_nationkey, n_name, n_regionkey, null::varchar as n_comment from nation")
def w12(t: Tables):
    n = t("nation")
    wanted = n.withColumn("n_comment", F.lit("x")).withColumn("n_name", F.lit(1)).schema
    return wr.add_columns(n, wanted)


@plan("w13_skip_unchanged", f"with {_TARGET} select {COLS} from orders where o_orderkey % 101 = 0 or o_orderkey % 97 = 0")
def w13(t: Tables):
    return wr.skip_unchanged(target_copy(t), orders(t), ["o_orderkey"])


_COUNTS = f"""with {_TARGET} select count(*) filter (where o_orderkey % 101 = 0) inserted, count(*) filter (where o_orderkey % 97 = 0 and o_orderkey % 101 <> 0) updated,
count(*) filter (where o_orderkey % 97 <> 0 and o_orderkey % 101 <> 0) as same, (select count(*) from target where o_orderkey < 10000000 and o_orderkey % 10 = 5) as deleted from orders"""


@plan("w14_write_counts", _COUNTS)
def w14(t: Tables):
    return wr.write_counts(target_copy(t), orders(t), ids(t), ["o_orderkey"])


@plan("w14_observed_counts", _COUNTS)
def w14b(t: Tables):
    """The same counts, observed while a version of buckets is written and kept in it."""
    v = BucketTable(t.spark, folder(t.spark, "counted"), ["o_orderkey"])
    v.replace(target_copy(t))
    v.write(orders(t), ids(t))
    n = v.version().counts
    return t.spark.createDataFrame([(n["inserted"], n["updated"], n["same"], n["deleted"])], "inserted long, updated long, same long, deleted long")


@plan("i1_poll_increment", "select event_id, null::bigint as cursor from events where event_id > 6000 union all select null, greatest(max(event_id), 6000) from events")
def i1(t: Tables):
    rows, cursor = po.poll_increment(t("events"), "event_id", F.lit(6000).cast("long"))
    return rows.select("event_id", F.lit(None).cast("long").alias("cursor")).union(cursor.select(F.lit(None).cast("long"), "cursor"))


def hours(t: Tables):
    return t("events").select("event_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("at"))


@plan("i2_poll_timestamp", "select event_id, count(*) as times from events group by 1")
def i2(t: Tables):
    """Two polls with ties and a lookback: every row once, no matter how the time falls."""
    e = hours(t)
    none = t.spark.createDataFrame([], "k string, at timestamp_ntz")
    first, cursor, emitted = po.poll_timestamp(e.where("event_id < 5000"), "at", ["event_id"], F.lit(None).cast("timestamp_ntz"), 7200, none)
    at = F.lit(str(cursor.first()["cursor"])).cast("timestamp_ntz")  # one row
    second, _, _ = po.poll_timestamp(e, "at", ["event_id"], at, 7200, emitted)
    return first.union(second).groupBy("event_id").agg(F.count("*").alias("times"))


@plan("i2_restamped", "select event_id from events where event_id % 50 = 0")
def i2b(t: Tables):
    """Rows stamped again later are given again, others are not."""
    e = hours(t)
    none = t.spark.createDataFrame([], "k string, at timestamp_ntz")
    _, cursor, emitted = po.poll_timestamp(e, "at", ["event_id"], F.lit(None).cast("timestamp_ntz"), 3600, none)
    at = F.lit(str(cursor.first()["cursor"])).cast("timestamp_ntz")  # one row
    later = e.withColumn("at", F.when(F.col("event_id") % 50 == 0, at + F.expr("interval 1 hour")).otherwise(F.col("at")))
    return po.poll_timestamp(later, "at", ["event_id"], at, 3600, emitted)[0].select("event_id")


@plan("i3_poll_snapshot", "select event_id from events where event_id % 3 <> 0")
def i3(t: Tables):
    e = t("events").select("event_id")
    none = t.spark.createDataFrame([], "k string, n long")
    _, seen = po.poll_snapshot(e.where("event_id % 3 = 0"), ["event_id"], none)
    return po.poll_snapshot(e, ["event_id"], seen)[0]


@plan(
    "i4_initial_cursor",
    """select (select max(event_id) from events where event_type = 'click') by_id, (select count(*) from events where event_type = 'click') n_seen,
(select count(*) from events where event_type = 'click' and date_trunc('hour', ts) = (select max(date_trunc('hour', ts)) from events where event_type = 'click')) n_boundary, 0::bigint from_beginning""",
)
def i4(t: Tables):
    e = t("events").withColumn("at", F.date_trunc("HOUR", "ts"))
    f = [Filter("event_type", "eq", "click")]
    one = po.initial_cursor(e, f, "increment", "event_id", ["event_id"]).select(F.col("cursor").alias("by_id"))
    seen = po.initial_cursor(e, f, "snapshot", None, ["event_id"]).agg(F.count("*").alias("n_seen"))
    edge = po.initial_cursor(e, f, "timestamp", "at", ["event_id"]).agg(F.count("*").alias("n_boundary"))
    none = po.initial_cursor(e, f, "snapshot", None, ["event_id"], "beginning").agg(F.count("*").alias("from_beginning"))
    return one.crossJoin(seen).crossJoin(edge).crossJoin(none)  # one row each


@plan("i5_max_per_poll", "select event_id from events where date_trunc('hour', ts) <= (select max(h) from (select date_trunc('hour', ts) h from events order by 1, event_id limit 100))")
def i5(t: Tables):
    return po.at_most(hours(t), "at", ["event_id"], 100).select("event_id")


@plan(
    "r1_expected_rows",
    "select c_custkey id, '********' as c_name, lower(c_mktsegment) segment from customer",
)
def r1(t: Tables):
    return ve.expected_rows(t("customer"), [Mask("c_name", "redact"), Text("c_mktsegment", "lower")], "postgres", "mysql", {"c_custkey": "id", "c_name": "c_name", "c_mktsegment": "segment"})


@plan("r2_missing", "select o_orderkey from orders where o_orderkey % 101 = 0")
def r2(t: Tables):
    return ve.missing(orders(t), target_copy(t), ["o_orderkey"]).select("o_orderkey")


@plan("r3_different", "select '[\"' || o_orderkey || '\"]' as _k, 'o_totalprice' as \"column\" from orders where o_orderkey % 97 = 0 and o_orderkey % 101 <> 0")
def r3(t: Tables):
    return ve.compare(orders(t), target_copy(t), ["o_orderkey"]).where("class = 'different'").select("_k", F.explode("diff").alias("d")).select("_k", "d.column")


@plan("r4_extra", "select o_orderkey + 10000000 as o_orderkey from orders where o_orderkey % 89 = 0 and o_orderkey % 2 = 0")
def r4(t: Tables):
    marked = target_copy(t).withColumn("gone", key() % 2 == 1)
    c = ve.compare(orders(t), marked, ["o_orderkey"], mark="gone").where("class = 'extra'")
    return c.select(F.get_json_object("_k", "$[0]").cast("long").alias("o_orderkey"))


_CLASSES = f"""with {_TARGET}, j as (select o.o_orderkey a, t.o_orderkey b, o.o_totalprice <> t.o_totalprice or o.o_custkey <> t.o_custkey or o.o_orderstatus <> t.o_orderstatus d
from (select {COLS} from orders) o full outer join target t on o.o_orderkey = t.o_orderkey)"""
_REPORT = f"""{_CLASSES} select count(a) checked, count(*) filter (where b is null) missing, count(*) filter (where d) "different", count(*) filter (where a is null) extra,
count(*) filter (where a is null or b is null or d) = 0 in_sync from j"""


@plan("r5_verify", _REPORT)
def r5(t: Tables):
    return ve.report(ve.compare(orders(t), target_copy(t), ["o_orderkey"]))


@plan("r5_digest_tree", _REPORT)
def r5c(t: Tables):
    """The same report from digest trees: equal ranges of keys are not joined."""
    o, copy = orders(t), target_copy(t)
    columns = dg.compared_columns(o, copy, ["o_orderkey"])
    leaves = dg.tree(o, ["o_orderkey"], columns)
    return dg.report_by_digest(leaves, dg.compare_by_digest(o, copy, ["o_orderkey"], trees=(leaves, dg.tree(copy, ["o_orderkey"], columns))))


@plan(
    "r5_version_trees",
    """select '["' || o_orderkey || '"]' as _k, case when o_orderkey % 101 = 0 then 'missing' else 'different' end as class from orders where o_orderkey % 700 = 7 and (o_orderkey % 101 = 0 or o_orderkey % 97 = 0)""",
)
def r5d(t: Tables):
    """Versions of two tables by the trees beside them: the copy is in sync but for a few keys of one write."""
    source, copy = (BucketTable(t.spark, folder(t.spark, n), ["o_orderkey"]) for n in ("source", "copy"))
    source.replace(orders(t))
    copy.replace(orders(t))
    late = orders(t).where((key() % 700 == 7) & ((key() % 101 == 0) | (key() % 97 == 0)))
    copy.upsert(late.where(key() % 101 != 0).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    copy.delete(late.where(key() % 101 == 0).select("o_orderkey"))
    return compare_tables(source, copy).select("_k", "class")


@plan(
    "r5_samples",
    f"""{_CLASSES}, c as (select '["' || coalesce(a, b) || '"]' as _k, case when b is null then 'missing' when a is null then 'extra' when d then 'different' else 'same' end as class from j)
select _k, class from (select *, row_number() over (partition by class order by _k) r from c where class <> 'same') where r <= 25""",
)
def r5b(t: Tables):
    return ve.samples(ve.compare(orders(t), target_copy(t), ["o_orderkey"])).select("_k", "class")


@plan("r6_second_look", "select '[\"' || o_orderkey || '\"]' as _k from orders where o_orderkey % 101 = 0")
def r6(t: Tables):
    first = ve.compare(orders(t), target_copy(t), ["o_orderkey"])
    later = orders(t).where(key() % 101 != 0)  # prices were caught up and extras removed meanwhile
    return ve.second_look(first, orders(t), later, ["o_orderkey"]).select("_k")


@plan("r6_second_look_by_ranges", "select '[\"' || o_orderkey || '\"]' as _k from orders where o_orderkey % 101 = 0")
def r6b(t: Tables):
    """The second look through the ranges that differed at first: only they are read again."""
    o, copy, later = orders(t), target_copy(t), orders(t).where(key() % 101 != 0)
    columns = dg.compared_columns(o, copy, ["o_orderkey"])
    ranges = dg.descend(dg.tree(o, ["o_orderkey"], columns), dg.tree(copy, ["o_orderkey"], columns))
    return dg.compare_ranges(o, later, ranges, ["o_orderkey"]).where("class <> 'same'").select("_k")


@plan("r7_reconcile", f"with {_TARGET} select {COLS} from orders union all select * from target where o_orderkey >= 10000000")
def r7(t: Tables):
    c = ve.compare(orders(t), target_copy(t), ["o_orderkey"])
    return ve.reconcile(target_copy(t), orders(t), c, ["o_orderkey"])


@plan("r8_reconcile_extra", f"select {COLS} from orders")
def r8(t: Tables):
    c = ve.compare(orders(t), target_copy(t), ["o_orderkey"])
    return ve.reconcile(target_copy(t), orders(t), c, ["o_orderkey"], delete_extra=True)


@plan("r8_in_sync_after", "select count(*) checked, 0::bigint missing, 0::bigint \"different\", 0::bigint extra, true in_sync from orders")
def r8b(t: Tables):
    """Copy then verify reports nothing."""
    c = ve.compare(orders(t), target_copy(t), ["o_orderkey"])
    fixed = ve.reconcile(target_copy(t), orders(t), c, ["o_orderkey"], delete_extra=True)
    return ve.report(ve.compare(orders(t), fixed, ["o_orderkey"]))
