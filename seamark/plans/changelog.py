"""Queries of change streams: normalising, folding, following, loop prevention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicate import Filter
from ..functions.scratch import folder
from ..operators import changes as ch
from ..operators.buckets import BucketTable
from ..operators.writes import VersionedTable
from ..sources.tables import chunked_snapshot
from ..streaming import echo
from ..streaming import follow as fo
from ..streaming.spool import Spool
from .registry import Tables, plan
from .sync import COLS, key, orders

def none():
    return F.array().cast("array<string>")


def change_log(t: Tables, truncate: bool = False):
    """Two rounds of changes on orders, in log order: deletes, updates, inserts, with columns not carried."""
    o = orders(t)
    op = F.when(key() % 10 == 0, "delete").when(key() % 10 <= 3, "update").otherwise("insert")
    carried = F.when(key() % 5 == 0, F.array(F.lit("o_orderstatus"))).otherwise(none())
    one = o.select(op.alias("op"), "o_orderkey", "o_custkey", F.when(key() % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), carried.alias("unchanged"), F.struct(F.lit(1).alias("round"), key().alias("at")).alias("pos"))
    two = o.where(key() % 4 == 0).select(F.when(key() % 8 == 0, "update").otherwise("delete").alias("op"), "o_orderkey", "o_custkey", F.lit(None).cast("string").alias("o_orderstatus"), (F.col("o_totalprice") + 2).alias("o_totalprice"), F.array(F.lit("o_orderstatus"), F.lit("o_custkey")).alias("unchanged"), F.struct(F.lit(2), key()))
    log = one.union(two)
    if truncate:
        row = t.spark.sql("select 'truncate' op, cast(null as bigint) o_orderkey, cast(null as bigint) o_custkey, cast(null as string) o_orderstatus, cast(null as double) o_totalprice, cast(array() as array<string>) unchanged, struct(1 as round, 500L as at) as pos")
        log = log.union(row)
    return log


def base(t: Tables):
    """The target before: the orders whose key is no multiple of three."""
    return orders(t).where(key() % 3 != 0)


# first round: rows of keys % 10 = 0 go, others are set (their status only where the key is no multiple of 5)
_FOLD = """with b as (select o_orderkey k, o_custkey c, o_orderstatus s, o_totalprice p from orders where o_orderkey % 3 <> 0),
one as (select o.o_orderkey k, o.o_custkey c, case when o.o_orderkey % 5 = 0 then b.s else o.o_orderstatus end s, o.o_totalprice + 1 p from orders o left join b on b.k = o.o_orderkey where o.o_orderkey % 10 <> 0),
two as (select o_orderkey k, o_totalprice + 2 p, o_orderkey % 8 = 0 up from orders where o_orderkey % 4 = 0)
select coalesce(one.k, two.k) o_orderkey, one.c o_custkey, one.s o_orderstatus, coalesce(two.p, one.p) o_totalprice from one full outer join two on one.k = two.k where two.k is null or two.up"""


@plan("c10_apply_changes", _FOLD)
def c10(t: Tables):
    return ch.apply_changes(base(t), change_log(t), ["o_orderkey"])


@plan(
    "c10_truncate",
    """with one as (select o_orderkey k, o_custkey c, case when o_orderkey % 5 = 0 then null else o_orderstatus end s, o_totalprice + 1 p from orders where o_orderkey % 10 <> 0 and o_orderkey > 500),
two as (select o_orderkey k, o_totalprice + 2 p, o_orderkey % 8 = 0 up from orders where o_orderkey % 4 = 0)
select coalesce(one.k, two.k) o_orderkey, one.c o_custkey, one.s o_orderstatus, coalesce(two.p, one.p) o_totalprice from one full outer join two on one.k = two.k where two.k is null or two.up""",
)
def c10b(t: Tables):
    return ch.apply_changes(base(t), change_log(t, True), ["o_orderkey"])


@plan("c10_ignore", "select count(*) n, count(*) filter (where o_orderkey % 10 = 0) kept from orders where not (o_orderkey % 3 = 0 and o_orderkey % 10 = 0 and o_orderkey % 8 <> 0)")
def c10c(t: Tables):
    out = ch.apply_changes(base(t), change_log(t), ["o_orderkey"], "ignore")
    return out.agg(F.count("*").alias("n"), F.count_if(key() % 10 == 0).alias("kept"))


@plan(
    "c10_soft",
    """select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey % 8 <> 0 else o_orderkey % 10 = 0 end gone from orders
where o_orderkey % 3 <> 0 or o_orderkey % 10 <> 0 or o_orderkey % 8 = 0""",
)
def c10d(t: Tables):
    target = base(t).withColumn("gone", F.lit(False))
    return ch.apply_changes(target, change_log(t), ["o_orderkey"], "soft", mark="gone").select("o_orderkey", "gone")


@plan("c1_normalize_pg", "select case o_orderkey % 3 when 0 then 'insert' when 1 then 'update' else 'delete' end op, o_orderkey as id, case when o_orderkey % 3 = 0 then o_orderstatus end as status, case when o_orderkey % 3 = 1 then ['status'] else []::varchar[] end as unchanged, o_orderkey as lsn from orders")
def c1(t: Tables):
    k = key().cast("string")
    tag = F.when(key() % 3 == 0, "insert").when(key() % 3 == 1, "update").otherwise("delete")
    image = F.when(key() % 3 == 0, F.create_map(F.lit("id"), k, F.lit("status"), F.col("o_orderstatus"))).when(key() % 3 == 1, F.create_map(F.lit("id"), k))
    image_key = F.when(key() % 3 == 2, F.create_map(F.lit("id"), k))
    value = F.to_json(F.struct(tag.alias("tag"), image.alias("new"), image_key.alias("key"), F.concat(F.lit("0/"), F.hex(key())).alias("lsn")))
    out = ch.normalize_pg(t("orders").select(value.alias("value")), ["id", "status"], "bigint")
    return out.select("op", "id", "status", "unchanged", F.col("pos.lsn").cast("long").alias("lsn"))


@plan("c2_normalize_mysql", "select 'insert' as op, o_orderkey as id, o_orderstatus as status, 7::bigint as file, o_orderkey * 10 as at, 0::bigint as row from orders union all select 'update', o_orderkey, 'Z', 7, o_orderkey * 10 + 1, 0 from orders union all select 'update', o_orderkey + 1000000, 'Z', 7, o_orderkey * 10 + 1, 1 from orders")
def c2(t: Tables):
    k = key().cast("string")
    shape = "map<string,string>"
    none = F.lit(None).cast(shape)
    row = lambda before, after, values: F.struct(before.alias("before"), after.alias("after"), values.alias("values"))
    z = lambda key: F.create_map(F.lit("id"), key, F.lit("status"), F.lit("Z"))
    old = F.create_map(F.lit("id"), k, F.lit("status"), F.col("o_orderstatus"))
    event = lambda kind, at, rows: F.to_json(F.struct(F.lit(kind).alias("type"), F.lit("binlog.000007").alias("file"), at.alias("at"), rows.alias("rows")))
    o = t("orders")
    writes = o.select(event("write", key() * 10, F.array(row(none, none, old))).alias("value"))
    updates = o.select(event("update", key() * 10 + 1, F.array(row(old, z(k), none), row(old, z((key() + 1000000).cast("string")), none))).alias("value"))
    out = ch.normalize_mysql(writes.union(updates), ["id", "status"], "bigint")
    return out.select("op", "id", "status", "pos.file", "pos.at", "pos.row")


@plan("c3_normalize_document", "select case event_id % 4 when 0 then 'insert' when 1 then 'update' when 3 then 'delete' end op, event_id::varchar as _id from events where event_id % 4 <> 2")
def c3(t: Tables):
    e = F.col("event_id")
    key = F.to_json(F.struct(e.alias("_id")))
    kind = F.when(e % 4 == 0, "insert").when(e % 4 == 1, "replace").when(e % 4 == 2, "update").otherwise("delete")
    doc = F.when(e % 4 < 2, F.col("props"))
    value = F.to_json(F.struct(kind.alias("operationType"), doc.alias("fullDocument"), key.alias("documentKey")))
    return ch.normalize_document(t("events").select(value.alias("value"))).select("op", "_id")


@plan("c4_normalize_keyspace", "select event_id, case when event_type in ('error') then 'delete' else 'update' end op from events")
def c4(t: Tables):
    e = t("events").withColumn("event", F.when(F.col("event_type") == "error", "expired").otherwise("hset"))
    return ch.normalize_keyspace(e).select("event_id", "op")


@plan("c5_position_order", "select o_orderkey, row_number() over (order by o_orderkey % 7, o_orderkey * 100003) r, row_number() over (order by o_orderkey % 12, o_orderkey) m from orders")
def c5(t: Tables):
    """Ranks by parsed positions: hexadecimal and file numbers sort by value, not as text."""
    lsn = lambda x: F.concat(F.lit("0/"), F.hex(x))
    pg = ch.pg_position(F.concat(lsn(key() % 7), F.lit("#"), lsn(key() * 100003)))
    my = ch.mysql_position(F.concat(F.lit("bin."), (key() % 12).cast("string"), F.lit(":"), key().cast("string")))
    o = t("orders").select("o_orderkey", pg.alias("pg"), my.alias("my"))
    # ranks over all rows, by ranges
    r = chunked_snapshot(o.select("o_orderkey", "pg"), [("pg", True)], 1000).select("o_orderkey", (F.col("row_index") + 1).alias("r"))
    m = chunked_snapshot(o.select("o_orderkey", "my"), [("my", True)], 1000).select("o_orderkey", (F.col("row_index") + 1).alias("m"))
    return r.join(m, "o_orderkey")


@plan(
    "c6_row_moves",
    """select o_orderkey, 'update' as op, o_orderkey % 6 = 0 as key_changed from orders
union all select o_orderkey + 5000000, 'delete', false from orders where o_orderkey % 6 = 0""",
)
def c6(t: Tables):
    before = F.when(key() % 2 == 0, F.struct(F.when(key() % 6 == 0, key() + 5_000_000).otherwise(key()).alias("o_orderkey")))
    log = t("orders").select(F.lit("update").alias("op"), "o_orderkey", "o_totalprice", before.alias("before"))
    return ch.row_moves(log, ["o_orderkey"]).select("o_orderkey", "op", "key_changed")


@plan("c7_complete_rows", "select o_orderkey, case when o_orderkey % 5 = 0 and o_orderkey % 3 = 0 then null else o_orderstatus end as o_orderstatus, o_orderkey % 5 = 0 and o_orderkey % 3 = 0 as still_unchanged from orders")
def c7(t: Tables):
    log = change_log(t).where("pos.round = 1")
    out = ch.complete_rows(log, base(t), ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus", (F.size("unchanged") > 0).alias("still_unchanged"))


@plan("c8_drop_replays", "select o_orderkey, 1 as round from orders where o_orderkey > 9000 union all select o_orderkey, 2 from orders where o_orderkey % 4 = 0")
def c8(t: Tables):
    return ch.drop_replays(change_log(t), F.struct(F.lit(1).alias("round"), F.lit(9000).cast("long").alias("at"))).select("o_orderkey", "pos.round")


@plan("c9_latest_per_key", "select o_orderkey, case when o_orderkey % 4 = 0 then 2 else 1 end as round, case when o_orderkey % 8 = 0 then 'update' when o_orderkey % 4 = 0 then 'delete' when o_orderkey % 10 = 0 then 'delete' when o_orderkey % 10 <= 3 then 'update' else 'insert' end op from orders")
def c9(t: Tables):
    return ch.latest_per_key(change_log(t), ["o_orderkey"]).select("o_orderkey", "pos.round", "op")


@plan("c11_delivery_runs", "with s as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) before from conversations) select conv_id, turn, sum(case when role is distinct from before then 1 else 0 end) over (partition by conv_id order by turn)::bigint - 1 as run from s")
def c11(t: Tables):
    """Turns as a log: the role as op, the turn as key, so that a run ends where the role changes."""
    c = t("conversations").select("conv_id", F.col("role").alias("op"), "turn", F.struct("turn").alias("pos"))
    return ch.delivery_runs(c, "conv_id", ["turn"]).select("conv_id", "turn", "run")


@plan("c12_filter_ops", "select (select count(*) from orders where o_orderkey % 10 <> 0) + (select count(*) from orders where o_orderkey % 8 = 0) changes, 1::bigint notices")
def c12(t: Tables):
    kept, notices = ch.filter_ops(change_log(t, True), ["insert", "update"])
    return kept.agg(F.count("*").alias("changes")).crossJoin(notices.agg(F.count("*").alias("notices")))  # one row each


@plan("c13_stream_filter", "select o_orderkey from orders where o_orderkey % 5 = 0 or o_orderstatus = 'F'")
def c13(t: Tables):
    log = change_log(t).where("pos.round = 1")
    return ch.stream_filter(log, [Filter("o_orderstatus", "eq", "F")]).select("o_orderkey")


@plan("c14_snapshot_then_follow", _FOLD.replace("from orders o left join", "from (select * from orders where o_orderkey > 3000) o left join").replace("full outer join two on one.k = two.k where two.k is null or two.up", "full outer join two on one.k = two.k where two.k is null or two.up") + """
union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where 1 = 0""")
def c14(t: Tables):
    snapshot = base(t).where(key() > 3000)
    return ch.snapshot_then_follow(snapshot, change_log(t), F.struct(F.lit(1).alias("round"), F.lit(3000).cast("long").alias("at")), ["o_orderkey"])


@plan("c15_follow", _FOLD)
def c15(t: Tables):
    """Two micro-batches through a file stream, the query stopped and started again between them."""
    spark = t.spark
    landing, check, out = (folder(spark, n) for n in ("landing", "check", "target"))
    log = change_log(t)
    target = VersionedTable(spark, out)
    target.write(base(t), -1)
    spec = fo.FollowSpec(["o_orderkey"], COLS.split(", "))
    for r in (1, 2):
        log.where(F.col("pos.round") == r).write.mode("append").parquet(landing)
        fo.follow(fo.read_changes(spark, landing, log.schema), target, spec, check).awaitTermination()
    return target.read()


@plan("c16_landing_depth", "select count(*) filter (where o_orderkey > 7000) + count(*) filter (where o_orderkey % 4 = 0) as depth from orders")
def c16(t: Tables):
    spark = t.spark
    source, landing, check = (folder(spark, n) for n in ("source", "landed", "check"))
    log = change_log(t)
    log.write.parquet(source)
    fo.land(fo.read_changes(spark, source, log.schema), landing, check).awaitTermination()
    delivered = spark.range(1).select(F.struct(F.lit(1).alias("round"), F.lit(7000).cast("long").alias("at")).alias("pos"))
    return fo.depth(spark.read.schema(log.schema).parquet(landing), delivered)


@plan("c16_spool", _FOLD)
def c16b(t: Tables):
    """Changes in files, through a spool that holds half of them, to buckets: the stream waits for room, and the delivery under way dies between the target's write and the index, then comes again."""
    spark, log = t.spark, change_log(t)
    source, check = folder(spark, "source"), folder(spark, "check")
    third = F.when(F.col("pos.round") == 2, 3).otherwise(F.col("pos.at") % 3)
    target = BucketTable(spark, folder(spark, "target"), ["o_orderkey"], bits=2)
    target.replace(base(t))
    spool = Spool(spark, folder(spark, "spool"), log.schema, max_rows=max(log.count() // 2, 1))
    dies = [True]

    def apply(changes, number):
        target.follow(changes, batch=("spool", number))
        if dies:
            dies.pop()
            raise InterruptedError

    def relieve():
        try:
            return spool.deliver(apply)
        except InterruptedError:
            return True

    for i in range(4):  # a batch each, of as many files as there were tasks
        log.where(third == i).write.mode("append").parquet(source)
        spool.follow(fo.read_changes(spark, source, log.schema), check, relieve).awaitTermination()
    while relieve():
        spool.compact(1000)
    return target.read()


@plan("c17_column_signature", "select case when event_id % 3 = 0 then 'a,k' else 'k' end as signature, count(*) n from events group by 1")
def c17(t: Tables):
    m = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("1"), F.lit("a"), F.lit("2"))).otherwise(F.create_map(F.lit("k"), F.lit("1")))
    return ch.column_signature(t("events").select(m.alias("fields")), "fields")


def written():
    return F.col("o_orderdate")


def ledger(t: Tables):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").where(key() % 3 == 0)
    return echo.announce(None, o, "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"], "insert", ["a"], written())


@plan("c18_announce", "select count(*) entries, count(distinct o_custkey % 200) keys_kept from (select o_custkey, row_number() over (partition by o_custkey % 200 order by o_orderdate desc, o_orderkey) r from orders) where r <= 20")
def c18(t: Tables):
    o = t("orders").select((F.col("o_custkey") % 200).alias("k"), "o_orderkey", "o_orderdate")
    led = echo.announce(None, o, "orders", ["k"], ["o_orderkey"], "update", ["a"], written())
    return led.agg(F.count("*").alias("entries"), F.count_distinct("k").alias("keys_kept"))


def incoming(t: Tables):
    """Changes five seconds after the writes; every seventh has another price, every eleventh comes too late."""
    late = F.when(key() % 11 == 0, F.expr("interval 301 seconds")).otherwise(F.expr("interval 5 seconds"))
    return t("orders").select(F.lit("update").alias("op"), "o_orderkey", "o_orderstatus", (F.col("o_totalprice") + F.when(key() % 7 == 0, 1).otherwise(0)).alias("o_totalprice"), (written() + late).alias("at"))


@plan("c19_recognise_echo", "select o_orderkey, o_orderkey % 3 = 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 as is_echo from orders")
def c19(t: Tables):
    return echo.recognise(incoming(t), ledger(t), "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"]).select("o_orderkey", "is_echo")


@plan("c19_stream_join", "select o_orderkey, o_orderkey % 3 = 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 as is_echo from orders")
def c19c(t: Tables):
    """The same from two streams of files; a heartbeat far ahead lets both watermarks pass, in a second run of the query."""
    spark, columns = t.spark, ["o_orderkey", "o_orderstatus", "o_totalprice"]
    changes, writes = incoming(t), ledger(t)
    came, wrote, check, out = (folder(spark, n) for n in ("came", "wrote", "check", "echoes"))
    ahead = F.expr("timestamp_ntz'2200-01-01 00:00:00'")

    def beat(df):
        given = {"op": F.lit(echo.HEARTBEAT), "at": ahead, "table": F.lit("orders"), "k": F.lit(""), "reading": F.lit("")}
        return spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])

    for c, w in ((changes, writes), (beat(changes), beat(writes))):
        c.write.mode("append").parquet(came)
        w.write.mode("append").parquet(wrote)
        seen = echo.recognise_stream(spark.readStream.schema(changes.schema).parquet(came), spark.readStream.schema(writes.schema).parquet(wrote), "orders", ["o_orderkey"], columns, ["o_orderkey", "at"])
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(out).select("o_orderkey", "is_echo")


@plan("c19_consume", "select count(*) n from orders where o_orderkey % 3 = 0 and not (o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0)")
def c19b(t: Tables):
    led = ledger(t)
    seen = echo.recognise(incoming(t), led, "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return echo.consume(led, seen, "orders", ["o_orderkey"]).agg(F.count("*").alias("n"))


@plan("c20_route", "select o_orderkey, o_orderkey % 2 <> 0 as forward, case when o_orderkey % 2 = 0 then ['a', 'c', 'b'] else ['a', 'b'] end origins from orders")
def c20(t: Tables):
    o = t("orders").select("o_orderkey", F.when(key() % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"))).alias("origins"))
    return echo.route(o, "b", F.array(F.lit("a"), F.lit("c")), F.col("origins"))


@plan("c21_echo_truncate", "select o_orderstatus, o_orderstatus = 'F' as is_echo from orders group by 1")
def c21(t: Tables):
    """A truncate that this side wrote comes back as an echo; one of a table it did not truncate does not."""
    s = t("orders").select("o_orderstatus").distinct()
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    led = echo.announce(None, s.where("o_orderstatus = 'F'"), "F", [], [], "truncate", ["a"], at)
    out = None
    for name in ("F", "O", "P"):
        c = s.where(F.col("o_orderstatus") == name).withColumns({"op": F.lit("truncate"), "at": at})
        got = echo.recognise(c, led, name, ["o_orderstatus"], ["o_orderstatus"]).select("o_orderstatus", "is_echo")
        out = got if out is None else out.union(got)
    return out
