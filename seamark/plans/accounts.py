"""Queries of failure accounting, dead letters, retention and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scratch import folder
from ..operators import accounting as ac
from ..operators.causes import PASSING, classify, may_pass
from ..sources.tables import chunked_snapshot
from ..streaming.throttle import ROCKSDB, stream_throttle
from .registry import Tables, plan
from .sync import key

AT = "timestamp '2024-01-01 00:00:00'"


def batches(t: Tables):
    """Batches of 50 orders in key order, as three jobs."""
    seq = F.floor(key() / 50)
    return t("orders").groupBy((seq % 3).alias("job"), seq.alias("sequence")).agg(F.count("*").alias("n_rows"))


def deliveries(t: Tables):
    """Two tries of every batch: the first fails at each fifth; the second sends some of these and skips others; every eleventh has none."""
    b = batches(t).where("sequence % 11 <> 0")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("sequence"))
    s = F.col("sequence")
    error = F.when(s % 10 == 0, "duplicate key value violates unique constraint").when(s % 10 == 5, "=connection refused")
    one = b.select("job", "sequence", F.when(s % 5 == 0, "failed").otherwise("success").alias("status"), "n_rows", at.alias("at"), error.alias("error"))
    two = b.where("sequence % 10 = 0 or sequence % 15 = 5").select("job", "sequence", F.when(s % 10 == 0, "success").otherwise("skipped"), "n_rows", at + F.expr("interval 1 day"), F.lit(None).cast("string"))
    return one.union(two)


_D = """b as (select (o_orderkey // 50) % 3 as job, o_orderkey // 50 as sequence, count(*) n_rows from orders group by 1, 2),
last as (select job, sequence, n_rows, case when sequence % 5 <> 0 or sequence % 10 = 0 then 'success' when sequence % 15 = 5 then 'skipped' else 'failed' end status from b where sequence % 11 <> 0)"""


@plan("l1_job_counters", f"with {_D} select job, coalesce(sum(n_rows) filter (where status = 'success'), 0)::bigint sent, coalesce(sum(n_rows) filter (where status = 'failed'), 0)::bigint failed, coalesce(sum(n_rows) filter (where status = 'skipped'), 0)::bigint skipped, count(*) sequences from last group by 1")
def l1(t: Tables):
    return ac.job_counters(deliveries(t))


@plan("l2_unsettled", f"with {_D} select job, sequence from b where sequence % 11 = 0 or (job, sequence) in (select (job, sequence) from last where status = 'failed')")
def l2(t: Tables):
    return ac.unsettled(batches(t), deliveries(t)).select("job", "sequence")


@plan("l3_skip", f"with {_D} select job, sequence, 'skipped' as status, least(50, (select count(*) from orders) - 10 - sequence * 50)::bigint n_rows from b where sequence % 11 = 0 and (select count(*) from orders) - 10 > sequence * 50")
def l3(t: Tables):
    total = t("orders").count() - 10
    return ac.skip(deliveries(t), batches(t).select("job", "sequence"), 50, total, "2024-01-03 00:00:00").select("job", "sequence", "status", "n_rows")


@plan("l4_failed_rows", f"with {_D} select o_orderkey from orders where o_orderkey // 50 in (select sequence from last where status = 'failed' and job = 1)")
def l4(t: Tables):
    snap = chunked_snapshot(t("orders").select("o_orderkey"), [("o_orderkey", True)], 50)
    return ac.failed_rows(snap, deliveries(t), 1).select("o_orderkey")


@plan("l5_resend_captured", "select o_orderkey as id, case when o_orderkey % 4 = 0 then 'delete' else 'upsert' end as op, null::varchar as reason from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 union all select o_orderkey, null, case when o_orderkey % 3 = 0 then 'the capture was cut' else 'the capture does not parse' end from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0")
def l5(t: Tables):
    body = F.when(key() % 5 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(key().alias("id"))))
    cap = t("orders").select(key().alias("id"), F.when(key() % 4 == 0, "delete").otherwise("upsert").alias("op"), body.alias("body"), (key() % 3 == 0).alias("truncated"))
    good, bad = ac.resend_captured(cap, "id long")
    return good.select("id", "op", F.lit(None).cast("string").alias("reason")).union(bad.select("id", F.lit(None).cast("string"), "reason"))


def rules():
    return {"required": F.col("c_name").isNotNull(), "length": F.length("c_mktsegment") <= 9, "range": F.col("c_acctbal") >= 0}
_REASON = "case when c_custkey % 13 = 0 then 'required' when length(c_mktsegment) > 9 then 'length' when c_acctbal < 0 then 'range' end"


def rows_with_faults(t: Tables):
    return t("customer").withColumn("c_name", F.when(F.col("c_custkey") % 13 != 0, F.col("c_name")))


@plan("l6_isolate", f"select c_custkey, {_REASON} as _reason from customer")
def l6(t: Tables):
    return ac.isolate(rows_with_faults(t), rules()).select("c_custkey", "_reason")


@plan("l6_verdict", f"select count(*) filter (where ({_REASON}) is null) good, count(*) filter (where ({_REASON}) is not null) bad, count(*) filter (where ({_REASON}) is not null) > 100 or (count(*) filter (where ({_REASON}) is null) = 0 and count(*) > 0) as systemic from customer")
def l6b(t: Tables):
    return ac.isolation_verdict(ac.isolate(rows_with_faults(t), rules()))


@plan("l6_duplicates", "select l_orderkey, l_linenumber, case when count(*) over (partition by l_orderkey, l_linenumber) > 1 then 'unique' end as _reason from lineitem")
def l6c(t: Tables):
    return ac.isolate_duplicates(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def dead(t: Tables):
    parked = ac.park(ac.isolate(rows_with_faults(t), rules()), "orders-bridge", "upsert", F.struct(F.col("c_custkey").alias("at")), "2024-01-02 00:00:00")
    return parked.withColumns({"c_custkey": F.col("pos.at"), "n_rows": F.lit(1).cast("long"), "settled_at": F.lit(None).cast("timestamp_ntz")})


@plan("l7_park", f"select c_custkey, ({_REASON}) as error, c_mktsegment as segment from customer where ({_REASON}) is not null")
def l7(t: Tables):
    return dead(t).select("c_custkey", "error", F.get_json_object("row", "$.c_mktsegment").alias("segment"))


@plan("l8_pending", f"select 'orders-bridge' as bridge, count(*) entries, count(*) n_rows, count(*) >= 10000 as full from customer where ({_REASON}) is not null having count(*) > 0")
def l8(t: Tables):
    return ac.pending(dead(t)).select("bridge", "entries", "n_rows", "full")


@plan("l9_refresh_verdicts", f"select c_custkey, case when c_custkey % 3 = 0 then 'delete' when c_nationkey >= 12 then 'nothing' else 'upsert' end verdict from customer where ({_REASON}) is not null")
def l9(t: Tables):
    source = t("customer").where("c_custkey % 3 <> 0")
    return ac.refresh_verdicts(dead(t), source, ["c_custkey"], F.col("c_nationkey") < 12, deletes=True).select("c_custkey", "verdict")


@plan("l10_replay_recorded", f"select c_custkey, c_acctbal from customer where ({_REASON}) is not null")
def l10(t: Tables):
    return ac.replay_recorded(dead(t), "c_custkey long, c_acctbal double")


@plan("l11_force_discard", f"select case when c_custkey % 2 = 0 then 'forced' when c_custkey % 3 = 0 then 'discarded' else 'pending' end status, count(*) n from customer where ({_REASON}) is not null group by 1")
def l11(t: Tables):
    d = ac.close_letters(dead(t), F.col("c_custkey") % 2 == 0, "forced", "2024-01-03 00:00:00")
    d = ac.close_letters(d, F.col("c_custkey") % 3 == 0, "discarded", "2024-01-03 00:00:00")
    return d.groupBy("status").agg(F.count("*").alias("n"))


@plan("l12_failure_export", f"with {_D} select job, sequence, n_rows, case when sequence % 10 = 5 then '''=connection refused' else 'duplicate key value violates unique constraint' end error from b where sequence % 11 <> 0 and sequence % 5 = 0")
def l12(t: Tables):
    return ac.failure_export(deliveries(t))


#: Messages as engines and services write them, each with its cause.
MESSAGES = (
    ("the source's columns changed: ssn is gone", "source changed"),
    ("balance: cannot read n/a as number", "transform failed"),
    ("ERROR: logical decoding requires wal_level >= logical (SQLSTATE 55000)", "log reading not enabled"),
    ("The $changeStream stage is only supported on replica sets, code: 40573", "log reading not enabled"),
    ("ERROR: all replication slots are in use, raise max_replication_slots", "slots exhausted"),
    ("ERROR 1236 (HY000): could not find first log file name", "log position gone"),
    ("the receiver answered HTTP 401 to the batch", "http: login"),
    ("the receiver answered HTTP/1.1 410 Gone", "http: not found"),
    ("the receiver answered HTTP 429 to the batch", "http: too many requests"),
    ("the receiver answered HTTP 422 to the batch", "http: refused by the client's fault"),
    ("the receiver answered HTTP 503 to the batch", "http: server failed"),
    ("connect ECONNREFUSED 127.0.0.1:5432", "connection refused"),
    ("java.net.UnknownHostException: db: Name or service not known", "host not found"),
    ("canceling statement due to statement timeout (SQLSTATE 57014)", "timed out"),
    ("read ECONNRESET", "connection lost"),
    ("ERROR 1045 (28000): Access denied for user 'x'@'y'", "login failed"),
    ("WRONGPASS invalid username-password pair", "login failed"),
    ("ERROR: permission denied for table t (SQLSTATE 42501)", "no permission"),
    ("unable to get local issuer certificate", "certificate"),
    ("ERROR 1049 (42000): Unknown database 'd'", "no such database"),
    ("[TABLE_OR_VIEW_NOT_FOUND] no such table or view. SQLSTATE: 42P01", "no such table"),
    ("no such table: t", "no such table"),
    ('column "c" of relation "t" does not exist', "no such column"),
    ('duplicate key value violates unique constraint "t_pkey"', "duplicate key"),
    ("E11000 duplicate key error collection: d.t", "duplicate key"),
    ("SQLITE_CONSTRAINT_UNIQUE: t.k", "duplicate key"),
    ("ERROR 1452 (23000): Cannot add or update a child row", "missing parent"),
    ("SQLITE_CONSTRAINT_NOTNULL: t.c", "required value"),
    ('new row for relation "t" violates check constraint "c"', "check failed"),
    ("ERROR 1406 (22001): Data too long for column 'c' at row 1", "too long"),
    ("ERROR: integer out of range (SQLSTATE 22003)", "out of range"),
    ("ERROR: invalid text representation (SQLSTATE 22P02)", "wrong type"),
    ("ERROR: deadlock detected", "deadlock"),
    ("write failed: ENOSPC", "out of space"),
    ("OOM command not allowed when used memory > 'maxmemory'", "out of memory"),
    ("ERROR 1040 (HY000): Too many connections", "too many connections"),
    ("something nobody has seen before", "other"),
)


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@plan(
    "l13_classify_errors",
    f"""with m as (select [{", ".join(_sql(c) for _, c in MESSAGES)}] c), p as (select [{", ".join(_sql(c) for c in PASSING)}] p)
select m.c[(o_orderkey % {len(MESSAGES)} + 1)::int] cause, list_contains(p.p, m.c[(o_orderkey % {len(MESSAGES)} + 1)::int]) may_pass, count(*) n from orders, m, p group by 1, 2""",
)
def l13(t: Tables):
    """Every cause, from messages of several engines and services."""
    said = F.element_at(F.array(*[F.lit(m) for m, _ in MESSAGES]), (F.col("o_orderkey") % len(MESSAGES) + 1).cast("int"))
    by_cause = t("orders").groupBy(classify(said).alias("cause")).agg(F.count("*").alias("n"))
    return by_cause.select("cause", may_pass(F.col("cause")).alias("may_pass"), "n")


@plan("l13_failed_batches", f"with {_D} select case when sequence % 10 = 5 then 'connection refused' else 'duplicate key' end cause, count(*) n from b where sequence % 11 <> 0 and sequence % 5 = 0 group by 1")
def l13c(t: Tables):
    return deliveries(t).where("status = 'failed'").groupBy(classify(F.col("error")).alias("cause")).agg(F.count("*").alias("n"))


@plan(
    "l13_http_errors",
    """select case when c in (401, 403) then 'http: login' when c in (404, 410) then 'http: not found' when c = 429 then 'http: too many requests'
when c < 500 then 'http: refused by the client''s fault' else 'http: server failed' end cause, count(*) n
from (select [401, 403, 404, 410, 422, 429, 500, 503][(o_orderkey % 8 + 1)::int] c from orders) group by 1""",
)
def l13b(t: Tables):
    """Failures of a delivery over HTTP, by cause."""
    code = F.element_at(F.array(*map(F.lit, (401, 403, 404, 410, 422, 429, 500, 503))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    said = F.concat(F.lit("the receiver answered HTTP "), code.cast("string"), F.lit(" to the batch"))
    return t("orders").groupBy(classify(said).alias("cause")).agg(F.count("*").alias("n"))


@plan(
    "l14_retention",
    """with d as (select user_id job, event_id as sequence, ts, user_id % 3 = 0 as finished, date_trunc('day', max(ts) over (partition by user_id)) ended,
row_number() over (partition by user_id order by ts desc, event_id desc) r from events)
select job, sequence from d where sequence % 97 = 0 or case when finished then ended >= timestamp '2024-01-30 12:00:00' else ts >= timestamp '2024-01-10 12:00:00' and r <= 20 end""".replace("timestamp '2024-01-30 12:00:00'", "timestamp '2024-01-10 12:00:00'"),
)
def l14(t: Tables):
    e = t("events")
    details = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("sequence"), F.col("ts").alias("at"))
    jobs = e.groupBy(F.col("user_id").alias("job")).agg(F.date_trunc("DAY", F.max("ts")).alias("end")).select("job", F.when(F.col("job") % 3 == 0, F.col("end")).alias("finished_at"))
    protected = details.where("sequence % 97 = 0")
    return ac.retention(details, jobs, dt.datetime(2024, 1, 31, 12), 21, 20, protected).select("job", "sequence")


@plan("l14_expire_letters", f"select c_custkey from customer where ({_REASON}) is not null and (c_custkey % 2 <> 0)")
def l14b(t: Tables):
    d = ac.close_letters(dead(t), F.col("c_custkey") % 2 == 0, "discarded", "2024-01-03 00:00:00")
    return ac.expire_letters(d, dt.datetime(2024, 3, 1), 30).select("c_custkey")


@plan("l14_last_verifications", "select user_id as bridge, event_id as run from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10")
def l14c(t: Tables):
    runs = t("events").select(F.col("user_id").alias("bridge"), F.col("event_id").alias("run"), F.col("ts").alias("at"))
    return ac.last_verifications(runs).select("bridge", "run")


@plan("l15_audit_query", "with c as (select ts, event_id from events where event_type = 'click' order by ts desc, event_id desc limit 1 offset 40) select e.event_id from events e, c where e.event_type = 'click' and (e.ts < c.ts or (e.ts = c.ts and e.event_id < c.event_id)) order by e.ts desc, e.event_id desc limit 25")
def l15(t: Tables):
    log = t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    first = ac.audit_page(log, {"event_type": "click"}, None, 41).orderBy("at", "id").first()  # one row: the page's last
    return ac.audit_page(log, {"event_type": "click"}, (first["at"], first["id"]), 25).select(F.col("id").alias("event_id"))


@plan("l16_audit_redact", "select c_custkey, '[redacted]' as secret, '[redacted]' as header, c_name as plain from customer")
def l16(t: Tables):
    m = ac.audit_redact(F.create_map(F.lit("dbPassword"), F.col("c_name"), F.lit("Authorization"), F.col("c_name"), F.lit("name"), F.col("c_name")))
    return t("customer").select("c_custkey", m["dbPassword"].alias("secret"), m["Authorization"].alias("header"), m["name"].alias("plain"))


@plan(
    "l17_summary_metrics",
    f"""with {_D} select 'bridges' as metric, case n_regionkey % 3 when 0 then 'cdc' when 1 then 'watch' else 'replay' end label, count(*)::bigint as value from nation group by 2
union all select 'jobs', case when c_custkey % 4 = 0 then 'failed' else 'done' end, count(*) from customer group by 2
union all select 'rows', status, sum(n_rows)::bigint from last group by 2 union all select 'dead rows', 'pending', count(*) from customer where ({_REASON}) is not null""",
)
def l17(t: Tables):
    r = F.col("n_regionkey") % 3
    bridges = t("nation").select(F.when(r == 0, "cdc").when(r == 1, "watch").otherwise("replay").alias("trigger"))
    jobs = t("customer").select(F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("done").alias("status"))
    return ac.summary_metrics(bridges, jobs, deliveries(t), dead(t))


_THROTTLE = """with recursive sent(u, k, t, was) as (
select user_id, event_type, min(ts), null::timestamp from events group by 1, 2
union all select s.u, s.k, min(e.ts), s.t from sent s join events e on e.user_id = s.u and e.event_type = s.k and e.ts >= s.t + interval 6 hours group by s.u, s.k, s.t)
select u as user_id, k as event_type, t as "at", (select count(*) from events e where e.user_id = s.u and e.event_type = s.k and e.ts > s.was and e.ts < s.t)::bigint as suppressed from sent s"""


@plan(
    "l18_alert_throttle",
    _THROTTLE,
)
def l18(t: Tables):
    """Alerts of each user and kind, at most one in six hours counted from the last sent."""
    e = t("events").select("user_id", "event_type", F.col("ts").alias("at"))
    return ac.alert_throttle(e, ["user_id", "event_type"], 6 * 3600)


@plan("l18_stream_throttle", _THROTTLE)
def l18b(t: Tables):
    """The same from a stream of files: four batches in time order, the query started anew for each from its checkpoint."""
    spark, path = t.spark, folder(t.spark, "throttle")
    e = t("events").select("user_id", "event_type", F.col("ts").alias("at"))
    cuts = e.agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [0.25, 0.5, 0.75]).alias("q")).first()["q"]  # one row
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    bounds = [None, *cuts, None]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for low, high in zip(bounds, bounds[1:], strict=False):
            part = e if low is None else e.where(micros > low)
            (part if high is None else part.where(micros <= high)).write.mode("append").parquet(f"{path}/in")
            sent = stream_throttle(spark.readStream.schema(e.schema).parquet(f"{path}/in"), ["user_id", "event_type"], seconds=6 * 3600, forget=90 * 86_400, together=["user_id"])
            sent.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(sent.schema).parquet(f"{path}/out").select("user_id", "event_type", "at", "suppressed")


@plan("l19_level_changes", "select bridge, ts as at_, level from (select user_id as bridge, ts, event_type as level, lag(event_type) over (partition by user_id order by ts) p from events) where p is distinct from level")
def l19(t: Tables):
    e = t("events").select(F.col("user_id").alias("bridge"), F.col("ts").alias("at"), F.col("event_type").alias("level"))
    return ac.level_changes(e).select("bridge", F.col("at").alias("at_"), "level")
