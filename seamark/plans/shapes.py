"""Queries of mapping, payloads and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions.convert import loss_audit, rules_for
from ..functions.shaping import Cast, Default, Mask, Set, Step, Text, map_columns, project_row, shape_rows
from ..sources.tables import chunked_snapshot
from .registry import Tables, plan

NAME = "case when c_custkey % 5 = 0 then null else c_name end"


def customers(t: Tables):
    """Customers with NULL names at every fifth key and padded, mixed-case text beside."""
    c = t("customer")
    return c.withColumns({"c_name": F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), "padded": F.concat(F.lit(" \t"), F.lower(F.substring("c_name", 1, 4)), F.upper(F.substring("c_name", 5, 20)), F.lit("\n "))})


def loose(t: Tables):
    """Orders with loosely written numbers, booleans and dates as text."""
    k = F.col("o_orderkey")
    number = F.when(k % 7 == 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" "))).when(k % 7 == 1, F.lit("")).when(k % 7 == 2, F.lit("12abc")).when(k % 7 == 3, F.lit("-3.9")).when(k % 7 == 4, F.lit("Infinity")).when(k % 7 == 5, F.lit("1e2"))
    flag = F.element_at(F.array(*map(F.lit, ("yes", "NO", " on ", "off", "maybe", "1", "", "T"))), (k % 8 + 1).cast("int"))
    day = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 2, F.lit("1700000000")).otherwise(F.lit("not a date"))
    return t("orders").select("o_orderkey", number.alias("number"), flag.alias("flag"), day.alias("day"))


_NUMBER = "case o_orderkey % 7 when 0 then ' ' || o_totalprice || ' ' when 1 then '' when 2 then '12abc' when 3 then '-3.9' when 4 then 'Infinity' when 5 then '1e2' end"
_FLAG = "(['yes', 'NO', ' on ', 'off', 'maybe', '1', '', 'T'])[(o_orderkey % 8 + 1)::int]"
_DAY = "case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 2 then '1700000000' else 'not a date' end"
_NUM = "case o_orderkey % 7 when 0 then o_totalprice when 3 then -3.9 when 5 then 100.0 end::double"


def _shape(name: str, steps: list[Step], columns: list[str], sql: str, base=customers) -> None:
    @plan(name, sql)
    def _(t: Tables, steps=steps, columns=columns, base=base):
        return shape_rows(base(t), steps, table="customer", now="2024-05-06T07:08:09.000Z").select(*columns)


_shape("t1_mask_redact", [Mask("c_name", "redact", fill="ab")], ["c_custkey", "c_name"], f"select c_custkey, case when {NAME} is not null then 'abababab' end c_name from customer")
_shape(
    "t2_mask_partial",
    [Mask("c_name", "partial", keep_start=2, keep_end=3)],
    ["c_custkey", "c_name"],
    f"select c_custkey, case when {NAME} is not null then left(c_name, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) end c_name from customer",
)
_shape(
    "t2_mask_short",
    [Mask("c_mktsegment", "partial", keep_start=6, keep_end=4, fill="#")],
    ["c_custkey", "c_mktsegment"],
    "select c_custkey, repeat('#', length(c_mktsegment)) c_mktsegment from customer where length(c_mktsegment) <= 10",
)
_shape("t3_mask_hash", [Mask("c_name", "hash", salt="s1:")], ["c_custkey", "c_name"], f"select c_custkey, sha256('s1:' || {NAME}) c_name from customer")
_shape("t4_mask_null", [Mask("c_name", "null")], ["c_custkey", "c_name"], "select c_custkey, null::varchar c_name from customer")
_shape("t5_cast_string", [Cast("o_totalprice", "string"), Cast("o_orderdate", "string")], ["o_orderkey", "o_totalprice", "o_orderdate"], "select o_orderkey, case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else o_totalprice::varchar end o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') o_orderdate from orders", lambda t: t("orders"))
_shape("t6_cast_number", [Cast("number", "number", "null")], ["o_orderkey", "number"], f"select o_orderkey, {_NUM} number from orders", loose)
_shape("t7_cast_integer", [Cast("number", "integer", "null")], ["o_orderkey", "number"], f"select o_orderkey, trunc({_NUM})::bigint number from orders", loose)
_shape("t8_cast_boolean", [Cast("flag", "boolean", "null")], ["o_orderkey", "flag"], "select o_orderkey, ([true, false, true, false, null, true, false, true])[(o_orderkey % 8 + 1)::int] flag from orders", loose)
_shape(
    "t9_cast_date",
    [Cast("day", "date", "null")],
    ["o_orderkey", "day"],
    "select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') when 2 then '2023-11-14T22:13:20.000Z' end as day from orders",
    loose,
)
_shape(
    "t11_on_error_fail",
    [Cast("number", "number", "fail")],
    ["o_orderkey", "_errors"],
    f"""select o_orderkey, case when ({_NUMBER}) is not null and ({_NUM}) is null then ['number: cannot read ' || ({_NUMBER}) || ' as number'] else []::varchar[] end as _errors from orders""",
    loose,
)
_shape(
    "t11_on_error_keep",
    [Cast("number", "number", "keep")],
    ["o_orderkey", "number", "_warnings"],
    f"""select o_orderkey, case when ({_NUM}) = trunc({_NUM}) then ({_NUM})::bigint::varchar when ({_NUM}) is not null then ({_NUM})::varchar else ({_NUMBER}) end as number,
case when ({_NUMBER}) is not null and ({_NUM}) is null then ['number: cannot read ' || ({_NUMBER}) || ' as number'] else []::varchar[] end as _warnings from orders""",
    loose,
)
_PADDED = "lower(left(c_name, 4)) || upper(c_name[5:24])"
_shape("t12_trim", [Text("padded", "trim")], ["c_custkey", "padded"], f"select c_custkey, {_PADDED} padded from customer")
_shape("t13_lower", [Text("padded", "trim"), Text("padded", "lower")], ["c_custkey", "padded"], f"select c_custkey, lower({_PADDED}) padded from customer")
_shape("t14_upper", [Text("padded", "trim"), Text("padded", "upper")], ["c_custkey", "padded"], f"select c_custkey, upper({_PADDED}) padded from customer")
_shape("t15_default", [Default("c_name", "nobody"), Default("level", 3)], ["c_custkey", "c_name", "level"], f"select c_custkey, coalesce({NAME}, 'nobody') c_name, 3 as level from customer")
_shape(
    "t16_set",
    [Set("label", "{{c_custkey}}/{{c_name}}/{{c_acctbal}}@{{$table}} {{nope}}"), Set("bal", "{{c_acctbal}}"), Set("at", "{{ $now }}")],
    ["c_custkey", "label", "bal", "at", "_warnings"],
    f"""select c_custkey, c_custkey || '/' || coalesce({NAME}, '') || '/' || (case when c_acctbal = trunc(c_acctbal) then c_acctbal::bigint::varchar else c_acctbal::varchar end) || '@customer ' as label,
c_acctbal bal, '2024-05-06T07:08:09.000Z' as at, ['label: no such column nope'] _warnings from customer""",
)


@plan("t10_cast_json", "select event_id, (props::json ->> 'k')::bigint k from events")
def t10(t: Tables):
    return shape_rows(t("events"), [Cast("props", "json")]).select("event_id", F.variant_get("props", "$.k", "long").alias("k"))


@plan(
    "t17_keys_only",
    f"""select c_custkey, case when {NAME} is not null then '********' end c_name, case when c_custkey % 3 = 0 then null else 'x' end extra from customer""",
)
def t17(t: Tables):
    c = customers(t).withColumn("op", F.when(F.col("c_custkey") % 3 == 0, "delete").otherwise("update")).withColumn("extra", F.lit(None).cast("string"))
    return shape_rows(c, [Mask("c_name", "redact"), Default("extra", "x")], op_col="op").select("c_custkey", "c_name", "extra")


@plan(
    "t18_shape_rows",
    """select count(*) filter (where o_orderkey % 7 in (0, 3, 5, 6)) good, count(*) filter (where o_orderkey % 7 in (1, 2, 4)) bad,
count(*) filter (where o_orderkey % 4 = 3) warned from orders""",
)
def t18(t: Tables):
    s = shape_rows(loose(t), [Cast("number", "number"), Cast("day", "date", "null"), Text("flag", "trim"), Mask("flag", "partial", keep_start=1)])
    return s.agg(F.count_if(F.size("_errors") == 0).alias("good"), F.count_if(F.size("_errors") > 0).alias("bad"), F.count_if(F.size("_warnings") > 0).alias("warned"))


@plan("p1_map_columns", "select o_orderkey as id, null::varchar as gone, o_totalprice as price, case when o_orderkey % 5 = 0 then ['price'] else []::varchar[] end as unchanged from orders")
def p1(t: Tables):
    o = t("orders").withColumn("unchanged", F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("o_totalprice"), F.lit("o_comment"))).otherwise(F.array().cast("array<string>")))
    return map_columns(o, {"o_orderkey": "id", "absent": "gone", "o_totalprice": "price"}, "unchanged")


@plan("p2_project_row", "select n_nationkey, n_name as name from nation")
def p2(t: Tables):
    return project_row(t("nation"), ["n_nationkey", "n_name", "nowhere"], {"n_name": "name"})


_T3 = {"id": "{{c_custkey}}", "who": "{{c_name}}", "note": "{{c_custkey}} of {{$table}}", "bal": "{{c_acctbal}}", "tags": ["{{$op}}", 1, None], "at": "{{$now}}", "key {{c_nationkey}}": "{{nope}}"}
_BAL = "(case when c_acctbal = trunc(c_acctbal) then c_acctbal::bigint::varchar else c_acctbal::varchar end)"
_BODY = f"""'{{"id":' || c_custkey || ',"who":' || coalesce('"' || ({NAME}) || '"', 'null') || ',"note":"' || c_custkey || ' of customer","bal":' || {_BAL} || ',"tags":["upsert",1,null],"at":"now","key ' || c_nationkey || '":null}}'"""


@plan("p3_render_payload", f"select c_custkey, {_BODY} body from customer")
def p3(t: Tables):
    c = customers(t)
    return c.select("c_custkey", pl.render_payload(c, _T3, table="customer", now="now", op="upsert")[0].alias("body"))


@plan(
    "p4_render_batches",
    """with r as (select row_number() over (order by n_nationkey) - 1 i, n_nationkey, n_name from nation)
select i // 10 as sequence, count(*)::int n_rows, '{"rows":[' || string_agg('{"i":' || i || ',"name":"' || n_name || '"}', ',' order by i) || ']}' body from r group by 1""",
)
def p4(t: Tables):
    n = chunked_snapshot(t("nation"), [("n_nationkey", True)], 10)
    body, _ = pl.render_payload(n, {"i": "{{$index}}", "name": "{{n_name}}"}, index=F.col("row_index"))
    return pl.render_batches(n.withColumn("body", body), "body", "row_index", 10, "rows")


@plan(
    "p5_render_key",
    f"select c_custkey, case when ({NAME}) is null then null else 'customer:' || c_nationkey || ':' || c_name end as key, case when ({NAME}) is null then ['c_name'] else []::varchar[] end missing from customer",
)
def p5(t: Tables):
    c = customers(t)
    key, missing = pl.render_key(c, "customer:{{c_nationkey}}:{{c_name}}")
    return c.select("c_custkey", key.alias("key"), missing.alias("missing"))


@plan("p6_to_key_hash", f"select c_custkey, {NAME} as name_field, case when ({NAME}) is null then ['c_name'] else []::varchar[] end unset, {_BAL} bal_field from customer")
def p6(t: Tables):
    c = customers(t)
    fields, unset = pl.to_key_hash(c, ["c_name", "c_acctbal"])
    c = c.withColumns({"f": fields, "unset": unset})
    return c.select("c_custkey", F.try_element_at("f", F.lit("c_name")).alias("name_field"), "unset", F.try_element_at("f", F.lit("c_acctbal")).alias("bal_field"))


@plan("p7_to_key_json", f"""select c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":' || coalesce('"' || ({NAME}) || '"', 'null') || ',"c_acctbal":' || {_BAL} || '}}' as doc from customer""")
def p7(t: Tables):
    c = customers(t)
    return c.select("c_custkey", pl.to_key_json(c, ["c_custkey", "c_name", "c_acctbal"]).alias("doc"))


@plan("p8_to_key_string", f"select c_custkey, {_BAL} as value from customer")
def p8(t: Tables):
    c = t("customer")
    return c.select("c_custkey", pl.to_key_string(c, "c_acctbal").alias("value"))


@plan(
    "p9_apply_key_rows",
    """select 'n:' || n_nationkey as key, case when n_nationkey % 3 = 0 then 'X' || n_name else n_name end as name, case when n_nationkey % 3 = 0 then null else n_regionkey::varchar end region,
case when n_nationkey % 3 = 0 then 60::bigint end ttl from nation""",
)
def p9(t: Tables):
    n = t("nation").withColumn("key", F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")))
    fields, _ = pl.to_key_hash(n, ["n_name", "n_regionkey"])
    target = n.select("key", F.lit("hash").alias("kind"), F.lit(None).cast("string").alias("text"), fields.alias("fields"), F.lit(None).cast("long").alias("ttl"))
    rows = n.where("n_nationkey % 3 = 0").select("key", F.lit("hash").alias("kind"), F.lit(None).cast("string").alias("text"), F.create_map(F.lit("n_name"), F.concat(F.lit("X"), "n_name")).alias("fields"), F.array(F.lit("n_regionkey")).alias("unset"), F.lit(60).cast("long").alias("ttl"))
    out = pl.apply_key_rows(target, rows)
    return out.select("key", F.try_element_at("fields", F.lit("n_name")).alias("name"), F.try_element_at("fields", F.lit("n_regionkey")).alias("region"), "ttl")


@plan(
    "p10_dry_run",
    f"""select (select count(*) from orders where ({_NUMBER}) is not null and ({_NUM}) is null) would_fail,
(select count(*) from orders where o_orderkey % 4 = 3) become_null, (select count(*) from orders where o_orderkey % 8 = 6) key_problems, (select count(*) from orders where length({_FLAG}) > 3) too_long""",
)
def p10(t: Tables):
    rows = loose(t)
    key, missing = pl.render_key(rows, "o:{{flag}}")
    audit = loss_audit(rows, rules_for("postgres", rows.select("flag").schema, limits={"flag": 3}))
    s = shape_rows(rows.withColumn("_missing", missing), [Cast("number", "number"), Cast("day", "date", "null")])
    n = s.agg(F.count_if(F.size("_errors") > 0).alias("would_fail"), F.count_if(F.size("_warnings") > 0).alias("become_null"), F.count_if(F.size("_missing") > 0).alias("key_problems"))
    return n.crossJoin(audit.where("loss = 'length'").select(F.col("n_values").alias("too_long")))  # one row each
