"""Queries of conversion, loss audit, canonical values, exports and drift."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert as cv
from ..functions.canonical import diff_row, key_text, same
from ..functions.scratch import folder
from ..operators import drift as dr
from ..operators import exports as ex
from ..operators.verify import values_agree
from ..sources.tables import infer_document_schema, restore_json
from .registry import Tables, plan

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _audit(name: str, target: str, table: str, columns: list[str], sql: str, keys=(), limits=None) -> None:
    @plan(name, sql)
    def _(t: Tables, target=target, table=table, columns=columns, keys=keys, limits=limits):
        df = t(table).select(*columns)
        return cv.loss_audit(df, cv.rules_for(target, df.schema, list(keys), limits))


_audit("d1_loss_audit", "document", "events", ["event_id", "ts"], "select 'ts' as \"column\", 'fraction of second' loss, count(*) n_values, min(rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')) example from events where microsecond(ts) % 1000 <> 0")
_audit(
    "d2_postgres",
    "postgres",
    "part",
    ["p_name", "p_type"],
    """select 'p_name' as "column", 'length' loss, count(*) filter (where length(p_name) > 10) n_values, min(p_name) filter (where length(p_name) > 10) example from part
union all select 'p_name', 'char padding', 0, null union all select 'p_type', 'char padding', 0, null""",
    limits={"p_name": 10},
)
_audit(
    "d3_mysql",
    "mysql",
    "documents",
    ["text", "source"],
    """select 'text' as "column", 'length' loss, count(*) filter (where length(text) > 16383) n_values, min(text) filter (where length(text) > 16383) example from documents
union all select 'source', 'length', 0, null""",
    keys=["source"],
)
_audit("d4_sqlite", "sqlite", "lineitem", ["l_extendedprice", "l_tax"], "select unnest(['l_extendedprice', 'l_tax']) as \"column\", 'digits' loss, 0::bigint n_values, null::varchar example")


@plan("d4_sqlite_digits", "select 'wide' as \"column\", 'digits' loss, count(*) n_values, min(o_orderkey || '000000000012345.67') example from orders where o_orderkey >= 0 and length(ltrim(o_orderkey || '000000000012345.67', '0')) - 1 > 15")
def d4(t: Tables):
    o = t("orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("000000000012345.67")).cast("decimal(38,2)").alias("wide"))
    out = cv.loss_audit(o, cv.rules_for("sqlite", o.schema))
    return out


@plan("d5_spark", "select 'digits' loss, count(*) filter (where length(o_orderkey || repeat('9', 36)) > 38) n_values from orders union all select 'time as text', count(*) filter (where o_orderkey % 4 = 0) from orders")
def d5(t: Tables):
    k = F.col("o_orderkey")
    o = t("orders").select(F.concat(k.cast("string"), F.lit("9" * 36)).alias("wide"), F.when(k % 4 == 0, "10:20").otherwise("x").alias("clock"))
    audit = cv.loss_audit(o, cv.rules_for("spark", o.schema))
    return audit.where("(column = 'wide' and loss = 'digits') or (column = 'clock' and loss = 'time as text')").select("loss", "n_values")


@plan("v1_instant_mysql", "select event_id, " + TS.format(c="ts") + " as at from events")
def v1(t: Tables):
    return t("events").select("event_id", cv.instant_mysql(F.col("ts")).alias("at"))


@plan("v2_instant_iso", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at from events")
def v2(t: Tables):
    return t("events").select("event_id", cv.instant_iso(F.col("ts")).alias("at"))


@plan("v3_instant_millis", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(((microsecond(ts) % 1000000) // 1000)::varchar, 3, '0') as at from events")
def v3(t: Tables):
    return t("events").select("event_id", F.date_format(cv.instant_millis(F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@plan("v4_zero_date", "select o_orderkey, case when o_orderkey % 4 in (0, 1, 2) then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def v4(t: Tables):
    k = F.col("o_orderkey") % 4
    day = F.when(k == 0, "0000-00-00").when(k == 1, "1999-00-10").when(k == 2, "1999-10-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", cv.zero_date(day).alias("day"))


@plan("v5_boolean", "select doc_id, quality = 1 as quality, toxic = 1 as toxic from labels")
def v5(t: Tables):
    la = t("labels")
    byte = F.unhex(F.when(F.col("toxic") == 1, "01").otherwise("00"))
    return la.select("doc_id", cv.boolean_from(F.col("quality").cast("string"), T.StringType()).alias("quality"), cv.boolean_from(byte, T.BinaryType()).alias("toxic"))


@plan("v6_json_value", "select event_id, case when event_id % 3 = 0 then null else (props::json ->> 'k')::bigint end k, case when event_id % 3 = 0 then 'no {json' end raw from events")
def v6(t: Tables):
    e = t("events").withColumn("j", cv.json_value(F.when(F.col("event_id") % 3 == 0, "no {json").otherwise(F.col("props"))))
    return e.select("event_id", F.try_variant_get("j", "$.k", "long").alias("k"), F.when(F.col("event_id") % 3 == 0, F.try_variant_get("j", "$", "string")).alias("raw"))


@plan("v7_exact_number", "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderkey * 100 end n from orders")
def v7(t: Tables):
    k = F.col("o_orderkey")
    digits = F.when(k % 2 == 0, (k * 100).cast("string")).otherwise(F.concat(F.lit("9007199254740992"), (k % 10).cast("string")))
    return t("orders").select("o_orderkey", cv.exact_number(digits).alias("n"))


@plan("v8_bytes_hex", "select n_nationkey, lower(hex(encode(n_name))) h from nation")
def v8(t: Tables):
    return t("nation").select("n_nationkey", cv.bytes_hex(F.encode("n_name", "UTF-8")).alias("h"))


@plan("v9_convert_rows", "select event_id, " + TS.format(c="ts") + " ts, (value > 0)::int positive, event_type from events")
def v9(t: Tables):
    e = t("events").select("event_id", "ts", (F.col("value") > 0).alias("positive"), "event_type")
    return cv.convert_rows(e, "postgres", "mysql")


@plan("v10_row_codec", "select event_id, " + TS.format(c="ts") + " ts, value, event_type, lower(hex(encode(event_type))) raw from events")
def v10(t: Tables):
    e = t("events").select("event_id", "ts", "value", "event_type", F.encode("event_type", "UTF-8").alias("raw"))
    back = e.select(cv.encode_row(e).alias("j")).select(*cv.decode_row(F.col("j"), e.schema))
    return back.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value", "event_type", F.lower(F.hex("raw")).alias("raw"))


@plan("k1_key_text", """select c_custkey, '["' || c_custkey || '",' || case when c_custkey % 5 = 0 then 'null' else '"' || c_name || '"' end || ',"' || lpad((c_custkey % 100)::varchar, 3, '0') || '"]' as k from customer""")
def k1(t: Tables):
    c = t("customer").withColumns({"c_name": F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), "code": F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0")})
    return c.select("c_custkey", key_text(["c_custkey", "c_name", "code"], c.schema).alias("k"))


def _agree(name: str, kind: str, table: str, key: str, a, b, sql: str, millis: bool = False) -> None:
    @plan(name, sql)
    def _(t: Tables, kind=kind, table=table, key=key, a=a, b=b, millis=millis):
        df = t(table).select(key, a().alias("a"), b().alias("b"))
        return df.select(key, values_agree(df, "a", "b", kind, millis).alias("agree"))




def _k():
    return F.col("o_orderkey")


def _words():
    return F.element_at(F.array(*map(F.lit, ("t", "1", "YES", "on", "false", "0", "n", "off"))), (_k() % 8 + 1).cast("int"))


_agree("k2a_boolean", "boolean", "orders", "o_orderkey", lambda: _words(), lambda: (_k() % 3 == 0), "select o_orderkey, (o_orderkey % 8 < 4) = (o_orderkey % 3 = 0) agree from orders")
_agree("k2b_decimal", "decimal", "orders", "o_orderkey", lambda: F.concat(F.lit("+00"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("0")), lambda: F.col("o_totalprice").cast("decimal(20,4)") + F.when(_k() % 9 == 0, 1).otherwise(0), "select o_orderkey, o_orderkey % 9 <> 0 agree from orders")
_agree("k2c_double", "double", "orders", "o_orderkey", lambda: F.col("o_totalprice"), lambda: F.col("o_totalprice") * F.when(_k() % 9 == 0, 1.0 + 1e-9).otherwise(1.0 + 1e-15), "select o_orderkey, o_orderkey % 9 <> 0 agree from orders")
_agree("k2c_float", "float", "orders", "o_orderkey", lambda: F.col("o_totalprice"), lambda: F.col("o_totalprice") * F.when(_k() % 9 == 0, 1.00001).otherwise(1.0 + 1e-9), "select o_orderkey, o_orderkey % 9 <> 0 agree from orders")
_agree("k2d_instant", "timestamp", "events", "event_id", lambda: F.col("ts"), lambda: F.date_trunc("MILLISECOND", "ts"), "select event_id, microsecond(ts) % 1000 = 0 agree from events")
_agree("k2d_instant_millis", "timestamp", "events", "event_id", lambda: F.col("ts"), lambda: F.date_trunc("MILLISECOND", "ts"), "select event_id, true agree from events", True)
_agree("k2e_date", "date", "orders", "o_orderkey", lambda: F.col("o_orderdate"), lambda: F.date_add(F.to_date("o_orderdate"), F.when(_k() % 4 == 0, 1).otherwise(0)), "select o_orderkey, o_orderkey % 4 <> 0 agree from orders")
_agree("k2e_time", "time", "orders", "o_orderkey", lambda: F.lit("10:20"), lambda: F.when(_k() % 4 == 0, "10:20:01").otherwise("10:20:00.000"), "select o_orderkey, o_orderkey % 4 <> 0 agree from orders")
_agree("k2f_json", "json", "events", "event_id", lambda: F.concat(F.lit('{"a": 1, "p": '), "props", F.lit("}")), lambda: F.when(F.col("event_id") % 4 == 0, F.lit('{"a":2}')).otherwise(F.concat(F.lit('{"p":'), "props", F.lit(',"a":1}'))), "select event_id, event_id % 4 <> 0 agree from events")
_agree("k2g_uuid", "uuid", "orders", "o_orderkey", lambda: F.upper(F.sha2(_k().cast("string"), 256)), lambda: F.sha2((_k() + F.when(_k() % 4 == 0, 1).otherwise(0)).cast("string"), 256), "select o_orderkey, o_orderkey % 4 <> 0 agree from orders")
_agree("k2g_char", "char", "part", "p_partkey", lambda: F.rpad("p_type", 20, " "), lambda: F.when(F.col("p_partkey") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_type")), "select p_partkey, p_partkey % 4 <> 0 agree from part")
_agree("k2h_unknown", "unknown", "orders", "o_orderkey", lambda: F.concat(_k().cast("string"), F.lit(".0")), lambda: F.when(_k() % 4 == 0, F.lit("x")).otherwise(_k().cast("string")), "select o_orderkey, o_orderkey % 4 <> 0 agree from orders")


@plan("k3_diff_row", "select o_orderkey, list_filter([case when o_orderkey % 4 = 0 then 'o_totalprice' end, case when o_orderkey % 6 = 0 then 'o_orderstatus' end], lambda x: x is not null) cols from orders")
def k3(t: Tables):
    o = t("orders")
    cells = []
    for c, other in (("o_totalprice", F.col("o_totalprice") + F.when(_k() % 4 == 0, 1.0).otherwise(0.0)), ("o_orderstatus", F.when(_k() % 6 == 0, "?").otherwise(F.col("o_orderstatus")))):
        kind = "double" if c == "o_totalprice" else "text"
        cells.append((c, same(F.col(c), other, o.schema[c].dataType, o.schema[c].dataType, kind), F.col(c), other))
    return o.select("o_orderkey", F.transform(diff_row(cells), lambda d: d["column"]).alias("cols"))


@plan("w15_payload_sink", "select o_orderkey as sequence, sha256('job7:' || o_orderkey) idempotency_key, '{\"s\":\"' || o_orderstatus || '\"}' body from orders")
def w15(t: Tables):
    return ex.payload_sink(t("orders").select(F.col("o_orderkey").alias("sequence"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("body")), "job7")


@plan("w16_backup_restore_json", "select event_id, " + TS.format(c="ts") + " ts, user_id, event_type, value, props from events")
def w16(t: Tables):
    path = folder(t.spark, "backup")
    e = t("events")
    ex.backup_json({"events": e}, path)
    return restore_json(t.spark, f"{path}/events", e.schema).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@plan("s13_restore_json", "select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderstatus end o_orderstatus, case when o_orderkey % 4 <> 0 then o_totalprice end o_totalprice from orders where o_orderkey % 5 <> 0")
def s13(t: Tables):
    """A dump with lines cut off, fields that lack and values of another kind."""
    path = folder(t.spark, "dump")
    k = F.col("o_orderkey")
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.when(k % 3 != 0, F.concat(F.lit(', "o_orderstatus": "'), "o_orderstatus", F.lit('"'))).otherwise("")
    price = F.when(k % 4 != 0, F.col("o_totalprice").cast("string")).otherwise('"much"')
    line = F.concat(F.lit('{"o_orderkey": {"$bigint": "'), k.cast("string"), F.lit('"}'), status, F.lit(', "o_totalprice": '), price, F.lit("}"))
    o.select(F.when(k % 5 != 0, line).otherwise(F.left(line, F.lit(20))).alias("value")).write.text(path)
    return restore_json(t.spark, path, o.schema)


@plan(
    "w17_backup_sql",
    """select 'INSERT INTO "customer" ("c_custkey", "c_name", "c_acctbal") VALUES (' || c_custkey || ', ''' || replace(c_name, '#', '''''') || ''', ' || case when c_custkey % 4 = 0 then 'NULL' when c_acctbal = trunc(c_acctbal) then c_acctbal::bigint::varchar else c_acctbal::varchar end || ');' as value from customer""",
)
def w17(t: Tables):
    path = folder(t.spark, "sql")
    c = t("customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("'")).alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    ex.backup_sql({"customer": c}, {"customer": ["c_custkey"]}, path)
    return t.spark.read.text(f"{path}/customer.dml")


@plan(
    "w17_backup_ddl",
    """select s as value from (select unnest(['CREATE TABLE "supplier" ("s_suppkey" BIGINT, "s_name" TEXT, "s_acctbal" DOUBLE PRECISION, PRIMARY KEY ("s_suppkey"));',
'CREATE TABLE `supplier` (`s_suppkey` BIGINT, `s_name` LONGTEXT, `s_acctbal` DOUBLE, PRIMARY KEY (`s_suppkey`));', 'CREATE TABLE "supplier" ("s_suppkey" INTEGER, "s_name" TEXT, "s_acctbal" REAL, PRIMARY KEY ("s_suppkey"));']) s)
union all select 'INSERT INTO `supplier` (`s_suppkey`, `s_name`, `s_acctbal`) VALUES (' || s_suppkey || ', ''' || s_name || ''', ' || case when s_acctbal = trunc(s_acctbal) then s_acctbal::bigint::varchar else s_acctbal::varchar end || ');' from supplier""",
)
def w17b(t: Tables):
    """Definitions in three dialects, and the rows of one."""
    s, texts = t("supplier").select("s_suppkey", "s_name", "s_acctbal"), []
    for dialect in ("postgres", "mysql", "sqlite"):
        path = folder(t.spark, dialect)
        ex.backup_sql({"supplier": s}, {"supplier": ["s_suppkey"]}, path, dialect)
        texts += [f"{path}/supplier.ddl"] + [f"{path}/supplier.dml"] * (dialect == "mysql")
    return t.spark.read.text(texts)


@plan("w18_csv_line", """select page_id || ',' || case when regexp_matches(html, '[",\r\n]') then '"' || replace(html, '"', '""') || '"' else html end as line from pages""")
def w18(t: Tables):
    p = t("pages").select("page_id", "html")
    return p.select(ex.csv_line(p).alias("line"))


@plan("w18_export_csv", "select n_nationkey, n_name from nation")
def w18b(t: Tables):
    path = folder(t.spark, "csv")
    ex.export_csv(t("nation").select("n_nationkey", "n_name"), path)
    return t.spark.read.schema("n_nationkey int, n_name string").option("header", True).option("escape", '"').csv(path)


@plan("w19_csv_safe", "select p_partkey, case p_partkey % 4 when 0 then '''=' || p_name when 1 then '''@' || p_name when 2 then '''-' || p_name else p_name end cell from part")
def w19(t: Tables):
    k = F.col("p_partkey") % 4
    return t("part").select("p_partkey", ex.csv_safe(F.concat(F.when(k == 0, "=").when(k == 1, "@").when(k == 2, "-").otherwise(""), "p_name")).alias("cell"))


@plan("w20_capture_body", "select doc_id, left(text, 16384) body, length(text) > 16384 truncated from documents")
def w20(t: Tables):
    body, cut = ex.capture_body(F.col("text"))
    return t("documents").select("doc_id", body.alias("body"), cut.alias("truncated"))


def observed(t: Tables):
    """Columns and types that two cuts of ``events.props`` show; the later one is retyped and has a new field."""
    e = t("events")
    early = infer_document_schema(e.where("event_id % 2 = 0").withColumn("j", F.concat(F.lit('{"old": 1, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))), "j")
    late = infer_document_schema(e.where("event_id % 2 = 1").withColumn("j", F.concat(F.lit('{"k": "x'), F.get_json_object("props", "$.k"), F.lit('", "new": true}'))), "j")
    name = lambda d: d.select(F.lit("events").alias("table"), F.col("field").alias("column"), F.col("type"))
    return name(early), name(late)


# the fields of both cuts with their types, and what differs
_DRIFT = """with e as (select event_id, json_extract_string(props, '$.k') k from events where json_extract_string(props, '$.k') is not null),
cells as (select 0 late, 'old' field, '1' w from e where event_id % 2 = 0 union all select 0, 'k', k from e where event_id % 2 = 0
union all select 1, 'k', 'x' || k from e where event_id % 2 = 1 union all select 1, 'new', 'true' from e where event_id % 2 = 1),
typed as (select late, field, case when regexp_full_match(w, '-?[0-9]{1,9}') then 'int' when regexp_full_match(w, '-?[0-9]{10,18}') then 'long' when regexp_full_match(w, '-?[0-9]+') then 'decimal'
when regexp_full_match(w, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') then 'double' when w in ('true', 'false') then 'boolean' else 'string' end t from cells),
kinds as (select late, field, case when count(distinct t) = 1 then min(t) when bool_and(t in ('int', 'long', 'double', 'decimal')) then (['int', 'long', 'double', 'decimal'])[max(list_position(['int', 'long', 'double', 'decimal'], t))] else 'mixed' end t from typed group by 1, 2),
d as (select 'events' as "table", coalesce(a.field, b.field) as "column", case when a.field is null then 'added' when b.field is null then 'removed' else 'retyped' end as change, a.t as before, b.t as after
from (select * from kinds where late = 0) a full outer join (select * from kinds where late = 1) b on a.field = b.field where a.t is distinct from b.t)
"""


@plan("x1_drift", _DRIFT + "select * from d")
def x1(t: Tables):
    return dr.drift(*observed(t))


@plan("x2_missing_used", _DRIFT + """select * from d where change = 'removed' and "column" in ('old', 'k')""")
def x2(t: Tables):
    used = t.spark.createDataFrame([("events", "old"), ("events", "k")], "table string, column string")
    return dr.missing_used(dr.drift(*observed(t)), used)


@plan("x2_nulled_values", "select c_custkey from customer where c_custkey % 4 = 0 and c_custkey % 3 <> 0")
def x2b(t: Tables):
    c = t("customer")
    rows = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    target = c.withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return dr.nulled_values(rows, target, ["c_custkey"], "c_name").select("c_custkey")


@plan(
    "x3_verdict",
    _DRIFT
    + """, seen as (select p.t, p.policy, count(d.change) n, count(*) filter (where d.change = 'removed' and d."column" = 'old') lost,
coalesce(list(d."column" order by d."column") filter (where d.change = 'added'), []) added
from (values ('events', 'evolve'), ('other', 'stop')) p(t, policy) left join d on d."table" = p.t group by 1, 2),
v as (select *, case when n = 0 then 'go' when lost > 0 or policy = 'stop' then 'stop' else 'go' end verdict from seen)
select t as "table", verdict, case when verdict = 'go' and policy = 'evolve' then added else [] end add_columns, lost = 0 as can_accept from v""",
)
def x3(t: Tables):
    used = t.spark.createDataFrame([("events", "old")], "table string, column string")
    policies = t.spark.createDataFrame([("events", "evolve", False, True), ("other", "stop", False, True)], "table string, policy string, mapped boolean, creatable boolean")
    return dr.verdict(dr.drift(*observed(t)), used, policies)


@plan("x4_describe", _DRIFT + """, parts as (select "table", change || ' ' || "column" || case when change = 'retyped' then ' (' || before || ' -> ' || after || ')' else '' end as part from d)
select "table", string_agg(part, ', ' order by part) as line from parts group by 1""")
def x4(t: Tables):
    return dr.describe(dr.drift(*observed(t)))
