"""Scans: whole tables, pages, snapshots in order, profiles and dumps."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicate import Filter, predicate
from ..functions.scratch import folder


def read_table(spark: SparkSession, path: str, filters: list[Filter] = (), sort: list[tuple[str, bool]] = (), fmt: str = "parquet", **options: str) -> DataFrame:
    """A whole relation with ANDed filters (pushed to the scan) and an optional order ``(column, ascending)``."""
    df = spark.read.format(fmt).options(**options).load(path) if fmt != "jdbc" else spark.read.format("jdbc").options(**options).load()
    df = df.where(predicate(list(filters), df.schema))
    return df.orderBy(*[F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in sort]) if sort else df


def read_query(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A saved statement over the given tables as a source."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def ad_hoc(spark: SparkSession, statement: str, tables: dict[str, DataFrame], cap: int = 5000) -> tuple[DataFrame, bool]:
    """Rows of a statement, at most ``cap``, and whether there were more (one row is probed)."""
    df = read_query(spark, statement, tables).limit(cap + 1)
    return df.limit(cap), df.count() > cap


def _orders(sort: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in sort]


def browse(df: DataFrame, filters: list[Filter], sort: list[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """One page with ``_total`` and ``_has_more``; the page is probed one row beyond its end, the total is an aggregate."""
    found = df.where(predicate(filters, df.schema))
    page = found.orderBy(*_orders(sort)).offset(offset).limit(limit + 1)
    total = found.agg(F.count("*").alias("_total"))
    return page.crossJoin(F.broadcast(total)).withColumn("_has_more", F.col("_total") > F.lit(offset + limit)).orderBy(*_orders(sort)).limit(limit)


def find(df: DataFrame, filters: list[Filter], sort: list[tuple[str, bool]], limit: int = 100) -> DataFrame:
    return df.where(predicate(filters, df.schema)).orderBy(*_orders(sort)).limit(limit)


def count_documents(df: DataFrame, filters: list[Filter]) -> DataFrame:
    return df.where(predicate(filters, df.schema)).agg(F.count("*").alias("count"))


def keyset_after(df: DataFrame, sort: list[tuple[str, bool]], values: list, limit: int) -> DataFrame:
    """Rows strictly after a tuple in an order of mixed directions; a NULL in the tuple is refused."""
    if any(v is None for v in values):
        raise ValueError("a keyset cannot continue after NULL")
    ors = []
    for i, (c, up) in enumerate(sort):
        equal = [F.col(f"`{n}`") == F.lit(v) for (n, _), v in zip(sort[:i], values, strict=False)]
        beyond = F.col(f"`{c}`") > F.lit(values[i]) if up else F.col(f"`{c}`") < F.lit(values[i])
        ors.append(reduce(Column.__and__, [*equal, beyond]))
    return df.where(reduce(Column.__or__, ors)).orderBy(*_orders(sort)).limit(limit)


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``n_rows, n_null_keys, n_surplus``: rows beyond the first of each key, and rows with a NULL in it."""
    null = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    g = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n"), F.max(null).alias("null"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n")).otherwise(0)), F.lit(0)).alias("n_null_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def resolve_order(df: DataFrame, sort: list[tuple[str, bool]], primary_key: list[str] = (), unique: list[list[str]] = ()) -> tuple[list[tuple[str, bool]], str | None]:
    """A total order for reading: caller's sort and key; the key; a unique set without NULLs; else all orderable columns, with a warning."""
    if primary_key:
        have = {c for c, _ in sort}
        return [*sort, *[(k, True) for k in primary_key if k not in have]], None
    for keys in unique:
        facts = uniqueness(df, keys).first()
        if not facts["n_surplus"] and not facts["n_null_keys"]:
            have = {c for c, _ in sort}
            return [*sort, *[(k, True) for k in keys if k not in have]], None
    orderable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    have = {c for c, _ in sort}
    return [*sort, *[(c, True) for c in orderable if c not in have]], "no key: rows that are alike in all columns cannot be told apart"


def chunked_snapshot(df: DataFrame, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """``df`` with a stable ``row_index`` in the given total order and ``sequence = row_index // size``.

    Rows are range-partitioned and sorted; one count for each partition gives
    the offsets, so no task sees the whole table. The dealt rows are written
    once to the shared folder: range bounds are sampled, so they must not be
    drawn again for the second read.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(width, *_orders(order)).sortWithinPartitions(*_orders(order)).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    path = folder(spark, "snapshot")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each partition
    starts = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    out = dealt.join(F.broadcast(starts), "_part").withColumn("row_index", F.col("_place") + F.col("_shift"))
    return out.withColumn("sequence", F.floor(F.col("row_index") / size)).drop("_part", "_place", "_shift")


def glob_regex(pattern: str) -> str:
    """Regex of a key pattern: ``*``, ``?``, ``[a-c]``, ``[^x]`` and ``\\`` before a literal."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out += f"[{'^' if negated else ''}{inner}]" if inner else ("." if negated else r"(?!)")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def key_glob(filters: list[Filter]) -> str:
    """One pattern that covers the filters on ``key``; other filters leave ``*``."""
    def quote(s: str) -> str:
        return re.sub(r"([*?\[\]\\^])", r"\\\1", s)

    for f in filters:
        if f.column == "key" and f.op in ("eq", "contains", "startsWith", "endsWith"):
            q = quote(str(f.value))
            return {"eq": q, "contains": f"*{q}*", "startsWith": f"{q}*", "endsWith": f"*{q}"}[f.op]
    return "*"


def read_keyspace(df: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Key-value rows whose key matches the pattern; a scan that repeats keys is deduplicated."""
    return df.where(F.col(key).rlike(glob_regex(pattern))).dropDuplicates([key])


def read_documents(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as ``_id string, doc variant``; ids become text, lines that are not JSON are left out."""
    doc = F.try_parse_json(F.col(column))
    df = lines.select(doc.alias("doc")).where(F.col("doc").isNotNull())
    oid = F.try_variant_get("doc", "$._id['$oid']", "string")
    return df.select(F.coalesce(oid, F.try_variant_get("doc", "$._id", "string")).alias("_id"), "doc")


#: Fixed order of numeric document types; a wider one holds the narrower.
_NUMBERS = ("int", "long", "double", "decimal")


def infer_document_schema(df: DataFrame, column: str) -> DataFrame:
    """``field, type, n_present, n_null`` of JSON objects in a text column, from all rows.

    Types merge: null under any; int under long under double under decimal;
    others that differ give ``mixed``.
    """
    raw = df.select(F.explode(F.map_entries(F.from_json(F.col(column), "map<string,string>"))).alias("e")).select(F.col("e.key").alias("field"), F.col("e.value").alias("w"))
    kind = (
        F.when(F.col("w").isNull(), "null")
        .when(F.col("w").rlike(r"^-?\d{1,9}$"), "int")
        .when(F.col("w").rlike(r"^-?\d{10,18}$"), "long")
        .when(F.col("w").rlike(r"^-?\d+$"), "decimal")
        .when(F.col("w").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double")
        .when(F.col("w").isin("true", "false"), "boolean")
        .when(F.startswith("w", F.lit("{")), "object")
        .when(F.startswith("w", F.lit("[")), "array")
        .otherwise("string")
    )
    g = raw.select("field", kind.alias("t")).groupBy("field").agg(F.collect_set(F.when(F.col("t") != "null", F.col("t"))).alias("ts"), F.count("*").alias("n_present"), F.count_if(F.col("t") == "null").alias("n_null"))
    widest = F.when(F.forall("ts", lambda t: t.isin(*_NUMBERS)), F.element_at(F.array(*map(F.lit, _NUMBERS)), F.array_max(F.transform("ts", lambda t: F.array_position(F.array(*map(F.lit, _NUMBERS)), t))).cast("int")))
    merged = F.when(F.size("ts") == 0, "null").when(F.size("ts") == 1, F.col("ts")[0]).otherwise(F.coalesce(widest, F.lit("mixed")))
    return g.select("field", merged.alias("type"), "n_present", "n_null")


def profile(name: str, df: DataFrame) -> DataFrame:
    """``table, column, type, n_rows, n_null, n_distinct`` of each column, from one aggregation."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"z{i}"), F.count_distinct(c).alias(f"d{i}")]
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), F.col(f"z{i}").alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.lit(name).alias("table"), F.explode(F.array(*cells)).alias("r")).select("table", "r.*")


def bulk_plan(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """``table, target, keys, skipped``: one copy for each table by its key; a table without one is skipped, with a reason."""
    rows = [(t, prefix + t, ",".join(keys.get(t, [])), None if keys.get(t) else "no primary key") for t in sorted(tables)]
    return spark.createDataFrame(rows, "table string, target string, keys string, skipped string")


def bulk_copy(tables: dict[str, DataFrame], keys: dict[str, list[str]], path: str, prefix: str = "", threads: int = 4) -> list[str]:
    """Copy each table that has a key to ``path/prefix+name``; the copies run side by side. Returns the targets."""
    todo = [t for t in sorted(tables) if keys.get(t)]

    def one(t: str) -> str:
        tables[t].write.mode("overwrite").parquet(f"{path}/{prefix}{t}")
        return prefix + t

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, todo))


def restore_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A portable dump (JSON lines of tagged rows) as a table of ``schema``.

    Fields that a line lacks, and values that do not fit their column, are null;
    lines that are not JSON objects are left out.
    """
    from ..functions.convert import decode_row

    lines = spark.read.text(path).where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit("")).startswith("OBJECT"))
    return lines.select(*decode_row(F.col("value"), schema))
