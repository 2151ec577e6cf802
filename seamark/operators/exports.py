"""Dumps and exports: portable JSON, SQL text, CSV and captured bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import encode_row
from ..functions.shaping import text_of

CAPTURE = 16_384


def backup_json(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON-lines folder for each table, rows tagged losslessly, and a manifest; the driver holds no rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.select(encode_row(df).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    rows = [(n, df.schema.json()) for n, df in tables.items()]
    spark.createDataFrame(rows, "table string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def literal(c: Column, t: T.DataType, dialect: str = "postgres") -> Column:
    """A value as SQL text in a dialect."""
    if isinstance(t, T.BooleanType):
        out = F.when(c, "TRUE").otherwise("FALSE") if dialect == "postgres" else F.when(c, "1").otherwise("0")
    elif isinstance(t, T.NumericType):
        out = text_of(c, t)
    elif isinstance(t, T.BinaryType):
        h = F.lower(F.hex(c))
        out = F.concat(F.lit("'\\x" if dialect == "postgres" else "X'"), h, F.lit("'"))
    else:
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else c.cast("string") if isinstance(t, T.DateType) else text_of(c, t)
        if dialect == "mysql":
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        out = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(out)


def _quote(name: str, dialect: str) -> str:
    q = "`" if dialect == "mysql" else '"'
    return q + name.replace(q, q + q) + q


def insert_statements(df: DataFrame, table: str, dialect: str = "postgres") -> Column:
    names = ", ".join(_quote(c, dialect) for c in df.columns)
    values = F.concat_ws(", ", *[literal(F.col(f"`{f.name}`"), f.dataType, dialect) for f in df.schema.fields])
    return F.concat(F.lit(f"INSERT INTO {_quote(table, dialect)} ({names}) VALUES ("), values, F.lit(");"))


#: Column types of each dialect's CREATE TABLE; "json" is what holds arrays, maps and structs, "key" a text that stands in a key.
SQL_TYPES = {
    "postgres": {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "SMALLINT", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "string": "TEXT", "key": "TEXT", "binary": "BYTEA", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP", "json": "JSONB", "decimal": "NUMERIC"},
    "mysql": {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "TINYINT(1)", "string": "LONGTEXT", "key": "VARCHAR(255)", "binary": "LONGBLOB", "date": "DATE", "timestamp": "TIMESTAMP(6)", "timestamp_ntz": "DATETIME(6)", "json": "JSON", "decimal": "DECIMAL"},
    "sqlite": {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER", "string": "TEXT", "key": "TEXT", "binary": "BLOB", "date": "TEXT", "timestamp": "TEXT", "timestamp_ntz": "TEXT", "json": "TEXT", "decimal": "NUMERIC"},
}


def column_type(t: T.DataType, dialect: str, in_key: bool = False) -> str:
    types = SQL_TYPES[dialect]
    if isinstance(t, T.DecimalType):
        return f"{types['decimal']}({t.precision},{t.scale})"
    name = t.simpleString()
    return types["key"] if name == "string" and in_key else types.get(name, types["json"])


def create_statement(df: DataFrame, table: str, keys: list[str] = (), dialect: str = "postgres") -> str:
    """CREATE TABLE in the words and quotes of the dialect whose INSERTs follow."""
    cols = [f"{_quote(f.name, dialect)} {column_type(f.dataType, dialect, f.name in keys)}" for f in df.schema.fields]
    if keys:
        cols.append(f"PRIMARY KEY ({', '.join(_quote(k, dialect) for k in keys)})")
    return f"CREATE TABLE {_quote(table, dialect)} ({', '.join(cols)});"


def backup_sql(tables: dict[str, DataFrame], keys: dict[str, list[str]], path: str, dialect: str = "postgres") -> None:
    """DDL and INSERT text; rows in key order by ranges, not through one task."""
    for name, df in tables.items():
        spark = df.sparkSession
        spark.createDataFrame([(create_statement(df, name, keys.get(name, []), dialect),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.ddl")
        rows = df.orderBy(*keys[name]) if keys.get(name) else df
        rows.select(insert_statements(df, name, dialect).alias("value")).write.mode("overwrite").text(f"{path}/{name}.dml")


def csv_cell(c: Column, t: T.DataType) -> Column:
    """RFC 4180: quoted where a comma, quote or line end stands; NULL is empty; objects are JSON."""
    s = text_of(c, t)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[",\r\n]'), quoted).otherwise(s), F.lit(""))


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet would run gets an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_csv(df: DataFrame, path: str) -> None:
    flat = df.select(*[text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def capture_body(body: Column, limit: int = CAPTURE) -> tuple[Column, Column]:
    """What was sent, cut at ``limit`` characters, and whether it was cut (then it cannot be sent again faithfully)."""
    return F.substring(body, 1, limit), F.length(body) > limit


def payload_sink(batches: DataFrame, job: str) -> DataFrame:
    """Request bodies with an idempotency key of job and sequence: ``idempotency_key, sequence, body``."""
    key = F.sha2(F.concat(F.lit(f"{job}:"), F.col("sequence").cast("string")), 256)
    return batches.select(key.alias("idempotency_key"), "sequence", "body")
