"""Value conversion between dialects, and an audit of what a target type would lose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import NUMBER, number_text

EXACT = 9007199254740991


def instant_mysql(c: Column) -> Column:
    """UTC wall clock with microseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def instant_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def instant_millis(c: Column) -> Column:
    """Cut to milliseconds, as document stores hold it; a wall clock is read as UTC."""
    return F.date_trunc("MILLISECOND", c)


def zero_date(c: Column) -> Column:
    """Dates with year 0000, month 00 or day 00 have no value elsewhere."""
    return F.when(~c.rlike(r"^0000|^\d{4}-00|^\d{4}-\d{2}-00"), c)


def boolean_from(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, T.BinaryType):
        return F.when(F.hex(c) == "01", True).when(F.hex(c) == "00", False)
    s = F.trim(c.cast("string"))
    return F.when(s == "1", True).when(s == "0", False)


def json_value(c: Column) -> Column:
    """Text of a store that keeps JSON as text, as structure; what is not JSON stays text."""
    quoted = F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(quoted.substr(F.lit(1), F.length(quoted) - 1)))


def exact_number(c: Column) -> Column:
    """Digits as a number where a double holds them exactly, else NULL (they stay text)."""
    return F.when(c.rlike(NUMBER) & (F.abs(c.try_cast("decimal(38,0)")) <= EXACT) & ~F.contains(c, F.lit(".")), c.try_cast("bigint"))


def bytes_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def convert_rows(df: DataFrame, source: str, target: str) -> DataFrame:
    """Each column in the form the target dialect takes; the same dialect is untouched.

    Dialects: postgres, mysql, sqlite, document, keyvalue.
    """
    if source == target:
        return df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = {"mysql": instant_mysql, "sqlite": instant_iso, "keyvalue": instant_iso, "document": instant_millis}.get(target, lambda x: x)(c)
        elif isinstance(f.dataType, T.BinaryType) and target in ("keyvalue",):
            c = bytes_hex(c)
        elif isinstance(f.dataType, T.BooleanType) and target in ("mysql", "sqlite"):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DecimalType) and target in ("sqlite", "document") and f.dataType.precision > 15:
            c = number_text(c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) and target in ("mysql", "sqlite", "keyvalue"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def encode_row(df: DataFrame) -> Column:
    """Lossless tagged JSON of a row: ``{"$bytes": base64}``, ``{"$date": instant}``, ``{"$bigint": digits}``; text that looks like a tag is ``{"$literal": ...}``."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.when(c.isNotNull(), F.struct(F.base64(c).alias("$bytes")))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.when(c.isNotNull(), F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("$date")))
        elif isinstance(f.dataType, T.LongType):
            c = F.when(c.isNotNull(), F.struct(c.cast("string").alias("$bigint")))
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def decode_row(json: Column, schema: T.StructType) -> list[Column]:
    """Columns of ``schema`` back from ``encode_row``'s text; what does not fit its column is null."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.BinaryType):
            c = F.try_to_binary(F.get_json_object(json, f"$['{f.name}']['$bytes']"), F.lit("base64"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.regexp_replace(F.get_json_object(json, f"$['{f.name}']['$date']"), "T", " ").try_cast(f.dataType)
        elif isinstance(f.dataType, T.LongType):
            c = F.get_json_object(json, f"$['{f.name}']['$bigint']").try_cast("bigint")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.from_json(F.get_json_object(json, f"$['{f.name}']"), f.dataType)
        else:
            c = F.get_json_object(json, f"$['{f.name}']").try_cast(f.dataType)
        out.append(c.alias(f.name))
    return out


@dataclass(frozen=True)
class Rule:
    """A loss: rows where ``test`` holds lose something in ``column``."""

    column: str
    loss: str
    test: Column


def digits_of(c: Column) -> Column:
    return F.length(F.regexp_replace(number_text(c), r"[^0-9]", ""))


def more_digits(c: Column, most: int) -> Column:
    """Has a number more than ``most`` digits? Text that is no longer has not, unless it has an exponent; only the rest is made canonical."""
    text = c.cast("string")
    return ((F.length(text) > most) | F.contains(text, F.lit("E"))) & (digits_of(c) > most)


def scale_of(c: Column) -> Column:
    n = number_text(c)
    return F.when(F.contains(n, F.lit(".")), F.length(F.substring_index(n, ".", -1))).otherwise(0)


def rules_for(target: str, schema: T.StructType, keys: list[str] = (), limits: dict[str, int] | None = None) -> list[Rule]:
    """What a target dialect cannot hold, as conditions on the values.

    ``limits`` gives the declared length of text columns in the target.
    """
    limits = limits or {}
    out: list[Rule] = []
    for f in schema.fields:
        c, t, n = F.col(f"`{f.name}`"), f.dataType, f.name
        text, number = isinstance(t, T.StringType), isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType))
        if target == "postgres":
            if text and n in limits:
                out.append(Rule(n, "length", F.length(c) > limits[n]))
            if text:
                out.append(Rule(n, "char padding", c != F.rtrim(c)))
        elif target == "mysql":
            if text:
                out.append(Rule(n, "length", F.length(c) > min(limits.get(n, 16_383), 255 if n in keys else 16_383)))
            if number:
                out.append(Rule(n, "digits", more_digits(c, 65)))
                out.append(Rule(n, "scale", scale_of(c) > 30))
            if isinstance(t, T.TimestampType):
                out.append(Rule(n, "zone", c.isNotNull()))
        elif target == "sqlite":
            if number:
                out.append(Rule(n, "digits", more_digits(c, 15)))
        elif target == "document":
            if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
                out.append(Rule(n, "fraction of second", c != F.date_trunc("MILLISECOND", c)))
        elif target == "spark":
            if text:
                out.append(Rule(n, "digits", c.rlike(NUMBER) & (F.length(F.regexp_replace(c, r"[^0-9]", "")) > 38)))
                out.append(Rule(n, "time as text", c.rlike(r"^\d{2}:\d{2}(:\d{2})?$")))
        else:
            raise ValueError(f"no such target: {target}")
    return out


def loss_audit(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``column, loss, n_values, example`` (the least value affected), for each rule, from one pass over the rows."""
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, loss string, n_values long, example string")
    aggs = []
    for i, r in enumerate(rules):
        aggs += [F.count_if(F.coalesce(r.test, F.lit(False))).alias(f"n{i}"), F.min(F.when(r.test, F.col(f"`{r.column}`").cast("string"))).alias(f"x{i}")]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(r.column).alias("column"), F.lit(r.loss).alias("loss"), F.col(f"n{i}").alias("n_values"), F.col(f"x{i}").alias("example")) for i, r in enumerate(rules)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
