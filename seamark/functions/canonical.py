"""One spelling for each value, by kind; keys and comparisons build on it.

Kinds: boolean, integer, decimal, float, double, timestamp, date, time, json,
array, bytes, uuid, char, text, unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are read as a boolean.
TRUE = ("1", "t", "true", "y", "yes", "on")
FALSE = ("0", "f", "false", "n", "no", "off")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if isinstance(t, T.FloatType):
        return "float"
    if isinstance(t, T.DoubleType):
        return "double"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return "json"
    return "text"


def number_text(c: Column) -> Column:
    """Canonical digits: no leading plus or zeros, no trailing fraction zeros, no exponent, ``-0`` is ``0``; other text is NULL."""
    s = F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r"))  # what NUMBER passes over
    plain = F.when(s.rlike("[eE]"), s.try_cast("decimal(38,12)").cast("string")).otherwise(s)
    # each step reads the one before once: an expression named twice is evaluated twice
    out = F.regexp_replace(plain, r"^\+", "")
    out = F.regexp_replace(out, r"^(-?)0*(?=\d|\.|$)", "$1")  # leading zeros, all of them
    out = F.regexp_replace(out, r"(\.\d*?)0+$", "$1")
    out = F.regexp_replace(out, r"\.$", "")
    out = F.regexp_replace(out, r"^(-?)(?=\.|$)", "$10")
    return F.when(s.rlike(NUMBER), F.regexp_replace(out, "^-0$", "0"))


def boolean_of(c: Column, t: T.DataType) -> Column:
    """true, false or NULL from any reading of a boolean, one byte of binary included."""
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, T.BinaryType):
        return F.when(F.hex(c) == "01", True).when(F.hex(c) == "00", False)
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def instant_text(c: Column, t: T.DataType) -> Column:
    """An instant or wall clock with microseconds; text is read first."""
    if isinstance(t, T.StringType):
        c = F.regexp_replace(F.regexp_replace(F.trim(c), "Z$", ""), "T", " ").try_cast("timestamp_ntz")
    return F.date_format(c, MICROS)


def date_text(c: Column) -> Column:
    return F.regexp_extract(c.cast("string"), r"^(\d{4}-\d{2}-\d{2})", 1)


def time_text(c: Column) -> Column:
    """``HH:mm:ss`` and its fraction without trailing zeros; missing seconds are 00."""
    s = F.trim(c.cast("string"))
    full = F.when(s.rlike(r"^\d{2}:\d{2}$"), F.concat(s, F.lit(":00"))).otherwise(s)
    return F.when(full.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.regexp_replace(F.regexp_replace(full, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def json_text(c: Column, t: T.DataType) -> Column:
    """JSON with sorted keys; text is parsed, or kept where it is not JSON."""
    if isinstance(t, T.StringType):
        return F.coalesce(F.try_parse_json(c).cast("string"), c)
    if isinstance(t, T.VariantType):
        return c.cast("string")
    return F.try_parse_json(F.to_json(c)).cast("string")


def canonical(c: Column, t: T.DataType, kind: str | None = None) -> Column:
    kind = kind or kind_of(t)
    if kind == "boolean":
        return boolean_of(c, t).cast("string")
    if kind in ("integer", "decimal"):
        if isinstance(t, T.IntegralType):  # its text is canonical
            return c.cast("string")
        return F.coalesce(number_text(c), c.cast("string"))
    if kind in ("float", "double"):
        d = c.try_cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    if kind == "timestamp":
        return F.coalesce(instant_text(c, t), c.cast("string"))
    if kind == "date":
        return date_text(c)
    if kind == "time":
        return F.coalesce(time_text(c), c.cast("string"))
    if kind in ("json", "array"):
        return json_text(c, t)
    if kind == "bytes":
        return F.lower(F.hex(c))
    if kind == "uuid":
        return F.lower(c.cast("string"))
    if kind == "char":
        return F.rtrim(c.cast("string"))
    return c.cast("string")


def key_text(columns: list[str], schema: T.StructType, kinds: dict[str, str] | None = None) -> Column:
    """One string for a key: a JSON array of canonical values, NULL kept apart from text."""
    kinds = kinds or {}
    parts = [canonical(F.col(f"`{c}`"), schema[c].dataType, kinds.get(c)) for c in columns]
    return F.to_json(F.array(*parts))


def near(a: Column, b: Column, digits: int) -> Column:
    """Equal within a relative 10**-digits; NaN equals NaN, infinities only themselves."""
    x, y = a.try_cast("double"), b.try_cast("double")
    close = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * F.lit(10.0**-digits)
    return F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise((x == y) | F.coalesce(close & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), F.lit(False)))


def same(a: Column, b: Column, ta: T.DataType, tb: T.DataType, kind: str, millis: bool = False) -> Column:
    """Do two readings of one value agree, by its kind? NULL agrees with NULL only.

    Values of one type are compared as they are; texts are built only where the types differ.
    """
    if _plain(ta, tb, kind, millis):
        return a.eqNullSafe(b)
    if kind == "float":
        agree = near(a, b, 6)
    elif kind == "double":
        agree = near(a, b, 14)
    elif kind == "timestamp" and millis:  # one side holds milliseconds only
        agree = F.substring(instant_text(a, ta), 1, 23) == F.substring(instant_text(b, tb), 1, 23)
    elif kind == "unknown":
        x, y = a.cast("string"), b.cast("string")
        numbers, times = number_text(a) == number_text(b), instant_text(x, T.StringType()) == instant_text(y, T.StringType())
        agree = F.coalesce(numbers, times, x == y) | (x == y)
    else:
        agree = canonical(a, ta, kind) == canonical(b, tb, kind)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(agree, F.lit(False)))


def _plain(ta: T.DataType, tb: T.DataType, kind: str, millis: bool) -> bool:
    exact = (T.IntegralType, T.DecimalType)
    if kind in ("integer", "decimal"):
        return isinstance(ta, exact) and isinstance(tb, exact)
    if ta != tb:
        return False
    kinds = {"boolean": T.BooleanType, "text": T.StringType, "date": T.DateType, "bytes": T.BinaryType, "timestamp": (T.TimestampType, T.TimestampNTZType)}
    return kind in kinds and isinstance(ta, kinds[kind]) and not millis


def diff_row(columns: list[tuple[str, Column, Column, Column]]) -> Column:
    """``array<struct<column, expected, actual>>`` of columns that differ: (name, agree, expected, actual)."""
    cells = [F.when(~ok, F.struct(F.lit(n).alias("column"), e.cast("string").alias("expected"), a.cast("string").alias("actual"))) for n, ok, e, a in columns]
    return F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column:string,expected:string,actual:string>>")


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
