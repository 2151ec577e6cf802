"""Filters compiled to one boolean column (no UDF, so scans can push them down)."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")


@dataclass(frozen=True)
class Filter:
    """``op``: eq neq lt lte gt gte contains startsWith endsWith isNull notNull in."""

    column: str
    op: str
    value: Any = None


_ORDER = {"eq": Column.__eq__, "neq": Column.__ne__, "lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}


def _instant(value: Any) -> dt.datetime | None:
    if isinstance(value, dt.datetime):
        return value
    try:
        return dt.datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None


def _compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """The literal is aligned to the column's type here, on the driver: numbers by value, times by instant, else as text."""
    f = _ORDER[op]
    numeric = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) or isinstance(value, str) and bool(NUMBER.match(value))
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool) or str(value).lower() in ("true", "false"):
            return f(c, F.lit(str(value).lower() == "true"))
    elif isinstance(kind, T.NumericType):
        if numeric:
            text = str(value).strip()
            whole = isinstance(kind, T.IntegralType) and re.fullmatch(r"[+-]?\d{1,18}", text)
            return f(c, F.lit(int(text)) if whole else F.lit(float(text)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(Decimal(text)))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = _instant(value)
        if at is not None:
            return f(c, F.lit(str(at)).cast(kind))
    elif numeric:
        v = F.lit(float(str(value)))
        return F.coalesce(f(c.try_cast("double"), v), f(c, F.lit(str(value))))
    return f(c.cast("string"), F.lit(str(value)))


def one(f: Filter, schema: T.StructType) -> Column:
    """A single filter. A NULL never matches, but for ``isNull``; text is matched literally, without regard to case."""
    if f.column not in schema.names:  # a column that is not there counts as NULL
        return F.lit(f.op == "isNull")
    c, kind = F.col(f"`{f.column}`"), schema[f.column].dataType
    if f.op == "isNull":
        return c.isNull()
    if f.op == "notNull":
        return c.isNotNull()
    if f.op == "in":
        if not isinstance(f.value, (list, tuple, set)) or not f.value:
            return F.lit(False)
        return reduce(Column.__or__, [_compare(c, kind, "eq", v) for v in f.value])
    if f.op == "neq":
        return c.isNotNull() & _compare(c, kind, "neq", f.value)
    if f.op in _ORDER:
        return _compare(c, kind, f.op, f.value)
    text, part = F.lower(c.cast("string")), F.lower(F.lit(str(f.value)))
    if f.op == "contains":
        return F.contains(text, part)
    if f.op == "startsWith":
        return F.startswith(text, part)
    if f.op == "endsWith":
        return F.endswith(text, part)
    raise ValueError(f"no such filter: {f.op}")


def predicate(filters: list[Filter], schema: T.StructType) -> Column:
    """All filters ANDed; none: everything."""
    return reduce(Column.__and__, [one(f, schema) for f in filters], F.lit(True))


def change_predicate(filters: list[Filter], schema: T.StructType, absent: Column, deleted: Column, unchanged: Column) -> Column:
    """Filters on a change row: for a delete, a column absent from the image passes; an unchanged column passes."""
    parts = [(deleted & F.array_contains(absent, f.column)) | F.array_contains(unchanged, f.column) | F.coalesce(one(f, schema), F.lit(False)) for f in filters]
    return reduce(Column.__and__, parts, F.lit(True))


def lookup_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``: a semi-join on canonical key text, not an IN list."""
    from .canonical import key_text

    left = df.withColumn("_key", key_text(on, df.schema))
    return left.join(keys.select(key_text(on, keys.schema).alias("_key")), "_key", "left_semi").drop("_key")
