"""Row shaping: an ordered list of steps, each seeing what the one before it left.

Steps become chained projections that Catalyst collapses. Two columns are
added: ``_errors`` (any makes the row bad) and ``_warnings``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import NUMBER

#: Words read as true and as false when a step casts to boolean.
TRUE = ("true", "t", "yes", "y", "1", "on")
FALSE = ("false", "f", "no", "n", "0", "off", "")
TOKEN = re.compile(r"\{\{\s*([$\w.]+)\s*\}\}")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@dataclass(frozen=True)
class Mask:
    column: str
    mode: str  # redact, partial, hash, null
    fill: str = "*"
    keep_start: int = 0
    keep_end: int = 0
    salt: str = ""


@dataclass(frozen=True)
class Cast:
    column: str
    to: str  # string, number, integer, boolean, date, json
    on_error: str = "fail"  # fail, null, keep


@dataclass(frozen=True)
class Text:
    column: str
    op: str  # trim, lower, upper


@dataclass(frozen=True)
class Default:
    column: str
    value: Any


@dataclass(frozen=True)
class Set:
    column: str
    template: str


Step = Mask | Cast | Text | Default | Set


def text_of(c: Column, t: T.DataType) -> Column:
    """A value as text: ISO instants, JSON for nested values, whole doubles without a fraction, base64 bytes."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, ISO)
    if isinstance(t, T.DateType):
        return F.concat(c.cast("string"), F.lit("T00:00:00.000Z"))
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def mask(c: Column, t: T.DataType, s: Mask) -> Column:
    s_text = text_of(c, t)
    if s.mode == "null":
        return F.lit(None).cast("string")
    if s.mode == "hash":
        out = F.sha2(F.concat(F.lit(s.salt), s_text), 256)
    elif s.mode == "redact":
        out = F.rpad(F.lit(""), 8, s.fill)
    else:
        n = F.length(s_text)
        hidden = F.greatest(n - F.lit(s.keep_start + s.keep_end), F.lit(0))
        part = F.concat(F.substring(s_text, 1, s.keep_start), F.rpad(F.lit(""), hidden, F.lit(s.fill)), s_text.substr(n - s.keep_end + 1, F.lit(s.keep_end)))
        out = F.when(hidden > 0, part).otherwise(F.rpad(F.lit(""), F.greatest(n, F.lit(1)), F.lit(s.fill)))
    return F.when(c.isNotNull(), out)


def cast(c: Column, t: T.DataType, to: str) -> Column:
    """The value as the wanted kind, NULL where that fails."""
    text = text_of(c, t)
    if to == "string":
        return text
    if to in ("number", "integer"):
        if isinstance(t, T.BooleanType):
            number = F.when(c, 1.0).otherwise(0.0)
            number = F.when(c.isNotNull(), number)
        else:
            clean = F.regexp_replace(text, r"^\s+|\s+$", "")
            number = F.when(clean.rlike(NUMBER), clean.try_cast("double"))
            number = F.when(F.abs(number) < float("inf"), number)
        if to == "number":
            return number
        if isinstance(t, T.IntegralType):
            return c.cast("bigint")
        whole = text.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        return F.coalesce(F.when(whole, F.trim(text).try_cast("bigint")), F.when(F.abs(number) < 9.2e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")))
    if to == "boolean":
        if isinstance(t, T.BooleanType):
            return c
        if isinstance(t, T.NumericType):
            return c != 0
        s = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
        return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)
    if to == "date":
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return text
        s = F.regexp_replace(text, r"^\s+|\s+$", "")
        n = F.when(s.rlike(NUMBER), s.try_cast("double"))
        millis = F.when(F.abs(n) < 1e11, n * 1000).otherwise(n)
        from_number = F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(millis) / 1000).cast("decimal(18,6)")), ISO)
        # a fixed list of forms: date, date and time, with T or a blank, with Z
        iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?Z?)?$"), F.regexp_replace(F.regexp_replace(s, "Z$", ""), "T", " "))
        return F.coalesce(from_number, F.date_format(iso.try_cast("timestamp_ntz"), ISO))
    if to == "json":
        return F.try_parse_json(text)
    raise ValueError(f"no such cast: {to}")


def edit(c: Column, op: str) -> Column:
    if op == "trim":
        return F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.lower(c) if op == "lower" else F.upper(c)


def template_value(template: str, df: DataFrame, table: str, now: str) -> tuple[Column, list[str]]:
    """A template over columns, ``$now`` and ``$table``; a lone token copies with its type. Also unknown tokens."""
    unknown: list[str] = []

    def token(name: str, as_text: bool) -> Column:
        if name == "$now":
            return F.lit(now)
        if name == "$table":
            return F.lit(table)
        if name in df.columns:
            c = F.col(f"`{name}`")
            return F.coalesce(text_of(c, df.schema[name].dataType), F.lit("")) if as_text else c
        unknown.append(name)
        return F.lit("")

    lone = TOKEN.fullmatch(template.strip())
    if lone:
        return token(lone[1], False), unknown
    pieces = TOKEN.split(template)
    return F.concat(*[token(p, True) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p or i % 2] or [F.lit("")]), unknown


def shape_rows(df: DataFrame, steps: list[Step], table: str = "", now: str = "1970-01-01T00:00:00.000Z", op_col: str | None = None) -> DataFrame:
    """``df`` after all steps, with ``_errors`` and ``_warnings`` (arrays of text).

    With ``op_col``, rows whose op is ``delete`` keep key semantics: masks,
    casts and text steps apply, defaults and computed columns do not.
    """
    errors: list[str] = []
    warnings: list[str] = []
    deleted = F.col(op_col) == "delete" if op_col else F.lit(False)

    def note(kind: list[str], c: Column) -> None:
        nonlocal df
        name = f"_{'e' if kind is errors else 'w'}{len(kind)}"
        kind.append(name)
        df = df.withColumn(name, c)

    for s in steps:
        present = s.column in df.columns
        if isinstance(s, (Mask, Cast, Text)) and not present:
            continue
        c = F.col(f"`{s.column}`") if present else F.lit(None)
        t = df.schema[s.column].dataType if present else T.NullType()
        if isinstance(s, Mask):
            df = df.withColumn(s.column, mask(c, t, s))
        elif isinstance(s, Text):
            if isinstance(t, T.StringType):
                df = df.withColumn(s.column, edit(c, s.op))
        elif isinstance(s, Cast):
            value = cast(c, t, s.to)
            bad = value.isNull() & c.isNotNull()
            message = F.when(bad, F.concat(F.lit(f"{s.column}: cannot read "), F.coalesce(text_of(c, t), F.lit("")), F.lit(f" as {s.to}")))
            note(errors if s.on_error == "fail" else warnings, message)
            if s.on_error == "keep":  # one column has one type: kept text makes it text
                typed = text_of(value, {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(s.to, T.StringType()))
                value = F.coalesce(typed, text_of(c, t))
            df = df.withColumn(s.column, value)
        elif isinstance(s, Default):
            filled = F.coalesce(c, F.lit(s.value)) if present else F.lit(s.value)
            df = df.withColumn(s.column, F.when(deleted, c).otherwise(filled) if op_col else filled)
        else:
            value, unknown = template_value(s.template, df, table, now)
            for u in unknown:
                note(warnings, F.lit(f"{s.column}: no such column {u}"))
            df = df.withColumn(s.column, F.when(deleted, c).otherwise(value) if op_col else value)

    def gather(names: list[str]) -> Column:
        return F.array_compact(F.array(*[F.col(n) for n in names])) if names else F.array().cast("array<string>")

    return df.withColumns({"_errors": gather(errors), "_warnings": gather(warnings)}).drop(*errors, *warnings)


def split_bad(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be written, and those with errors."""
    return shaped.where(F.size("_errors") == 0), shaped.where(F.size("_errors") > 0)


def volatile_columns(steps: list[Step]) -> set[str]:
    """Columns that depend on ``$now``, also through other computed columns; a comparison must leave them out."""
    out: set[str] = set()
    for s in steps:
        if isinstance(s, Set):
            used = set(TOKEN.findall(s.template))
            (out.add if "$now" in used or used & out else out.discard)(s.column)
    return out


def map_columns(df: DataFrame, mapping: dict[str, str], unchanged: str | None = None) -> DataFrame:
    """Pick and rename: {source: target}; empty keeps all; an absent source gives NULL. ``unchanged`` names are mapped too."""
    if not mapping:
        return df
    picked = [F.col(f"`{s}`").alias(t) if s in df.columns else F.lit(None).cast("string").alias(t) for s, t in mapping.items()]
    if unchanged and unchanged in df.columns:
        renamed = F.array_compact(F.array(*[F.when(F.array_contains(unchanged, s), F.lit(t)) for s, t in mapping.items()]))
        picked.append(renamed.alias(unchanged))
    return df.select(*picked)


def project_row(df: DataFrame, fields: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """A whitelist of fields, then renamed; empty whitelist keeps all."""
    rename = rename or {}
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in (fields or df.columns) if c in df.columns])
