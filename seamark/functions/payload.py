"""Payloads: JSON templates, batches of bodies, and rows of a key-value target."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shaping import TOKEN, text_of


def _quoted(c: Column) -> Column:
    """A JSON string literal: ``to_json`` of a one-element array without its brackets."""
    j = F.to_json(F.array(c.cast("string")))
    return F.substring(j, 2, 1 << 30).substr(F.lit(1), F.length(j) - 2)


def _value(c: Column, t: T.DataType) -> Column:
    """A column as JSON text of its own type, NULL as ``null``."""
    if isinstance(t, T.BooleanType) or isinstance(t, T.NumericType):
        out = text_of(c, t)
    elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(t, T.VariantType):
        out = c.cast("string")
    else:
        out = _quoted(text_of(c, t))
    return F.coalesce(out, F.lit("null"))


def render_payload(df: DataFrame, template: Any, table: str = "", now: str = "", op: str = "", index: Column | None = None) -> tuple[Column, list[str]]:
    """The template (parsed JSON) as a JSON text column, and its unknown tokens.

    A string that is one token keeps the value's type; a token inside text, or
    in a key, is text. Tokens: a column, ``$row``, ``$table``, ``$now``,
    ``$index``, ``$op``. An unknown token is null, or empty within text.
    """
    unknown: list[str] = []
    fixed = {"$table": table, "$now": now, "$op": op}

    def typed(name: str) -> Column:
        if name in fixed:
            return F.lit(json.dumps(fixed[name]))
        if name == "$index":
            return (index if index is not None else F.lit(0)).cast("string")
        if name == "$row":
            return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        if name in df.columns:
            return _value(F.col(f"`{name}`"), df.schema[name].dataType)
        unknown.append(name)
        return F.lit("null")

    def plain(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        if name in df.columns:
            return F.coalesce(text_of(F.col(f"`{name}`"), df.schema[name].dataType), F.lit(""))
        if name in ("$index", "$row"):
            return typed(name)
        unknown.append(name)
        return F.lit("")

    def text(s: str) -> Column:
        pieces = TOKEN.split(s)
        if len(pieces) == 1:
            return F.lit(json.dumps(s, ensure_ascii=False))
        return _quoted(F.concat(*[plain(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]))

    def render(x: Any) -> Column:
        if isinstance(x, dict):
            parts: list[Column] = [F.lit("{")]
            for i, (k, v) in enumerate(x.items()):
                parts += [F.lit("," if i else ""), text(k), F.lit(":"), render(v)]
            return F.concat(*parts, F.lit("}"))
        if isinstance(x, list):
            parts = [F.lit("[")]
            for i, v in enumerate(x):
                parts += [F.lit("," if i else ""), render(v)]
            return F.concat(*parts, F.lit("]"))
        if isinstance(x, str):
            lone = TOKEN.fullmatch(x)
            return typed(lone[1]) if lone else text(x)
        return F.lit(json.dumps(x))

    return render(template), unknown


def render_batches(rows: DataFrame, body: str, index: str, size: int, wrap_key: str | None = None) -> DataFrame:
    """Bodies of ``size`` rows each, as one JSON array: ``sequence, n_rows, body``. A batch is bounded by its size."""
    g = rows.groupBy(F.floor(F.col(index) / size).alias("sequence")).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(body).alias("b")))).alias("x"))
    array = F.concat(F.lit("["), F.concat_ws(",", F.transform("x", lambda v: v["b"])), F.lit("]"))
    if wrap_key:
        array = F.concat(F.lit("{" + json.dumps(wrap_key) + ":"), array, F.lit("}"))
    return g.select("sequence", F.size("x").alias("n_rows"), array.alias("body"))


def render_key(df: DataFrame, template: str) -> tuple[Column, Column]:
    """The key text of a row, and the columns missing or empty in it (an array; a row with any is bad)."""
    pieces = TOKEN.split(template)
    names = pieces[1::2]
    values = {n: text_of(F.col(f"`{n}`"), df.schema[n].dataType) if n in df.columns else F.lit(None).cast("string") for n in names}
    missing = F.array_compact(F.array(*[F.when(F.coalesce(values[n], F.lit("")) == "", F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]), missing


def to_key_hash(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Fields to set, as text (a map), and fields to remove because they are NULL."""
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("k"), text_of(F.col(f"`{c}`"), df.schema[c].dataType).alias("v"))) for c in columns]
    unset = [F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in columns]
    return F.map_from_entries(F.array_compact(F.array(*pairs))), F.array_compact(F.array(*unset))


def to_key_json(df: DataFrame, columns: list[str]) -> Column:
    """The row as one JSON document: bytes base64, whole numbers as digits, NULL kept."""
    parts: list[Column] = [F.lit("{")]
    for i, c in enumerate(columns):
        parts += [F.lit(("," if i else "") + json.dumps(c) + ":"), _value(F.col(f"`{c}`"), df.schema[c].dataType)]
    return F.concat(*parts, F.lit("}"))


def to_key_string(df: DataFrame, column: str) -> Column:
    return text_of(F.col(f"`{column}`"), df.schema[column].dataType)


def apply_key_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Key-value rows ``key, kind, text, fields, ttl`` after an upsert of ``rows`` (the same and ``unset``).

    A string or document replaces the value; a hash sets its fields, removes the
    unset ones and keeps the others. A NULL ttl makes the key persist. The last
    row of a key must have been chosen before (one row for each key).
    """
    j = target.alias("t").join(rows.alias("r"), "key", "full_outer")
    kept = F.map_filter(F.coalesce(F.col("t.fields"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.coalesce(F.col("r.unset"), F.array().cast("array<string>")), k) & ~F.map_contains_key(F.col("r.fields"), k))
    fields = F.when(F.col("r.kind") == "hash", F.when(F.col("t.kind") == "hash", F.map_concat(kept, "r.fields")).otherwise(F.col("r.fields"))).when(F.col("r.kind").isNull(), F.col("t.fields"))
    touched = F.col("r.kind").isNotNull()
    return j.select("key", F.coalesce("r.kind", "t.kind").alias("kind"), F.when(touched, F.col("r.text")).otherwise(F.col("t.text")).alias("text"), fields.alias("fields"), F.when(touched, F.col("r.ttl")).otherwise(F.col("t.ttl")).alias("ttl"))
