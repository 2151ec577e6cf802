"""Comparing two copies by the kind of value each column holds, and repairing what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import diff_row, key_text, kind_of, same
from .writes import delete_by_key, soft_delete, upsert

SAMPLES, SHORT = 25, 200


def expected_rows(source: DataFrame, steps: list, source_dialect: str, target_dialect: str, mapping: dict[str, str], now: str = "") -> DataFrame:
    """What the source would be written as: shaped, converted, mapped; rows with errors are left out."""
    from ..functions.convert import convert_rows
    from ..functions.shaping import map_columns, shape_rows, split_bad

    good, _ = split_bad(shape_rows(source, steps, now=now))
    return map_columns(convert_rows(good.drop("_errors", "_warnings"), source_dialect, target_dialect), mapping)


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], kinds: dict[str, str] | None = None, volatile: set[str] = frozenset(), mark: str | None = None, look_for_extra: bool = True) -> DataFrame:
    """``_k, class, diff`` for each key that is ``missing``, ``different`` or ``extra``, ``same`` included.

    One full outer join on canonical key text. Columns of the target alone,
    volatile columns and keys are not compared; rows marked as deleted do not
    count as extra.
    """
    if not keys:
        raise ValueError("copies without key columns cannot be compared")
    kinds = kinds or {}
    e = expected.withColumn("_k", key_text(keys, expected.schema, kinds)).withColumn("_e", F.lit(True))
    a = actual.withColumn("_k", key_text(keys, actual.schema, kinds)).withColumn("_a", F.lit(True))
    if mark:
        marked = F.coalesce(F.col(mark).cast("string"), F.lit("false")) != "false"
        a = a.withColumn("_marked", marked)
    j = e.alias("e").join(a.alias("a"), "_k", "full_outer")
    cells = []
    for c in expected.columns:
        if c in actual.columns and c not in keys and c not in volatile and c != mark:
            te, ta = expected.schema[c].dataType, actual.schema[c].dataType
            kind = kinds.get(c, kind_of(ta))
            x, y = F.col(f"e.`{c}`"), F.col(f"a.`{c}`")
            cells.append((c, same(x, y, te, ta, kind), x, y))
    here, there = F.col("e._e").isNotNull(), F.col("a._a").isNotNull()
    diff = F.when(here & there, diff_row(cells))
    kind = F.when(~there, "missing").when(~here, "extra").when(F.size(diff) > 0, "different").otherwise("same")
    out = j.select("_k", kind.alias("class"), diff.alias("diff"), *([F.col("a._marked").alias("_marked")] if mark else []))
    if mark:
        out = out.where((F.col("class") != "extra") | ~F.coalesce("_marked", F.lit(False))).drop("_marked")
    return out if look_for_extra else out.where("class <> 'extra'")


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    k = key_text(keys, expected.schema)
    return expected.withColumn("_k", k).join(actual.select(key_text(keys, actual.schema).alias("_k")), "_k", "left_anti").drop("_k")


def extra(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    return missing(actual, expected, keys)


def report(compared: DataFrame) -> DataFrame:
    """One row: ``checked, missing, different, extra, in_sync``."""
    n = {k: F.count_if(F.col("class") == k) for k in ("missing", "different", "extra")}
    return compared.agg(F.count_if(F.col("class") != "extra").alias("checked"), *[v.alias(k) for k, v in n.items()], (F.count_if(F.col("class") != "same") == 0).alias("in_sync"))


def samples(compared: DataFrame, k: int = SAMPLES) -> DataFrame:
    """The first ``k`` keys of each class that is wrong, values shortened."""
    w = Window.partitionBy("class").orderBy("_k")
    top = compared.where("class <> 'same'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return top.withColumn("diff", F.transform("diff", lambda d: F.struct(d["column"].alias("column"), F.substring(d["expected"], 1, SHORT).alias("expected"), F.substring(d["actual"], 1, SHORT).alias("actual"))))


def second_look(suspects: DataFrame, expected: DataFrame, actual: DataFrame, keys: list[str], **how) -> DataFrame:
    """Suspect keys compared again against later snapshots; only what is still wrong counts."""
    ks = suspects.where("class <> 'same'").select("_k").distinct()

    def only(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", key_text(keys, df.schema)).join(ks, "_k", "left_semi").drop("_k")

    return compare(only(expected), only(actual), keys, **how).where("class <> 'same'")


def reconcile(target: DataFrame, expected: DataFrame, compared: DataFrame, keys: list[str], delete_extra: bool = False, policy: str = "delete", mark: str | None = None, at: str | None = None) -> DataFrame:
    """The target after writing missing and different rows as the source has them now, and, if asked, removing or marking extras."""
    wrong = compared.where("class in ('missing', 'different')").select("_k")
    rows = expected.withColumn("_k", key_text(keys, expected.schema)).join(wrong, "_k", "left_semi").drop("_k")
    out = upsert(target, rows, keys, mark=mark)
    if delete_extra and policy != "ignore":
        surplus = target.withColumn("_k", key_text(keys, target.schema)).join(compared.where("class = 'extra'").select("_k"), "_k", "left_semi").select(*keys)
        out = soft_delete(out, surplus, keys, mark, at) if policy == "soft" else delete_by_key(out, surplus, keys)
    return out


def values_agree(df: DataFrame, a: str, b: str, kind: str, millis: bool = False) -> Column:
    """Do two columns of one row hold the same value by ``kind``?"""
    return same(F.col(a), F.col(b), df.schema[a].dataType, df.schema[b].dataType, kind, millis)
