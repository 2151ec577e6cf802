"""Schema drift seen in the data: what columns appear, vanish or change type against an accepted baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import key_text


def normal_type(c: Column) -> Column:
    """Type text without case, outer blanks or doubled blanks."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def drift(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """``table, column, change (added, removed, retyped), before, after`` from two frames of ``table, column, type``."""
    b = baseline.select("table", "column", normal_type(F.col("type")).alias("before"))
    o = observed.select("table", "column", normal_type(F.col("type")).alias("after"))
    j = b.join(o, ["table", "column"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "retyped")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select("table", "column", "change", "before", "after")


def missing_used(drifted: DataFrame, used: DataFrame) -> DataFrame:
    """Removed columns that a spec uses (``table, column``)."""
    return drifted.where("change = 'removed'").join(used, ["table", "column"], "left_semi")


def nulled_values(rows: DataFrame, target: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows that would now write NULL over a value of the target in ``column``."""
    r = rows.withColumn("_k", key_text(keys, rows.schema))
    if column in rows.columns:
        r = r.where(F.col(column).isNull())
    t = target.where(F.col(column).isNotNull()).select(key_text(keys, target.schema).alias("_k"))
    return r.join(t, "_k", "left_semi").drop("_k")


def verdict(drifted: DataFrame, used: DataFrame, policies: DataFrame) -> DataFrame:
    """``table, verdict, add_columns, can_accept`` under each table's policy (``table, policy, mapped, creatable``).

    stop: any drift stops. continue: goes on unless a used column is gone.
    evolve: also adds columns, to unmapped targets that may be made. Accepting a
    new baseline is refused while a used column is gone.
    """
    gone = missing_used(drifted, used).groupBy("table").agg(F.count("*").alias("n_gone"))
    seen = drifted.groupBy("table").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("change") == "added", F.col("column")))).alias("added"))
    j = policies.join(seen, "table", "left").join(gone, "table", "left")
    n, lost = F.coalesce("n", F.lit(0)), F.coalesce("n_gone", F.lit(0))
    v = F.when(n == 0, "go").when(lost > 0, "stop").when(F.col("policy") == "stop", "stop").otherwise("go")
    may = (F.col("policy") == "evolve") & ~F.col("mapped") & F.col("creatable") & (v == "go")
    return j.select("table", v.alias("verdict"), F.when(may, F.coalesce("added", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("add_columns"), (lost == 0).alias("can_accept"))


def describe(drifted: DataFrame) -> DataFrame:
    """One line for each table: ``table, line``."""
    part = F.concat(F.col("change"), F.lit(" "), F.col("column"), F.when(F.col("change") == "retyped", F.concat(F.lit(" ("), F.col("before"), F.lit(" -> "), F.col("after"), F.lit(")"))).otherwise(""))
    return drifted.groupBy("table").agg(F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("line"))
