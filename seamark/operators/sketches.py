"""Profiles of a table's columns as sketches, which merge.

A sketch has one row for each column: how many values it has, their least and
greatest, a theta sketch of the distinct ones and a KLL sketch of how they are
spread. Sketches of parts merge to the sketch of the whole, so what is appended
is profiled alone, and of a table of buckets only the buckets written since.

Distinct counts are exact up to 2^precision values; beyond that their standard
error is 2^(-precision/2), 0.8 % by default, or the column is counted (``exact``). Quantiles are within about 1.3 %
of the rank asked for. Counts, least and greatest values are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import BucketTable, Version

PRECISION = 14
#: Partial sketches are merged in so many tasks before they meet by column.
LANES = 64
SKETCH = "column string, type string, n_values long, low_text string, high_text string, distinct binary, longs binary, doubles binary"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _sketchable(f: T.StructField) -> bool:
    return not isinstance(f.dataType, (T.MapType, T.VariantType))


def _measures(c: Column, kind: T.DataType, precision: int) -> list[Column]:
    """The aggregates of one column, in the order of ``SKETCH``."""
    no_bytes, no_text = F.lit(None).cast("binary"), F.lit(None).cast("string")
    values, longs, doubles, low, high = c, no_bytes, no_bytes, no_text, no_text
    if isinstance(kind, _WHOLE):
        longs, values = F.kll_sketch_agg_bigint(c.cast("long")), c.cast("long")
    elif isinstance(kind, T.DateType):
        longs, values = F.kll_sketch_agg_bigint(F.unix_date(c).cast("long")), F.unix_date(c)
    elif isinstance(kind, _TIMES):
        micros = F.unix_micros(c) if isinstance(kind, T.TimestampType) else _wall_micros(c)
        longs, values = F.kll_sketch_agg_bigint(micros), micros
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        doubles, values = F.kll_sketch_agg_double(F.when(~F.isnan(c), c.cast("double"))), c.cast("double")
    elif isinstance(kind, T.DecimalType):
        doubles, values = F.kll_sketch_agg_double(c.cast("double")), c.cast("string")
    elif isinstance(kind, T.StringType):
        low, high = F.min(c), F.max(c)
    elif not isinstance(kind, T.BinaryType):
        values = c.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType)) else F.when(c.isNotNull(), F.to_json(F.struct(c)))
    # the sketch passes over empty text and bytes, so every text gets a first character
    if isinstance(kind, T.BinaryType):
        values = F.concat(F.lit(b"="), c)
    elif not isinstance(kind, (*_WHOLE, *_TIMES, T.DateType, T.FloatType, T.DoubleType)):
        values = F.concat(F.lit("="), values)
    return [F.count(c), low, high, F.theta_sketch_agg(values, precision), longs, doubles]


def _wall_micros(c: Column) -> Column:
    """Microseconds of a wall clock since 1970, whatever the session's time zone."""
    apart = c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (F.extract(F.lit("DAY"), apart).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), apart).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), apart).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), apart) * 1_000_000).cast("long")).cast("long")


def sketch(df: DataFrame, precision: int = PRECISION, by: list[str] = ()) -> DataFrame:
    """One row (``SKETCH``) for each column that is no map or variant; with ``by``, for each column and group of the given columns.

    A row of data meets one aggregate, whatever the number of columns: nothing
    is multiplied. What is shuffled are sketches, first to ``LANES`` tasks, then
    by column. An empty table gives columns without values.
    """
    fields = [f for f in df.schema.fields if _sketchable(f) and f.name not in by]
    aggs, cells = [], []
    for i, f in enumerate(fields):
        parts = _measures(F.col(f"`{f.name}`"), f.dataType, precision)
        names = [f"_{i}_{j}" for j in range(len(parts))]
        aggs += [p.alias(n) for p, n in zip(parts, names, strict=True)]
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), *[F.col(n).alias(a) for n, a in zip(names, ("n_values", "low_text", "high_text", "distinct", "longs", "doubles"), strict=True)]))
    if not fields:
        return df.sparkSession.createDataFrame([], SKETCH)
    lanes = df.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(LANES))).groupBy(*by, "_lane").agg(*aggs)
    found = lanes.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*")
    if by:
        return merge(found, precision, by)
    none = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), 0, None, None, None, None, None) for f in fields], SKETCH)
    return merge(found.unionByName(none), precision)


def merge(sketches: DataFrame, precision: int = PRECISION, by: list[str] = ()) -> DataFrame:
    """Sketches of parts as those of the whole, by column and type."""
    g = sketches.groupBy(*by, "column", "type")
    return g.agg(
        F.sum("n_values").alias("n_values"),
        F.min("low_text").alias("low_text"),
        F.max("high_text").alias("high_text"),
        F.theta_union_agg("distinct", precision).alias("distinct"),
        F.when(F.count("longs") > 0, F.kll_merge_agg_bigint("longs")).alias("longs"),
        F.when(F.count("doubles") > 0, F.kll_merge_agg_double("doubles")).alias("doubles"),
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_exact``: the distinct values of each column, one aggregate of that column alone for each."""
    each = [df.agg(F.count_distinct(F.col(f"`{c}`")).alias("n_exact")).select(F.lit(c).alias("column"), "n_exact") for c in columns]
    return reduce(DataFrame.union, each) if each else df.sparkSession.createDataFrame([], "column string, n_exact long")


def full(sketches: DataFrame, precision: int = PRECISION) -> set[str]:
    """Columns with too many distinct values for an exact count by their sketch."""
    return {r["column"] for r in sketches.where(F.theta_sketch_estimate("distinct") >= 1 << precision).select("column").collect()}


def summary(sketches: DataFrame, n_rows: Column, ranks: tuple[float, ...] = (0.25, 0.5, 0.75), exact: DataFrame | None = None) -> DataFrame:
    """``column, type, n_rows, n_null, n_distinct, is_unique, low, high, quantiles, low_text, high_text`` of merged sketches.

    ``low``, ``high`` and ``quantiles`` are numbers; dates count in days and
    times in microseconds since 1970. They are null for other types and for
    columns without a number. ``is_unique`` tells that no value is NULL or seen
    twice, as far as ``n_distinct`` is exact; ``exact`` (``distinct_counts``)
    goes before the sketch where it has the column.
    """

    def at(rank: float) -> Column:
        whole = F.when(F.kll_sketch_get_n_bigint("longs") > 0, F.kll_sketch_get_quantile_bigint("longs", F.lit(rank)).cast("double"))
        return F.coalesce(whole, F.when(F.kll_sketch_get_n_double("doubles") > 0, F.kll_sketch_get_quantile_double("doubles", F.lit(rank))))

    n_distinct = F.coalesce(F.theta_sketch_estimate("distinct"), F.lit(0))
    if exact is not None:
        sketches = sketches.join(F.broadcast(exact), "column", "left")
        n_distinct = F.coalesce("n_exact", n_distinct)
    spread = F.array(*map(at, ranks))
    out = sketches.select("column", "type", n_rows.cast("long").alias("n_rows"), "n_values", n_distinct.alias("n_distinct"), at(0.0).alias("low"), at(1.0).alias("high"), spread.alias("quantiles"), "low_text", "high_text")
    out = out.withColumns({"n_null": F.col("n_rows") - F.col("n_values"), "is_unique": (F.col("n_rows") == F.col("n_values")) & (F.col("n_distinct") == F.col("n_rows"))})
    return out.withColumn("quantiles", F.when(F.col("low").isNotNull(), F.col("quantiles"))).drop("n_values")


def shared_values(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], precision: int = PRECISION, exact: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``left, right, n_left, n_shared`` of pairs of columns of one type, from two sketches alone: does one refer to the other?

    Exact while both have fewer than 2^precision values; else an estimate of the
    intersection. With the two tables as ``exact``, pairs with a column beyond
    that are counted by a join of their distinct values, and only these columns are read.
    """
    wanted = reduce(Column.__or__, [(F.col("left") == a) & (F.col("right") == b) for a, b in pairs])
    a = left.select(F.col("column").alias("left"), "type", F.col("distinct").alias("_a"))
    b = right.select(F.col("column").alias("right"), "type", F.col("distinct").alias("_b"))
    both = a.join(b, "type").where(wanted & F.col("_a").isNotNull() & F.col("_b").isNotNull())
    n_left, n_shared = F.theta_sketch_estimate("_a"), F.theta_sketch_estimate(F.theta_intersection("_a", "_b"))
    if exact is None:
        return both.select("left", "right", n_left.alias("n_left"), n_shared.alias("n_shared"))
    beyond = F.greatest(n_left, F.theta_sketch_estimate("_b")) >= 1 << precision
    found = [(r["left"], r["right"], r["n_left"], r["n_shared"], r["beyond"]) for r in both.select("left", "right", n_left.alias("n_left"), n_shared.alias("n_shared"), beyond.alias("beyond")).collect()]  # a row for each pair
    out = [left.sparkSession.createDataFrame([r[:4] for r in found if not r[4]], "left string, right string, n_left long, n_shared long")]
    for x, y in [r[:2] for r in found if r[4]]:
        values, others = (df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct() for df, c in zip(exact, (x, y), strict=True))
        hits = values.join(others.withColumn("hit", F.lit(1)), "v", "left")
        out.append(hits.agg(F.count("v").alias("n_left"), F.count("hit").alias("n_shared")).select(F.lit(x).alias("left"), F.lit(y).alias("right"), "n_left", "n_shared"))
    return reduce(DataFrame.union, out)


def profile_buckets(table: BucketTable, version: Version | None = None, precision: int = PRECISION, exact: bool = False) -> DataFrame:
    """The ``summary`` of a version of a bucketed table; only buckets that no earlier profile saw are read.

    ``exact``: columns whose distinct values are too many for their sketch are
    read as well, each alone, and counted.

    Sketches stand beside the buckets, each row with its folder's name, which no
    two writes share; so a crash or two profiles at once leave at most rows that
    are alike, of which one counts. Columns added later are NULL in older buckets.
    Rows of folders that are gone stay; the folder ``sketches`` may be deleted at any time.
    """
    v = version or table.version()
    if v is None:
        raise ValueError("no version to profile")
    spark, path = table.spark, f"{table.path}/sketches"
    manifest = table.manifest(v).select("folder", "n").collect()  # at most 2^bits
    schema = f"folder string, precision int, {SKETCH}"
    there = table._fs().exists(table._hadoop("sketches"))
    seen = {r["folder"] for r in spark.read.schema(schema).parquet(path).where(F.col("precision") == precision).select("folder").distinct().collect()} if there else set()
    todo = sorted(r["folder"] for r in manifest if r["folder"] not in seen)
    if todo:
        tags = sorted({f.split("/_b=")[0] for f in todo})
        typed = T.StructType([*v.schema.fields, T.StructField("_b", T.IntegerType())])
        parts = [spark.read.schema(typed).option("basePath", f"{table.path}/{t}").parquet(*[f"{table.path}/{f}" for f in todo if f.startswith(f"{t}/")]).withColumn("folder", F.concat(F.lit(f"{t}/_b="), F.col("_b").cast("string"))).drop("_b") for t in tags]
        new = sketch(reduce(DataFrame.unionByName, parts), precision, ["folder"])
        new.withColumn("precision", F.lit(precision)).select(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path).where((F.col("precision") == precision) & F.col("folder").isin([r["folder"] for r in manifest])).dropDuplicates(["folder", "column", "type"])
    kinds = {(f.name, f.dataType.simpleString()) for f in v.schema.fields if _sketchable(f)}
    none = spark.createDataFrame([(c, k, 0, None, None, None, None, None) for c, k in sorted(kinds)], SKETCH)
    merged = merge(found.select(none.columns).unionByName(none), precision)
    current = merged.join(F.broadcast(none.select("column", "type")), ["column", "type"], "left_semi")
    counts = distinct_counts(table._rows(v), sorted(full(current, precision))) if exact else None
    return summary(current, F.lit(sum(r["n"] for r in manifest)), exact=counts)
