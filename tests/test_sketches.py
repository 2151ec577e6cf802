"""Sketches of columns: how near they are, that they merge, odd values, and what a profile reads."""

import pytest
from pyspark.sql import functions as F

from seamark.operators.buckets import BucketTable
from seamark.operators.sketches import SKETCH, merge, profile_buckets, shared_values, sketch, summary


def facts(df, n):
    return {r["column"]: r for r in summary(sketch(df), F.lit(n)).collect()}


def test_near_the_truth_beyond_the_exact_range(spark):
    n = 200_000
    df = spark.range(n).select("id", F.hash("id").alias("h"), (F.col("id") % 1_000).cast("string").alias("few"), (F.col("id") * F.lit(0.5)).alias("half"))
    got = facts(df, n)
    assert abs(got["id"]["n_distinct"] / n - 1) < 0.02
    assert abs(got["h"]["n_distinct"] / df.select("h").distinct().count() - 1) < 0.02
    assert got["few"]["n_distinct"] == 1_000 and not got["few"]["is_unique"]
    assert (got["half"]["low"], got["half"]["high"]) == (0.0, (n - 1) / 2)
    for rank, value in zip((0.25, 0.5, 0.75), got["half"]["quantiles"], strict=True):
        assert abs(value * 2 / n - rank) < 0.02


def test_parts_merge_to_the_whole(spark):
    df = spark.range(10_000).select((F.col("id") % 700).alias("a"), F.concat(F.lit("t"), F.col("id") % 31).alias("b"))
    low, high = df.where("a < 300"), df.where("a >= 300")
    parts = merge(sketch(low).unionByName(sketch(high)))
    pick = ["column", "type", "n_rows", "n_null", "n_distinct", "low", "high", "low_text", "high_text"]
    whole = sorted(tuple(r) for r in summary(sketch(df), F.lit(10_000)).select(*pick).collect())
    assert sorted(tuple(r) for r in summary(parts, F.lit(10_000)).select(*pick).collect()) == whole


ODD = """select * from values
('', X'', 1.5BD, true, array(1), cast('nan' as double), timestamp_ntz'1969-12-31 23:59:59.5', date'1970-01-02', named_struct('a', 1)),
(null, null, null, null, null, null, null, null, null),
('', X'00', 1.50BD, false, array(1), -0.0D, timestamp_ntz'2020-01-01 00:00:00', date'1960-01-02', named_struct('a', null)),
('b', X'00', 2BD, false, array(), 0.0D, timestamp_ntz'2020-01-01 00:00:00', date'1960-01-02', null) as t(s, b, d, o, a, f, w, dt, st)"""


def test_nulls_empty_values_and_kinds(spark):
    got = facts(spark.sql(ODD), 4)
    assert {c: (r["n_null"], r["n_distinct"]) for c, r in got.items()} == {"s": (1, 2), "b": (1, 2), "d": (1, 2), "o": (1, 2), "a": (1, 2), "f": (1, 2), "w": (1, 2), "dt": (1, 2), "st": (2, 2)}
    assert (got["s"]["low_text"], got["s"]["high_text"], got["s"]["quantiles"]) == ("", "b", None)
    assert (got["w"]["low"], got["dt"]["low"], got["d"]["high"]) == (-500_000.0, -3652.0, 2.0)
    none = facts(spark.sql(ODD).limit(0), 0)
    assert len(none) == 9 and all(r["n_distinct"] == 0 and r["low"] is None for r in none.values())


def test_a_session_elsewhere_reads_wall_clocks_alike(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert facts(spark.sql(ODD), 4)["w"]["low"] == -500_000.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_are_not_multiplied(spark):
    plan = sketch(spark.range(9).select("id", F.col("id").alias("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_only_new_buckets_are_read(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", ["id"], bits=3)
    with pytest.raises(ValueError):
        profile_buckets(table)
    table.upsert(spark.range(1_000).select("id", (F.col("id") % 7).alias("v")))
    assert {r["column"]: r["n_distinct"] for r in profile_buckets(table).collect()} == {"id": 1_000, "v": 7}
    read = lambda: spark.read.schema(f"folder string, {SKETCH}").parquet(f"{tmp_path}/t/sketches").count()
    assert read() == 8 * 2
    wide = spark.createDataFrame([(5_000, 99, "new")], "id long, v long, w string")
    table.apply(wide, lambda now: now.unionByName(wide), wide.schema)
    got = {r["column"]: r for r in profile_buckets(table).collect()}
    assert read() == 8 * 2 + 3  # one bucket, three columns now
    assert (got["id"]["n_distinct"], got["v"]["high"], got["w"]["n_null"], got["w"]["high_text"]) == (1_001, 99.0, 1_000, "new")
    profile_buckets(table)
    assert read() == 8 * 2 + 3


def test_shared_values_need_one_type(spark):
    a, b = sketch(spark.range(10).select(F.col("id").alias("x"), F.col("id").cast("string").alias("y"))), sketch(spark.range(5, 20).select(F.col("id").alias("z")))
    got = shared_values(a, b, [("x", "z"), ("y", "z")]).collect()
    assert [tuple(r) for r in got] == [("x", "z", 10, 5)]


def test_counts_beyond_the_sketch_are_exact_where_asked(spark, tmp_path):
    df = spark.range(3_000).select("id", (F.col("id") % 2_000).alias("twice"), (F.col("id") % 9).alias("few"), F.when(F.col("id") > 5, F.col("id")).alias("gap"))
    table = BucketTable(spark, str(tmp_path), ["id"], bits=2)
    table.upsert(df)
    got = {r["column"]: (r["n_distinct"], r["is_unique"]) for r in profile_buckets(table, precision=8, exact=True).collect()}
    assert got == {"id": (3_000, True), "twice": (2_000, False), "few": (9, False), "gap": (2_994, False)}
    other = spark.range(1_000, 5_000, 3).select(F.col("id").alias("key"))
    pairs = [("gap", "key"), ("few", "key"), ("few", "few")]
    left, right = df.select("gap", "few"), other.withColumn("few", F.col("key") % 4)
    shared = shared_values(sketch(left, 8), sketch(right, 8), pairs, 8, (left, right)).collect()
    assert {(r["left"], r["right"]): (r["n_left"], r["n_shared"]) for r in shared} == {("gap", "key"): (2_994, 667), ("few", "key"): (9, 0), ("few", "few"): (9, 4)}
