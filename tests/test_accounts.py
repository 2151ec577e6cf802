"""Queries of accounting against their SQL, beyond the sizes of the given tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seamark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("n", [0, 9_999, 10_000])
def test_pending_letters_at_the_limit(spark, tmp_path, n):
    customer = spark.range(n).select((F.col("id") * 13).alias("c_custkey"), F.lit("c").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"), F.lit(1).alias("c_nationkey"))
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["l8_pending"](spark, str(tmp_path)).collect()]
    assert got == duck.sql(ORACLES["l8_pending"]).fetchall() == ([("orders-bridge", n, n, n >= 10_000)] if n else [])
