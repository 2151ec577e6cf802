"""Tables in the folder that the driver and all executors share.

``materialize`` cuts lineage by writing Parquet under ``spark.checkpoint.dir``
and reading it back, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a fresh one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seamark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared table and return it as read from there.

    The schema is passed to the reader, so an empty result works too.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seamark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later step reads."""
    for t in tables:
        path = getattr(t, "_seamark_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(table: DataFrame, rows: int = 50_000) -> DataFrame:
    """``table``, marked for broadcast if it was counted and has at most ``rows`` (narrow) rows; else Spark shuffles it.

    50,000 rows of a few numbers, or 250,000 of one, take a few MB.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
