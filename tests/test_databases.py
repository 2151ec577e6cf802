"""Databases: balanced ranges, the search for rejected rows, and dumps that restore."""

import sqlite3
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from seamark.operators import exports as ex
from seamark.sources import jdbc

from .conftest import rows


class Sink:
    """Takes a batch whole or not at all."""

    def __init__(self, bad):
        self.bad, self.taken, self.calls, self.lock = set(bad), set(), 0, threading.Lock()

    def __call__(self, df):
        keys = {r["k"] for r in df.collect()}
        with self.lock:
            self.calls += 1
            if keys & self.bad:
                raise ValueError("rejected\nCaused by: X: ERROR 23505: duplicate")
            assert not keys & self.taken
            self.taken |= keys


def test_rejected_rows_are_found_within_the_budget(spark):
    df = spark.range(400).select(F.col("id").alias("k"))
    sink = Sink([3, 200, 201])
    out, told = jdbc.isolate_rejects(df, sink, ["k"], batch=100)
    assert told == {"attempts": sink.calls, "good": 397, "bad": 3, "untried": 0, "systemic": False}
    assert sink.calls <= 4 + 2 * 3 * 7
    assert rows(out.where("_reason is not null")) == sorted([(k, "X: ERROR 23505: duplicate") for k in (3, 200, 201)], key=repr)
    assert sink.taken == set(range(400)) - {3, 200, 201}


def test_a_fault_of_the_sink_is_systemic_and_a_budget_ends_the_search(spark):
    df = spark.range(64).select(F.col("id").alias("k"))
    _, told = jdbc.isolate_rejects(df, Sink(range(64)), ["k"], batch=16, most_bad=20)
    assert told["systemic"] and told["good"] == 0 and told["bad"] > 20
    out, told = jdbc.isolate_rejects(df, Sink([5]), ["k"], batch=64, budget=4)
    assert told["attempts"] == 4 and told["good"] + told["untried"] == 64
    assert out.where("_reason = 'not tried'").count() == told["untried"]
    out, told = jdbc.isolate_rejects(df.limit(0), Sink([]), ["k"])
    assert told == {"attempts": 0, "good": 0, "bad": 0, "untried": 0, "systemic": False} and out.count() == 0


def test_ranges_cover_every_row_once(spark):
    df = spark.createDataFrame([(x,) for x in [None, None, -5, 0, 0, 0, 0, 0, 1, 7, 9]], "k int")
    for parts in (1, 2, 4, 50):
        conditions = jdbc.ranges("k", jdbc.split_points(df, "k", parts))
        hits = df.select(sum(F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in conditions).alias("n"))
        assert rows(hits.distinct()) == [(1,)]
    assert jdbc.split_points(df.limit(0), "k", 4) == []
    with pytest.raises(ValueError):
        jdbc.split_points(spark.createDataFrame([("a",)], "k string"), "k", 2)
    day = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' k union all select timestamp_ntz'2024-01-02 00:00:00'")
    assert jdbc.ranges("k", jdbc.split_points(day, "k", 2)) == ["k <= TIMESTAMP '2024-01-01 00:00:00'", "k > TIMESTAMP '2024-01-01 00:00:00'", "k IS NULL"]


def test_dumps_restore(spark, tmp_path):
    df = spark.sql("""select * from values (1L, 'it''s "q" \\\\ x', true, cast(1.5 as decimal(8,2)), 2.5D, x'00ff', date'2024-01-02', timestamp_ntz'2024-01-02 03:04:05.678'),
        (2L, null, null, null, null, null, null, null) as t(k, s, b, d, f, y, day, at)""")
    read = lambda name: [line for p in sorted((tmp_path / name).glob("part-*")) for line in p.read_text().splitlines()]
    for dialect in ("sqlite", "postgres"):
        ex.backup_sql({"t": df}, {"t": ["k"]}, f"file://{tmp_path}/{dialect}", dialect)
    lite = sqlite3.connect(":memory:")
    for line in read("sqlite/t.ddl") + read("sqlite/t.dml"):
        lite.execute(line)
    assert lite.execute("select * from t order by k").fetchall() == [(1, 'it\'s "q" \\ x', 1, 1.5, 2.5, b"\x00\xff", "2024-01-02", "2024-01-02 03:04:05.678000"), (2, *[None] * 7)]
    duck = duckdb.connect()
    for line in read("postgres/t.ddl"):
        duck.execute(line)
    assert [r[1] for r in duck.sql("describe t").fetchall()] == ["BIGINT", "VARCHAR", "BOOLEAN", "DECIMAL(8,2)", "DOUBLE", "BLOB", "DATE", "TIMESTAMP"]


def test_definitions_by_dialect(spark):
    df = spark.sql("select 'a' k, array(1) a, cast(1 as tinyint) t, x'00' `odd``name`")
    assert ex.create_statement(df, "x`y", ["k"], "mysql") == "CREATE TABLE `x``y` (`k` VARCHAR(255), `a` JSON, `t` TINYINT, `odd``name` LONGBLOB, PRIMARY KEY (`k`));"
    assert ex.create_statement(df, 'x"y', ["k"], "postgres") == 'CREATE TABLE "x""y" ("k" TEXT, "a" JSONB, "t" SMALLINT, "odd`name" BYTEA, PRIMARY KEY ("k"));'
