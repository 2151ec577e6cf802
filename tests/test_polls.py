"""Limits of polls and of retention, without a task that holds them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seamark.operators.accounting import retention
from seamark.operators.polls import at_most, poll_snapshot

from .conftest import rows

DAY = dt.datetime(2024, 1, 1)


def test_ties_of_the_last_value_stay(spark):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i // 4) for i in range(1, 400)], "id long, c long").repartition(7)
    values = sorted(i // 4 for i in range(1, 400) if i % 11)
    for limit in (1, 2, 5, 90, 1_000):
        edge = values[:limit][-1]
        want = sorted(((i,) for i in range(1, 400) if i % 11 and i // 4 <= edge), key=repr)
        assert rows(at_most(df, "c", ["id"], limit).select("id")) == want
    assert rows(at_most(df, "c", ["id"], 0)) == [] and rows(at_most(df.limit(0), "c", ["id"], 5)) == []


def test_the_oldest_keys_are_forgotten(spark):
    seen = spark.createDataFrame([], "k string, n long")
    for low in (0, 5, 10):
        _, seen = poll_snapshot(spark.range(low, low + 5), ["id"], seen, 8)
    assert rows(seen) == sorted([(f'["{i}"]', 2) for i in range(10, 15)] + [(f'["{i}"]', 1) for i in range(5, 8)], key=repr)


def test_retention_equals_a_plain_walk(spark):
    r = random.Random(3)
    details = [(r.choice("abcx"), i, DAY + dt.timedelta(hours=r.randrange(400))) for i in range(300)]
    jobs = [("a", None), ("b", DAY + dt.timedelta(days=1)), ("c", DAY + dt.timedelta(days=15))]
    protected = [("a", 3), ("b", 7), ("x", 11)] + [d[:2] for d in details[::29]]
    now, cut, newest = DAY + dt.timedelta(days=17), DAY + dt.timedelta(days=7), 12
    want = []
    for job, seq, at in details:
        end = dict(jobs).get(job)
        rank = sum((a, s) >= (at, seq) for j, s, a in details if j == job)
        if (job, seq) in protected or (end >= cut if end else at >= cut and rank <= newest):
            want.append((job, seq, at))
    d = spark.createDataFrame(details, "job string, sequence long, at timestamp_ntz")
    kept = retention(d, spark.createDataFrame(jobs, "job string, finished_at timestamp_ntz"), now, 10, newest, spark.createDataFrame(protected, "job string, sequence long"))
    assert rows(kept) == sorted(want, key=repr)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.where(F.col("job") == "c").count() == sum(j == "c" for j, _, _ in details)
