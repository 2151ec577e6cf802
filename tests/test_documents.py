"""Documents: paths at every depth, kinds, order of ids."""

from pyspark.sql import functions as F

from seamark.sources.documents import documents_after, nested_schema
from seamark.sources.tables import read_documents


def schema(spark, *texts):
    got = nested_schema(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()
    return {r["path"]: (r["type"], r["n_present"], r["n_null"]) for r in got}


def test_paths_at_every_depth(spark):
    got = schema(
        spark,
        '{"a": {"b": [[1, 2], [], [3.5]]}, "c d": {"it\'s": null}, "n": 1}',
        '{"a": {"b": [[null]]}, "n": 3000000000, "x": {"$oid": "507f1f77bcf86cd799439011"}}',
        '{"a": "text", "n": 123456789012345678901234, "x": {"$date": {"$numberLong": "5"}}}',
        "[true, {\"k\": \"}]{[\"}]",
        "not json",
        None,
    )
    assert got == {
        "$": ("mixed", 4, 0),
        "$.a": ("mixed", 3, 0),
        "$.a.b": ("array", 2, 0),
        "$.a.b[]": ("array", 4, 0),
        "$.a.b[][]": ("double", 4, 1),
        "$['c d']": ("object", 1, 0),
        "$['c d']['it\\'s']": ("null", 1, 1),
        "$.n": ("decimal", 3, 0),
        "$.x": ("mixed", 2, 0),
        "$[]": ("mixed", 2, 0),
        "$[].k": ("string", 1, 0),
    }


def test_nothing_and_scalars(spark):
    assert schema(spark) == {}
    assert schema(spark, "nope", None) == {}
    assert schema(spark, "5", "null", "2147483648") == {"$": ("long", 3, 1)}
    assert schema(spark, "5.0") == {"$": ("double", 1, 0)}


def test_no_shuffle_but_of_counts(spark):
    plan = nested_schema(spark.createDataFrame([("{}",)], "j string"), "j", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PythonUDF" not in plan


IDS = [
    "null",
    "-5",
    '{"$numberLong": "7"}',
    "7.5",
    "9007199254740992",
    "9007199254740993",
    '{"$numberDecimal": "1e20"}',
    '"10"',
    '"9"',
    '{"a":1}',
    '{"$oid": "507f1f77bcf86cd799439011"}',
    '{"$oid": "507f1f77bcf86cd799439012"}',
    "false",
    "true",
    '{"$date": "1969-12-31T23:59:59Z"}',
    '{"$date": {"$numberLong": "1"}}',
    '{"$date": "1970-01-01T00:00:01Z"}',
]


def test_ids_of_all_kinds_in_order_page_by_page(spark):
    lines = [f'{{"_id": {i}, "place": {n}}}' for n, i in enumerate(IDS)]
    mixed = lines[::2] + lines[1::2][::-1]
    docs = read_documents(spark.createDataFrame([(x,) for x in mixed], "value string")).repartition(3)
    seen, last = [], None
    while True:
        page = documents_after(docs, last, 4).select(F.variant_get("doc", "$.place", "int").alias("p")).collect()
        if not page:
            break
        seen += [r["p"] for r in page]
        last = IDS[seen[-1]]
    assert seen == list(range(len(IDS)))
