"""Hand-computed cases of filters, shaping, canonical values and sources."""

import pytest
from pyspark.sql import functions as F

from seamark.functions.canonical import canonical, key_text, number_text
from seamark.functions.convert import digits_of, more_digits
from seamark.functions.payload import render_key, render_payload
from seamark.functions.predicate import Filter, predicate
from seamark.functions.shaping import Cast, Mask, Set, shape_rows, volatile_columns
from seamark.operators.causes import classify, may_pass
from seamark.operators.exports import csv_safe
from seamark.operators.verify import values_agree
from seamark.sources.tables import glob_regex, key_glob, keyset_after, read_documents, resolve_order
from seamark.streaming.echo import recognise_in_order

from .conftest import rows


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}")


@pytest.mark.parametrize(
    ("value", "f", "want"),
    [
        ("007", Filter("c", "eq", "7"), True),
        ("abc", Filter("c", "eq", "7"), False),
        ("abc", Filter("c", "gt", "abb"), True),
        ("50%", Filter("c", "contains", "%"), True),
        ("500", Filter("c", "contains", "%"), False),
        (None, Filter("c", "neq", "x"), False),
        (None, Filter("c", "isNull"), True),
        ("a", Filter("c", "in", "a"), False),
        ("a", Filter("gone", "isNull"), True),
        ("10", Filter("c", "lt", "9"), False),
    ],
)
def test_filters(spark, value, f, want):
    df = one(spark, value)
    assert (df.where(predicate([f], df.schema)).count() == 1) is want


def test_literal_of_another_type_does_not_fail(spark):
    df = spark.createDataFrame([(42,)], "c long")
    assert df.where(predicate([Filter("c", "eq", "abc")], df.schema)).count() == 0
    assert df.where(predicate([Filter("c", "eq", "42.0")], df.schema)).count() == 1


@pytest.mark.parametrize(("text", "want"), [("12.9", 12), ("-12.9", -12), (" 5 ", 5), ("5d", None), ("", None), ("9007199254740993", 9007199254740993), ("Infinity", None)])
def test_integer(spark, text, want):
    got = shape_rows(one(spark, text), [Cast("c", "integer", "null")]).first()
    assert got["c"] == want


@pytest.mark.parametrize(("text", "want"), [("abc😀def", "ab****f"), ("ab", "**"), ("", "*"), (None, None)])
def test_partial_mask(spark, text, want):
    assert shape_rows(one(spark, text), [Mask("c", "partial", keep_start=2, keep_end=1)]).first()["c"] == want


def test_volatile():
    assert volatile_columns([Set("a", "{{$now}}"), Set("b", "x{{a}}"), Set("c", "{{id}}")]) == {"a", "b"}


@pytest.mark.parametrize(("text", "want"), [("+001.50", "1.5"), ("-0.0", "0"), ("1e2", "100"), (".5", "0.5"), ("x", "x")])
def test_decimal_text(spark, text, want):
    df = one(spark, text)
    assert df.select(canonical(F.col("c"), df.schema["c"].dataType, "decimal")).first()[0] == want


def test_text_keys_stay_apart(spark):
    df = spark.createDataFrame([("007",), ("7",), ("7.0",), (None,), ("null",)], "c string")
    assert df.select(key_text(["c"], df.schema)).distinct().count() == 5


@pytest.mark.parametrize(("a", "b", "kind", "want"), [("NaN", "NaN", "double", True), ("1", "1.000000000000001", "double", True), ("inf", "-inf", "double", False), ('{"a":1,"b":[1]}', '{"b":[1],"a":1}', "json", True), (None, None, "text", True), (None, "x", "text", False), ("10:20", "10:20:00.000", "time", True)])
def test_same(spark, a, b, kind, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(values_agree(df, "a", "b", kind)).first()[0] is want


@pytest.mark.parametrize(("pattern", "text", "want"), [("user:*", "user:1", True), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[^x]y", "xy", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("a.c", "abc", False)])
def test_glob(spark, pattern, text, want):
    assert one(spark, text).where(F.col("c").rlike(glob_regex(pattern))).count() == want


def test_glob_of_filters():
    assert key_glob([Filter("key", "contains", "a*b")]) == r"*a\*b*"
    assert key_glob([Filter("other", "eq", "x")]) == "*"


def test_keyset_refuses_null(spark):
    with pytest.raises(ValueError):
        keyset_after(one(spark, "a"), [("c", True)], [None], 1)


def test_resolve_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k long, t string")
    assert resolve_order(df, [("t", False)], ["k"]) == ([("t", False), ("k", True)], None)
    assert resolve_order(df, [], [], [["k"]])[0] == [("k", True)]
    order, warning = resolve_order(df, [], [], [["t"]])
    assert order == [("k", True), ("t", True)] and warning


def test_payload_keeps_types(spark):
    df = spark.createDataFrame([(5, 'say "hi"', None)], "id long, name string, gone string")
    body, unknown = render_payload(df, {"id": "{{id}}", "t": "n={{name}}", "g": "{{gone}}", "{{id}}": [True, "{{zz}}"]})
    assert df.select(body).first()[0] == '{"id":5,"t":"n=say \\"hi\\"","g":null,"5":[true,null]}'
    assert unknown == ["zz"]


def test_render_key(spark):
    df = spark.createDataFrame([(1, "")], "id long, name string")
    key, missing = render_key(df, "u:{{id}}:{{name}}")
    assert df.select(missing).first()[0] == ["name"]


def test_documents(spark):
    df = spark.createDataFrame([('{"_id": {"$oid": "ab"}, "x": 1}',), ('{"_id": 7}',), ("junk",)], "value string")
    assert sorted(r["_id"] for r in read_documents(df).collect()) == ["7", "ab"]


def test_csv_safe_and_causes(spark):
    assert one(spark, "=1+1").select(csv_safe(F.col("c"))).first()[0] == "'=1+1"
    assert one(spark, "ERROR: deadlock detected").select(classify(F.col("c"))).first()[0] == "deadlock"
    assert one(spark, "who knows").select(classify(F.col("c"))).first()[0] == "other"


def test_causes_by_number_first(spark):
    from seamark.operators import causes
    from seamark.plans.accounts import MESSAGES

    df = spark.createDataFrame([*MESSAGES, (None, None)], "said string, cause string")
    assert [tuple(r) for r in df.where(~classify(F.col("said")).eqNullSafe(F.col("cause"))).collect()] == []
    # a number counts before words, and an unknown one falls back on its class, then on words
    for said, cause in (("HTTP 500: connection refused upstream", "http: server failed"), ("timeout (SQLSTATE 23505)", "duplicate key"), ("x SQLSTATE[22012] division by zero", "wrong type"), ("ERROR 9999: lock wait timeout exceeded", "deadlock"), ("HTTP 302 moved", "other"), ("HTTP 4010", "other")):
        assert one(spark, said).select(classify(F.col("c"))).first()[0] == cause, said
    known = {c for t in (causes.SQLSTATES, causes.SQLSTATE_CLASSES, causes.MYSQL, causes.MONGODB, causes.SYMBOLS) for c in t.values()} | {c for e in causes.WORDS.values() for c in e}
    assert known <= {c for _, c in MESSAGES}
    assert one(spark, "deadlock").select(may_pass(F.col("c"))).first()[0] and not one(spark, "duplicate key").select(may_pass(F.col("c"))).first()[0]


def test_echoes_are_consumed_in_order(spark, tmp_path):
    w = [("write", "k", "v1", "2024-01-01 00:00:00"), ("write", "k", "v2", "2024-01-01 00:00:01"), ("change", "k", "v2", "2024-01-01 00:00:02"), ("change", "k", "v1", "2024-01-01 00:00:03"), ("write", "j", "v", "2024-01-01 00:00:00"), ("change", "j", "v", "2024-01-01 00:09:00")]
    df = spark.createDataFrame(w, "kind string, k string, reading string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = recognise_in_order(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("echoes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["k"], r["reading"]): r["is_echo"] for r in spark.table("echoes").collect()}
    # v2 takes v1's older entry with it; the entry of j has expired
    assert got == {("k", "v2"): True, ("k", "v1"): False, ("j", "v"): False}


def test_rows_helper(spark):
    assert rows(one(spark, "a")) == [("a",)]


def test_number_text_is_canonical_and_names_its_parts_once(spark):
    texts = {"+007.500": "7.5", "-0": "0", "-0.00": "0", "+0": "0", "000": "0", ".5": "0.5", "-.5": "-0.5", "5.": "5", "-00.10": "-0.1", "100": "100", "1e3": "1000", "-2.50E1": "-25", " 10.0 ": "10", "\t0\n": "0", "0.001": "0.001", "x": None, "": None, "-": None, ".": None, "1.2.3": None}
    got = spark.createDataFrame([(x,) for x in texts], "v string").select("v", number_text(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in got} == texts
    plan = spark.range(1).select(number_text(F.col("id").cast("double")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(id") <= 5  # it was 60 and more


def test_more_digits_equals_a_count_of_canonical_digits(spark):
    values = [0.0, -0.0, 0.1 + 0.2, 1e15, 1e14, 123456789012345.0, 1234567890123456.0, 1e-7, 1e20, -1e22, 5e-324, 123456.123456789, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in values], "v double").select("v", F.col("v").try_cast("decimal(38,10)").alias("d"))
    for c in ("v", "d"):
        wrong = df.where(~F.coalesce(more_digits(F.col(c), 15), F.lit(False)).eqNullSafe(F.coalesce(digits_of(F.col(c)) > 15, F.lit(False))))
        assert wrong.collect() == []
