"""Documents in JSON, with typed values in their extended form (``{"$oid": ...}``): what they hold at every depth, and their order by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wrappers of typed values, and the kind each stands for.
WRAPPED = {
    "$oid": "objectId",
    "$date": "date",
    "$timestamp": "timestamp",
    "$numberInt": "int",
    "$numberLong": "long",
    "$numberDouble": "double",
    "$numberDecimal": "decimal",
    "$binary": "binary",
    "$uuid": "uuid",
}
#: Fixed order of numeric kinds; a wider one holds the narrower.
NUMBERS = ("int", "long", "double", "decimal")
#: Fixed order of kinds of an id; those of one line compare by value.
ID_ORDER = (("null",), NUMBERS, ("string",), ("object",), ("array",), ("binary", "uuid"), ("objectId",), ("boolean",), ("date",), ("timestamp",))


def _wrapper(v: Column) -> Column:
    """The name of the wrapper around a value; NULL if there is none."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.when((F.size(names) == 1) & names[0].isin(*WRAPPED), names[0])


def kind(v: Column) -> Column:
    """The kind of a variant: ``null boolean int long double decimal string object array``, or what a wrapper stands for.

    Whole numbers of 32 bits are int, of 64 long, longer ones decimal; numbers
    with a fraction (5.0 too) or an exponent are double.
    """
    s = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "long")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in WRAPPED.items() for x in pair]), _wrapper(v))
    return (
        F.when(v.isNull() | (s == "VOID"), "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "STRING", "string")
        .when(s == "BIGINT", F.when(whole.between(-(2**31), 2**31 - 1), "int").otherwise("long"))
        .when(s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "decimal")
        .when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), F.coalesce(named, F.lit("object")))
        .otherwise(F.lower(s))
    )


def _depth(text: Column) -> Column:
    """How deep brackets are nested in a JSON text."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    walk = F.aggregate(
        F.split(bare, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct(
            (a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return walk["most"]


def _named(parent: Column, key: Column) -> Column:
    quoted = F.concat(F.lit("['"), F.regexp_replace(key, r"(['\\])", r"\\$1"), F.lit("']"))
    return F.concat(parent, F.when(key.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit("."), key)).otherwise(quoted))


def nested_schema(df: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """``path, type, types, n_present, n_null`` at every depth of the JSON texts of a column, from all rows.

    ``$.a.b`` is a field, ``$.a[]`` the elements of an array. ``types`` are the
    kinds seen beside null, sorted; ``type`` is the one, the widest of numbers,
    ``null`` if there is none, else ``mixed``. ``n_present`` counts values, nulls
    among them. Texts that are NULL or not JSON have no path. ``depth`` is the
    deepest nesting; unless given, one aggregate measures it.

    Each level opens the values of the one before within its row, so nothing is
    shuffled but counts by path and kind.
    """
    text = F.col(f"`{column}`")
    if depth is None:
        depth = df.where(F.try_parse_json(text).isNotNull()).agg(F.max(_depth(text))).first()[0] or 0
    at = df.select(F.lit("$").alias("path"), F.try_parse_json(text).alias("v"), F.lit(True).alias("new")).where(F.col("v").isNotNull())
    for _ in range(depth):
        v, path = F.col("v"), F.col("path")
        plain = F.col("new") & _wrapper(v).isNull()
        fields = F.transform(F.map_entries(F.when(plain, F.try_variant_get(v, "$", "map<string,variant>"))), lambda e: F.struct(_named(path, e["key"]).alias("path"), e["value"].alias("v"), F.lit(True).alias("new")))
        elements = F.transform(F.when(plain, F.try_variant_get(v, "$", "array<variant>")), lambda e: F.struct(F.concat(path, F.lit("[]")).alias("path"), e.alias("v"), F.lit(True).alias("new")))
        here = F.array(F.struct("path", "v", F.lit(False).alias("new")))
        none = F.array().cast("array<struct<path:string,v:variant,new:boolean>>")
        at = at.select(F.explode(F.concat(here, F.coalesce(fields, none), F.coalesce(elements, none))).alias("r")).select("r.*")
    seen = at.select("path", kind(F.col("v")).alias("t")).groupBy("path", "t").agg(F.count("*").alias("n"))
    g = seen.groupBy("path").agg(F.array_sort(F.collect_set(F.when(F.col("t") != "null", F.col("t")))).alias("types"), F.sum("n").alias("n_present"), F.sum(F.when(F.col("t") == "null", F.col("n")).otherwise(0)).alias("n_null"))  # some kinds a path
    widest = F.element_at(F.array(*map(F.lit, NUMBERS)), F.array_max(F.transform("types", lambda t: F.array_position(F.array(*map(F.lit, NUMBERS)), t))).cast("int"))
    merged = F.when(F.size("types") == 0, "null").when(F.size("types") == 1, F.col("types")[0]).when(F.forall("types", lambda t: t.isin(*NUMBERS)), widest).otherwise("mixed")
    return g.select("path", merged.alias("type"), "types", "n_present", "n_null")


def id_order(v: Column) -> list[Column]:
    """Columns to sort or compare ids by: kinds in ``ID_ORDER``, numbers by value whatever their width, the rest as text.

    Object ids and binary values have texts of one alphabet, which sort as they
    do; dates count in milliseconds. A missing id is null.
    """
    k, wrapper = kind(v), _wrapper(v)
    inner = F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), wrapper)
    text = F.when(k.isin("object", "array"), F.to_json(v)).otherwise(F.try_variant_get(F.when(wrapper.isNotNull(), inner).otherwise(v), "$", "string"))
    rank = F.lit(None).cast("int")
    for i, kinds in enumerate(ID_ORDER):
        rank = F.when(k.isin(*kinds), i).otherwise(rank)
    moment = F.coalesce(text.try_cast("long"), F.unix_millis(text.try_cast("timestamp")), F.try_variant_get(inner, "$['$numberLong']", "string").try_cast("long"))
    numeric = F.when(k.isin(*NUMBERS), text)
    number = F.when(k == "date", moment.cast("double")).otherwise(numeric.try_cast("double"))
    exact = F.when(k == "date", moment.cast("decimal(38,15)")).otherwise(numeric.try_cast("decimal(38,15)"))
    return [F.coalesce(rank, F.lit(len(ID_ORDER))).alias("_kind"), number.alias("_number"), exact.alias("_exact"), F.when(~k.isin(*NUMBERS, "date", "null"), text).alias("_text")]


def documents_after(docs: DataFrame, last: str | None, limit: int, column: str = "doc") -> DataFrame:
    """The next documents in order of their ids after ``last`` (an id in JSON; None: from the start): pages across kinds of ids."""
    v = F.variant_get(F.col(column), "$._id", "variant")
    keyed = docs.select("*", F.struct(*id_order(v)).alias("_order"))
    if last is not None:
        edge = docs.sparkSession.range(1).select(F.struct(*id_order(F.parse_json(F.lit(last)))).alias("_edge"))
        keyed = keyed.crossJoin(F.broadcast(edge)).where(F.col("_order") > F.col("_edge")).drop("_edge")  # one row
    return keyed.orderBy("_order").limit(limit).drop("_order")
