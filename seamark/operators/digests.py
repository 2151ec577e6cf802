"""Digest trees: what two copies hold, by ranges of the key's hash, so that only ranges that differ are compared.

A row's digest covers its canonical key and values, so copies agree whatever
types hold them. A leaf is a range of key hashes with the number of its rows and
the sum and xor of their digests. These merge by adding, so a node above is the
sum of its leaves, an append adds its own tree, and a tree of a version is
the sum of its folders' trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, key_text
from .verify import compare

LEAF_BITS, NODE_BITS = 16, 8
#: Sums of the digest's halves cannot overflow before 2^31 rows a leaf.
SUMS = ("n", "low", "high", "x")
HALF = 0xFFFFFFFF


def key_hash(keys: list[str], schema: T.StructType, kinds: dict[str, str] | None = None) -> Column:
    return F.xxhash64(key_text(keys, schema, kinds))


def place(hashed: Column, bits: int) -> Column:
    """The range of a hash: its first ``bits`` bits."""
    return F.shiftrightunsigned(hashed, 64 - bits)


def sums(digest: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(digest.bitwiseAND(F.lit(HALF))).alias("low"), F.sum(F.shiftrightunsigned(digest, 32)).alias("high"), F.bit_xor(digest).alias("x")]


def row_digest(df: DataFrame, keys: list[str], columns: list[str], kinds: dict[str, str] | None = None) -> Column:
    """64 bits of a row's key and values by kind; NULL differs from every text."""
    kinds = kinds or {}
    cells = [canonical(F.col(f"`{c}`"), df.schema[c].dataType, kinds.get(c)) for c in columns]
    return F.xxhash64(key_text(keys, df.schema, kinds), F.to_json(F.array(*cells)) if cells else F.lit(""))


def tree(df: DataFrame, keys: list[str], columns: list[str], kinds: dict[str, str] | None = None, bits: int = LEAF_BITS) -> DataFrame:
    """Leaves of ``df``: ``node, n, low, high, x``. One aggregate without a join; at most 2^bits rows."""
    if not keys:
        raise ValueError("rows without key columns have no place in a tree")
    return df.select(place(key_hash(keys, df.schema, kinds), bits).alias("node"), row_digest(df, keys, columns, kinds).alias("d")).groupBy("node").agg(*sums(F.col("d")))


def merge(*trees: DataFrame) -> DataFrame:
    """The tree of all rows of several trees."""
    out = trees[0].select("node", *SUMS)
    for t in trees[1:]:
        out = out.union(t.select("node", *SUMS))
    return out.groupBy("node").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("x").alias("x"))


def roll_up(leaves: DataFrame, bits: int, to: int) -> DataFrame:
    """Nodes of ``to`` bits above leaves of ``bits`` bits."""
    return merge(leaves.withColumn("node", F.shiftrightunsigned("node", bits - to)))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (``node``) whose sums differ, or that one side lacks."""
    j = a.select("node", F.struct(*SUMS).alias("a")).join(b.select("node", F.struct(*SUMS).alias("b")), "node", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def descend(a: DataFrame, b: DataFrame, bits: int = LEAF_BITS, above: int = NODE_BITS) -> DataFrame:
    """Leaves that differ: only those below nodes of ``above`` bits that differ are looked at."""
    open_nodes = differing(roll_up(a, bits, above), roll_up(b, bits, above)).withColumnRenamed("node", "above")

    def below(t: DataFrame) -> DataFrame:
        return t.withColumn("above", F.shiftrightunsigned("node", bits - above)).join(F.broadcast(open_nodes), "above", "left_semi").drop("above")  # at most 2^above rows

    return differing(below(a), below(b))


def compared_columns(expected: DataFrame, actual: DataFrame, keys: list[str], volatile: set[str] = frozenset(), mark: str | None = None) -> list[str]:
    return [c for c in expected.columns if c in actual.columns and c not in keys and c not in volatile and c != mark]


def in_ranges(df: DataFrame, ranges: DataFrame, keys: list[str], bits: int, kinds: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key lies in one of the ``ranges (node)``; at most 2^bits of them, which bounds the broadcast."""
    return df.withColumn("_node", place(key_hash(keys, df.schema, kinds), bits)).join(F.broadcast(ranges.withColumnRenamed("node", "_node")), "_node", "left_semi").drop("_node")


def compare_ranges(expected: DataFrame, actual: DataFrame, ranges: DataFrame, keys: list[str], bits: int = LEAF_BITS, kinds: dict[str, str] | None = None, **how) -> DataFrame:
    """``verify.compare`` of the rows in ``ranges`` alone: equal ranges are neither shuffled nor joined."""
    return compare(in_ranges(expected, ranges, keys, bits, kinds), in_ranges(actual, ranges, keys, bits, kinds), keys, kinds=kinds, **how)


def compare_by_digest(expected: DataFrame, actual: DataFrame, keys: list[str], kinds: dict[str, str] | None = None, volatile: set[str] = frozenset(), mark: str | None = None, bits: int = LEAF_BITS, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What ``verify.compare`` finds wrong, from digest trees: its rows of class missing, different and extra.

    Both sides are read once for their trees, with an aggregate that Spark
    combines before its small shuffle; ``trees`` kept beside the data save that
    too. Rows of ranges that agree are not joined. A key that stands several
    times counts as a set of rows: it is only looked at where the sets differ.
    Values of floats that agree within their tolerance but not in every digit
    make a range differ, and are then found the same. An empty side has no leaves.
    """
    columns = compared_columns(expected, actual, keys, volatile, mark)
    a, b = trees or (tree(expected, keys, columns, kinds, bits), tree(actual, keys, columns, kinds, bits))
    found = compare_ranges(expected, actual, descend(a, b, bits, min(NODE_BITS, bits)), keys, bits, kinds, volatile=volatile, mark=mark)
    return found.where("class <> 'same'")


def report_by_digest(leaves: DataFrame, wrong: DataFrame) -> DataFrame:
    """``verify.report``'s row: the number checked comes from the expected side's ``leaves``."""
    n = {k: F.count_if(F.col("class") == k).alias(k) for k in ("missing", "different", "extra")}
    checked = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"))
    return checked.crossJoin(wrong.agg(*n.values(), (F.count("*") == 0).alias("in_sync")))  # one row each
