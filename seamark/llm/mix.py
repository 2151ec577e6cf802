"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. A document's expected copies are the
source's target over its size; documents of a source are laid end to end in
order of size, one random offset is added to the running sum of expected
copies, and a copy is emitted at each integer crossed. So a source of a million
documents takes its target within about one document's words, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, shuffle_width, small

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size -> source, source_size, target``.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's
    size and the excess is shared again by weight until none is above: that is
    min(cap, level * weight) for one level, found from prefix sums in the order
    of cap / weight. The table has a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("held", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("free", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("held")) / F.col("free"))
    # the level is that of the first source whose cap lies above it; if there is none, all are at their caps
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return w.withColumn("level", level).select("source", "source_size", F.round(F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap"), 6).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1), from SHA-256 of seed and source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _planned(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in docs.columns]) if whole else F.lit(None).cast("struct<x:int>")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row.alias("row"))
    if not whole:
        rows = materialize(rows, "sizes")
    dealt = rows.repartitionByRange(shuffle_width(spark), "source", "size", "id").sortWithinPartitions("source", "size", "id")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "dealt")
    ranges = dealt.groupBy("part", "source").agg(F.count("*").alias("k"), F.min("place").alias("first"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    t = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "of")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("of"))).select("part", "source", "before", "first", "source_size", "target")
    ranges = small(materialize(ranges, "ranges"))
    j = dealt.alias("d").join(ranges.alias("r"), (F.col("d.part") == F.col("r.part")) & F.col("d.source").eqNullSafe(F.col("r.source")))
    # "place" rises by one within a partition, and a range of one source is contiguous there
    rank = F.col("before") + F.col("place") - F.col("first") + 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = j.select("id", F.col("d.source").alias("source"), "size", "source_size", "target", "row", rank.alias("rank"), rate.alias("rate"), offset(F.col("d.source"), seed).alias("u"))
    copies = F.floor(F.col("u") + F.col("rank") * F.col("rate")) - F.floor(F.col("u") + (F.col("rank") - 1) * F.col("rate"))
    return j.withColumn("copies", copies.cast("int"))


def plan(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, source, size, source_size, target, copies, taken``.

    Size counts words; null text: 0. A null source is a source. A source
    without words has target 0 and no copies. Ranks within a source come from a
    range partitioning by source, size and id with one count for each range and
    source, so a source with a third of all rows is spread over many tasks.
    Repeated rows take ranks of their own. Empty table: no rows.
    """
    j = _planned(docs, seed, id_col, text_col, source_col, False)
    return j.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: rows of ``docs``, all columns, each as often as ``plan`` takes it."""
    j = _planned(docs, seed, id_col, text_col, source_col, True).where("copies > 0")
    return j.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
