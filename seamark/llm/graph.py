"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges (a, b)``: ``(v, root)``.

    Alternating large-star and small-star rounds: in each, every node links its
    neighbourhood to the smallest node it sees, so the number of rounds is
    logarithmic in the longest path. A star's neighbourhood is never gathered:
    only a minimum per node is aggregated and joined back. Each round is written
    to the shared folder, and so is the result, which the caller drops. Null ends and self-links are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).where("u <> m").distinct()
    e = materialize(e, "cc")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("m").alias("u"), F.col("u").alias("m")))
        # written first, so that the join reads both sides by a shuffle of its own and a star with many rays can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("low")), "cc-low")
        # large star: neighbours above u go to the lowest that u sees
        large = both.join(low, "u").where("m > u").select(F.col("m").alias("u"), F.col("low").alias("m")).where("u <> m").distinct()
        # small star: neighbours below u, and u itself, go to the lowest
        lows = large.groupBy("u").agg(F.min("m").alias("low"))
        small = (
            large.join(lows, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("low").alias("m")), F.struct("u", F.col("low").alias("m")))).alias("x"))
            .select("x.u", "x.m")
            .where("u <> m")
            .distinct()
        )
        new = materialize(small, "cc")
        same = new.count() == e.count() and new.join(e, ["u", "m"], "left_anti").isEmpty()
        drop(e, low)
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("m").distinct().select(F.col("m").alias("v"), F.col("m").alias("root"))
    out = materialize(e.select(F.col("u").alias("v"), F.col("m").alias("root")).union(roots), "components")
    drop(e)
    return out
