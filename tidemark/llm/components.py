"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id reachable from each id of the edges (u, v), as 64-bit numbers.

    Each round links every id to the smallest of its neighbours, first those above it, then those below, until nothing
    changes; a chain halves about every round. Minima are combined before the shuffle and joined back, so an id with very
    many neighbours is never gathered in one place. Every round is written, which cuts lineage. Raises if ``rounds`` do not
    suffice, rather than return parts.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(pairs, "edges")
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small, "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
