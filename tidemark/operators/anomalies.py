"""Anomaly timeline: a robust seasonal baseline per series, single outliers, and level shifts by binary segmentation.

Values are turned into whole numbers first, so that sums do not depend on their order and a split is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.upsert import union_all
from tidemark.sources.tables import stored

SPREAD = 1.4826  # median absolute deviation to standard deviation, for normal values


def baseline(points: DataFrame, season: Column, unit: float = 0.01) -> DataFrame:
    """(series, at, value, season, expected, left, scale): each point with its season's median and what it leaves.

    ``points`` has (series, at, value), one row per series and point in time. ``left`` is the distance from the median of
    the same series and season in whole ``unit``, ``scale`` the median of the distances' size in the series. Points without
    a value, a time or a series are left out. Medians come from counts of equal values, so no group is gathered.
    """
    rows = points.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("at").isNotNull() & F.col("series").isNotNull())
    rows = stored(rows.select("series", "at", "value", season.alias("season"), F.round(F.col("value") / unit).cast("bigint").alias("units")), "points")
    middle = _medians(rows, ["series", "season"], "units").withColumnRenamed("median", "expected")
    left = stored(rows.join(middle, ["series", "season"]).withColumn("left", F.col("units") - F.floor("expected")), "residuals")
    scale = _medians(left.withColumn("size", F.abs("left")), ["series"], "size").withColumnRenamed("median", "scale")
    return left.join(scale, "series").select(
        "series", "at", "value", "season", (F.col("expected") * unit).alias("expected"), "left", "scale")


def _medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) exactly: equal values are counted before the shuffle, and counts are added up in blocks of the values' range.

    A block's total is one row, so a window holds the distinct values of one block, not those of a group.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_n").alias("_all"))
    width = F.floor((F.col("_hi") - F.col("_lo")) / 1024) + 1
    counts = counts.join(ends, by).withColumn("_block", F.floor((F.col(value) - F.col("_lo")) / width))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_size"), F.first("_all").alias("_all"))
    start = F.sum("_size").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    blocks = blocks.withColumn("_start", start)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda k: (k >= F.col("_start")) & (k < F.col("_start") + F.col("_size"))
    near = blocks.where(holds(low) | holds(high)).select(*by, "_block", "_start")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    placed = counts.join(near, [*by, "_block"]).withColumn("_end", upto)
    has = lambda k: (k >= F.col("_end") - F.col("_n")) & (k < F.col("_end"))
    return placed.groupBy(*by).agg(((F.max(F.when(has(low), F.col(value))) + F.max(F.when(has(high), F.col(value)))) / 2).alias("median"))


def outliers(left: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """Points further from their season's median than ``sigmas`` robust deviations, with that many as ``score``."""
    score = F.try_divide(F.col("left"), SPREAD * F.col("scale"))
    return left.withColumn("score", score).where(F.abs("score") > sigmas).select("series", "at", "value", "expected", "score")


def _before(df: DataFrame, by: list[str], block: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over all earlier rows of its group: those within its block, plus what the blocks before add up to.

    No window holds more than one block's rows or one group's blocks, so a series may be of any length.
    """
    inside = Window.partitionBy(*by, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = totals.select(*by, block, *[F.coalesce(F.sum(n).over(blocks), F.lit(0)).alias(f"_{n}") for n in sums])
    here = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()]).join(starts, [*by, block])
    return here.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*[f"_{n}" for n in sums])


def level_shifts(left: DataFrame, sigmas: float = 6.0, least: int = 10, depth: int = 4, block: Column | None = None) -> DataFrame:
    """(series, at, level, before, after, strength, points): where the level of ``left`` changes, by binary segmentation.

    Each round cuts every segment of every series at the place that lowers the squared error most: with sums S and counts n
    of the two sides by S1^2 / n1 + S2^2 / n2 - S^2 / n, straight from sums over all earlier points. A cut counts if it
    leaves ``least`` points on either side and its ``strength``, the root of that gain in robust deviations, passes
    ``sigmas``; equal gains go to the earlier place. ``at`` is the first point of the new level, ``before`` and ``after``
    are the means on either side, ``level`` is the round, ``points`` the segment's size. All segments of a round are cut
    together, and ``depth`` rounds find up to 2^depth - 1 shifts a series. Series without spread have no shift, nor have
    empty tables. ``block`` divides the time so that a window never holds a whole series; months by default.
    """
    months = F.date_trunc("month", "at") if block is None else block
    rows = left.select("series", "at", "left", "scale", months.alias("block"), F.lit(0).cast("bigint").alias("part")).where("scale > 0")
    by, found = ["series", "part"], []
    wide = lambda c: F.col(c).cast("double")
    for level in range(1, depth + 1):
        tried = _before(rows, by, "block", "at", {"n1": F.lit(1).cast("bigint"), "s1": F.col("left")}).join(
            rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("s")), by)
        tried = tried.withColumns({"n2": F.col("n") - F.col("n1"), "s2": F.col("s") - F.col("s1")}).where((F.col("n1") >= least) & (F.col("n2") >= least))
        gain = wide("s1") * wide("s1") / wide("n1") + wide("s2") * wide("s2") / wide("n2") - wide("s") * wide("s") / wide("n")
        tried = tried.withColumn("strength", F.sqrt(F.greatest(gain, F.lit(0.0))) / (SPREAD * F.col("scale"))).where(F.col("strength") > sigmas)
        early = (-F.unix_micros(F.col("at").cast("timestamp"))).alias("early")
        best = tried.groupBy(*by).agg(F.max_by(F.struct("at", "n1", "s1", "n2", "s2", "strength"), F.struct("strength", early)).alias("cut"))
        best = stored(best.select(*by, "cut.*"), "cuts")
        found.append(best.withColumn("level", F.lit(level)))
        if level < depth:
            cut = best.select(*by, F.col("at").alias("cut"))
            right = (F.col("at") >= F.col("cut")).cast("bigint")
            rows = stored(rows.join(cut, by).withColumn("part", F.col("part") * 2 + right).drop("cut"), "segments")
    return union_all(*found).select(
        "series", "at", "level", (F.col("s1") / F.col("n1")).alias("before"), (F.col("s2") / F.col("n2")).alias("after"), "strength",
        (F.col("n1") + F.col("n2")).alias("points"))
