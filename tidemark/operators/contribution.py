"""Contribution decomposition: which cells of a lattice of dimensions moved a total between two periods, by volume or rate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upsert import union_all
from tidemark.sources.tables import stored

SUMS = ("n0", "n1", "v0", "v1", "down", "up")


def cells(df: DataFrame, dims: list[str], value: Column, period: Column) -> DataFrame:
    """The finest cells: counts and sums of both periods, and how far a part of the cell could move the total down and up.

    ``period`` is 0 or 1; rows of neither and rows without a value take no part. A null dimension is a value of its own.
    ``value`` must be a whole number, so that parts add up exactly.
    """
    rows = df.select(*[F.col(d).cast("string").alias(d) for d in dims], value.alias("_v"), period.alias("_p")).where("_v IS NOT NULL AND _p IN (0, 1)")
    at = lambda p, c: F.sum(F.when(F.col("_p") == p, c).otherwise(0))
    plus, minus = F.greatest(F.col("_v"), F.lit(0)), F.greatest(-F.col("_v"), F.lit(0))
    return rows.groupBy(*dims).agg(
        at(0, F.lit(1)).alias("n0"), at(1, F.lit(1)).alias("n1"), at(0, F.col("_v")).alias("v0"), at(1, F.col("_v")).alias("v1"),
        (at(0, plus) + at(1, minus)).alias("down"), (at(1, plus) + at(0, minus)).alias("up"))


def _grouped(base: DataFrame, dims: list[str], some: tuple[str, ...]) -> DataFrame:
    out = base.groupBy(*some).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
    return out.select(F.lit(len(some)).alias("level"), F.lit(",".join(some)).alias("dims"),
                      *[F.col(d) if d in some else F.lit(None).cast("string").alias(d) for d in dims], *SUMS)


def parts(df: DataFrame) -> DataFrame:
    """Cells with their change, split into volume (more or fewer rows at the mean rate) and rate (at the mean number of rows).

    A cell that one period lacks has no rate there, so all its change is volume. The two parts always add up to the change.
    """
    change = F.col("v1") - F.col("v0")
    r0, r1 = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    volume = F.when((F.col("n0") > 0) & (F.col("n1") > 0), (F.col("n1") - F.col("n0")) * (r0 + r1) / 2).otherwise(change.cast("double"))
    return df.withColumn("change", change).withColumn("volume", volume).withColumn("rate", F.col("change") - F.col("volume"))


def lattice(base: DataFrame, dims: list[str], levels: int) -> DataFrame:
    """All cells of up to ``levels`` dimensions, the total first. The changes of one set of dimensions add up to the total's."""
    sets = [some for n in range(levels + 1) for some in combinations(dims, n)]
    return parts(union_all(*[_grouped(base, dims, some) for some in sets]))


def top_contributions(base: DataFrame, dims: list[str], levels: int, k: int) -> DataFrame:
    """The ``k`` cells with the largest changes, either way, among all sets of 1 to ``levels`` dimensions.

    Level by level, with all cells that cannot reach the top left out exactly: any part of a cell changes the total by no
    more than ``up`` and no less than ``-down``. Below the k-th largest change found so far, neither the cell nor anything
    inside it is built. Ties go by level, dimensions and their values.
    """
    order = [F.desc(F.abs("change")), "level", "dims", *[F.col(d).asc_nulls_first() for d in dims]]
    best, alive, bound = None, {}, 0
    for level in range(1, levels + 1):
        grown, kept = [], {}
        for some in combinations(dims, level):
            rows = base
            if level > 1:
                for inner in combinations(some, level - 1):
                    rows = _within(rows, alive[inner], inner)
            kept[some] = stored(_grouped(rows, dims, some), "cells")
            grown.append(kept[some])
        new = parts(union_all(*grown))
        best = stored((new if best is None else best.unionByName(new)).orderBy(*order).limit(k), "best")
        low = best.agg(F.count(F.lit(1)).alias("n"), F.min(F.abs("change")).alias("least")).first()
        bound = low["least"] if low["n"] == k else 0
        alive = {some: cells_.where(F.greatest("up", "down") >= bound).select(*some) for some, cells_ in kept.items()}
    return best


def _within(rows: DataFrame, kept: DataFrame, some: tuple[str, ...]) -> DataFrame:
    named = kept.select(*[F.col(d).alias(f"_{d}") for d in some])
    test = F.lit(True)
    for d in some:
        test = test & F.col(d).eqNullSafe(F.col(f"_{d}"))
    return rows.join(named, test, "left_semi")
