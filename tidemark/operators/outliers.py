"""Robust outliers of numeric columns by three rules: quartile fences, standard scores and median absolute deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import exact_quantiles
from tidemark.sources.tables import stored

INFINITE = float("inf")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all values that are numbers; NaN is missing, infinite values stay."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, value double")
    return df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull() & ~F.isnan("value"))


def limits(df: DataFrame, columns: list[str], fence: float = 1.5, sigmas: float = 3.0, deviations: float = 3.5) -> DataFrame:
    """(column, rows, p25, median, p75, mad, mean, std and the bounds of the three rules), one row per column.

    The median of deviations is a quantile of distances from another quantile, exact at any size: the bracket passes run
    once over the values and once over their distances. Mean and deviation are those of the finite values. A rule that has
    no spread to measure by (no quartile range, no deviation) has null bounds. Distances of an infinite value are infinite.
    """
    long = _long(df, columns)
    middle = stored(exact_quantiles(long, ["column"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}), "quartiles")
    away = long.join(F.broadcast(middle.select("column", "median")), "column").select(  # one row per column
        "column", F.when(F.col("value") == F.col("median"), 0.0).otherwise(F.abs(F.col("value") - F.col("median"))).alias("away"))
    mad = exact_quantiles(away, ["column"], "away", {"mad": 0.5})
    finite = F.when(F.abs("value") < INFINITE, F.col("value"))
    moments = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"))
    one = middle.join(mad, "column").join(moments, "column")

    def around(low: Column, high: Column, step: Column) -> list[Column]:
        some = (step > 0) & (step < INFINITE)
        return [F.when(some, low - step), F.when(some, high + step)]

    box, z = fence * (F.col("p75") - F.col("p25")), sigmas * F.col("std")
    robust = deviations * F.col("mad") / 0.6745
    bounds = [*around(F.col("p25"), F.col("p75"), box), *around(F.col("mean"), F.col("mean"), z), *around(F.col("median"), F.col("median"), robust)]
    names = ["iqr_low", "iqr_high", "z_low", "z_high", "mad_low", "mad_high"]
    return one.select("column", "rows", "p25", "median", "p75", "mad", "mean", "std", *[b.alias(n) for b, n in zip(bounds, names)])


def _outside(rule: str) -> Column:
    return (F.col("value") < F.col(f"{rule}_low")) | (F.col("value") > F.col(f"{rule}_high"))


def outlier_summary(df: DataFrame, columns: list[str] | None = None, **rules: float) -> DataFrame:
    """``limits`` with the rows outside of them and their share, and a level: medium above 5 % by two rules, info above 0.

    Rows on a bound are inside. An infinite value is outside every rule that has bounds. Columns without a number give no
    row, nor do empty tables.
    """
    columns = numeric_columns(df) if columns is None else columns
    bounds = stored(limits(df, columns, **rules), "limits")
    names = ["iqr", "z", "mad"]
    hits = _long(df, columns).join(F.broadcast(bounds.select("column", *[c for c in bounds.columns if c.endswith(("_low", "_high"))])), "column")
    counts = hits.groupBy("column").agg(*[F.count(F.when(_outside(r), 1)).alias(f"{r}_rows") for r in names])
    out = bounds.join(counts, "column")
    share = {r: F.col(f"{r}_rows") / F.col("rows") for r in names}
    many = sum((F.when(s > 0.05, 1).otherwise(0) for s in share.values()), F.lit(0))
    some = sum((F.when(s > 0, 1).otherwise(0) for s in share.values()), F.lit(0))
    level = F.when(many >= 2, "medium").when(some > 0, "info")
    return out.select("*", *[s.alias(f"{r}_share") for r, s in share.items()], level.alias("level"))


def outlier_rows(df: DataFrame, columns: list[str], least: int = 2, **rules: float) -> DataFrame:
    """Rows of ``df`` with ``outlying``: (column, value, rules) of each value that at least ``least`` rules hold for one."""
    bounds = limits(df, columns, **rules).collect()  # one row per column
    found = []
    for b in bounds:
        x = F.col(f"`{b['column']}`").cast("double")
        hits = [F.when((x < b[f"{r}_low"]) | (x > b[f"{r}_high"]), 1).otherwise(0) for r in ("iqr", "z", "mad") if b[f"{r}_low"] is not None]
        n = sum(hits, F.lit(0))
        found.append(F.when(~F.isnan(x) & (n >= least), F.struct(F.lit(b["column"]).alias("column"), x.alias("value"), n.alias("rules"))))
    if not found:
        return df.withColumn("outlying", F.array().cast("array<struct<column:string,value:double,rules:int>>")).where("false")
    return df.withColumn("outlying", F.array_compact(F.array(*found))).where(F.size("outlying") > 0)
