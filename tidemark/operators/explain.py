"""Target explanation: how much each column tells about a target column, alone and beside the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import exact_quantiles
from tidemark.sources.tables import stored


def _number(field: T.StructField) -> Column | None:
    """The value as a double if the column is put into bins; NaN is missing."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(field.dataType, T.NumericType):
        x = c.cast("double")
        return F.when(~F.isnan(x), x)
    return None


def binned(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``columns`` as texts: numbers and dates by the bin between the column's exact quantiles, others as they are, null as ''.

    A value's bin is the number of cuts below it, so equal values share a bin and a constant column has one.
    """
    numbers = {f.name: x for f in df.schema.fields if f.name in columns and (x := _number(f)) is not None}
    cuts: dict[str, list[float]] = {}
    if numbers:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), x.alias("value")) for n, x in numbers.items()])))
        probs = {f"q{i}": i / bins for i in range(1, bins)}
        for r in exact_quantiles(long, ["column"], "value", probs).collect():  # one row per column
            cuts[r["column"]] = [r[q] for q in probs]
    out = []
    for name in columns:
        if name in numbers:
            over = sum((F.when(numbers[name] > F.lit(cut), 1).otherwise(0) for cut in cuts.get(name, [])), F.lit(0))
            out.append(F.coalesce(F.when(numbers[name].isNotNull(), over).cast("string"), F.lit("")).alias(name))
        else:
            out.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def _sizes(counts: DataFrame, by: list[str]) -> DataFrame:
    """(column, s, k) per column: sum of n ln n and number of cells, when counts are gathered by ``by``."""
    cells = counts.groupBy("column", *by).agg(F.sum("n").cast("double").alias("n"))
    return cells.groupBy("column").agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.count(F.lit(1)).alias("k"))


def _joined(**parts: DataFrame) -> DataFrame:
    out = None
    for name, df in parts.items():
        named = df.select("column", F.col("s").alias(f"s_{name}"), F.col("k").alias(f"k_{name}"))
        out = named if out is None else out.join(named, "column")
    return out


def explain_target(df: DataFrame, target: str, columns: list[str], bins: int = 10) -> DataFrame:
    """(column, information, corrected, share, given, beside, place) for each column but the target.

    ``information`` is the mutual information of column and target in nats, ``corrected`` the same less the bias that comes
    from the number of cells seen (half a cell per row on each entropy), ``share`` the corrected part of the target's own
    entropy. ``beside`` is the corrected information a column adds once the best one, named in ``given``, is known; null
    for that one. Numbers and dates are cut at their quantiles; a null is a value of its own. Contingency tables of all
    columns are counted in one pass with map-side combine, those beside the best column in a second. Ties go by name.
    """
    names = [c for c in columns if c != target]
    rows = stored(binned(df, [target, *names], bins), "binned")
    y = F.col(f"`{target}`").alias("y")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("x")) for c in names])
    pairs = stored(rows.select(y, F.inline(entries)).groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n")), "contingency")
    n = pairs.groupBy("column").agg(F.sum("n").cast("double").alias("N"))
    one = _joined(x=_sizes(pairs, ["x"]), y=_sizes(pairs, ["y"]), xy=_sizes(pairs, ["x", "y"])).join(n, "column")
    info = (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / F.col("N") + F.log("N")
    entropy = F.log("N") - F.col("s_y") / F.col("N") + (F.col("k_y") - 1) / (2 * F.col("N"))
    corrected = info + (F.col("k_x") + F.col("k_y") - F.col("k_xy") - 1) / (2 * F.col("N"))
    alone = one.select("column", info.alias("information"), corrected.alias("corrected"), F.try_divide(corrected, entropy).alias("share"))
    alone = stored(alone, "information")
    best = alone.orderBy(F.round("corrected", 12).desc(), "column").first()
    if best is None:
        return alone.select("*", F.lit("").alias("given"), F.lit(0.0).alias("beside"), F.lit(0).alias("place"))
    given = best["column"]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("x")) for c in names if c != given] or [
        F.struct(F.lit(given).alias("column"), F.col(f"`{given}`").alias("x"))])
    triples = stored(rows.select(y, F.col(f"`{given}`").alias("z"), F.inline(entries)).where(F.col("column") != given).groupBy(
        "column", "x", "z", "y").agg(F.count(F.lit(1)).alias("n")), "contingency")
    both = _joined(zx=_sizes(triples, ["z", "x"]), zy=_sizes(triples, ["z", "y"]), zxy=_sizes(triples, ["z", "x", "y"]), z=_sizes(triples, ["z"]))
    both = both.join(triples.groupBy("column").agg(F.sum("n").cast("double").alias("N")), "column")
    more = (F.col("s_zxy") + F.col("s_z") - F.col("s_zx") - F.col("s_zy") + (F.col("k_zx") + F.col("k_zy") - F.col("k_zxy") - F.col("k_z")) / 2) / F.col("N")
    order = F.row_number().over(Window.orderBy(F.round("corrected", 12).desc(), "column"))  # one row per column
    out = alone.join(both.select("column", more.alias("beside")), "column", "left")
    return out.withColumn("place", order).select("column", "information", "corrected", "share", F.lit(given).alias("given"), "beside", "place")
