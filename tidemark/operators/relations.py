"""Relationships between tables: which columns' values are contained in a key column of another table.

Every column leaves one bottom-k sketch of its values' hashes; sketches merge in an aggregation, and their overlaps name the
candidates. Only those are checked exactly, by semi joins of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.upsert import union_all
from tidemark.sources.tables import stored

LG_ENTRIES = 12  # 4,096 hashes a sketch
MARGIN = 0.1  # estimates this far below the threshold are still checked, besides what chance explains
FEW = 5  # columns of which a pair of sketches holds fewer values are always checked
LONG = 64  # longer texts are compared by digest


def _value(field: T.StructField) -> Column | None:
    """A value's text where columns of its type can refer to one another, else nothing."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.IntegralType, T.StringType, T.DateType)):
        text = c.cast("string")
        return F.when(F.length(text) <= LONG, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))
    return None


def _kind(field: T.StructField) -> str:
    return "number" if isinstance(field.dataType, T.IntegralType) else "date" if isinstance(field.dataType, T.DateType) else "text"


def _values(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(tbl, col, kind, value) of the comparable columns of one table; a null is no value."""
    entries = []
    for f in df.schema.fields:
        v = _value(f)
        if v is not None and (columns is None or f.name in columns):
            entries.append(F.struct(F.lit(f.name).alias("col"), F.lit(_kind(f)).alias("kind"), v.alias("value")))
    if not entries:
        return df.sparkSession.createDataFrame([], "tbl string, col string, kind string, value string")
    return df.select(F.inline(F.array(*entries))).where("value IS NOT NULL").select(F.lit(name).alias("tbl"), "col", "kind", "value")


def column_sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, col, kind, rows, sketch): one sketch per column, built by partial aggregation."""
    parts = [_values(df, name).groupBy("tbl", "col", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.theta_sketch_agg("value", LG_ENTRIES).alias("sketch")) for name, df in tables.items()]
    return union_all(*parts)


def candidates(sketches: DataFrame, threshold: float) -> DataFrame:
    """(tbl, col, ref_tbl, ref_col, estimate) of columns that may lie in a key column of another table.

    A column may be a key if its sketch holds about as many values as it has rows. Both sketches show the same share of all
    hashes, so of a column's hashes shown, those in the other sketch are the estimate: exactly 1 for a column that is
    contained, whatever the sizes. Below that, three standard deviations of such a count are allowed for. There is one row
    per column on either side, so the number of pairs is set by the schemas.
    """
    one = sketches.withColumn("distinct", F.theta_sketch_estimate("sketch").cast("double")).where("distinct > 0")
    child = one.select("tbl", "col", "kind", F.col("distinct").alias("_n"), F.col("sketch").alias("_a"))
    keys = one.where(F.col("distinct") >= (1 - MARGIN) * F.col("rows")).select(
        F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.col("kind").alias("_kind"), F.col("distinct").alias("_m"), F.col("sketch").alias("_b"))
    met = child.join(keys, (F.col("kind") == F.col("_kind")) & (F.col("tbl") != F.col("ref_tbl")))
    held = F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).cast("double")
    alone = F.theta_sketch_estimate(F.theta_difference("_a", "_b")).cast("double")
    shown = F.col("_n") * F.least(F.lit(1.0), 2 ** LG_ENTRIES / F.greatest("_n", "_m"))
    chance = 3 * F.sqrt(threshold * (1 - threshold) / F.greatest(shown, F.lit(1.0)))
    out = met.select("tbl", "col", "ref_tbl", "ref_col", F.coalesce(F.try_divide(held, held + alone), F.lit(1.0)).alias("estimate"), shown.alias("_shown"), chance.alias("_chance"))
    return out.where((F.col("_shown") < FEW) | (F.col("estimate") >= threshold - MARGIN - F.col("_chance"))).drop("_shown", "_chance")


def relationships(tables: dict[str, DataFrame], threshold: float = 0.95) -> DataFrame:
    """(tbl, col, ref_tbl, ref_col, values, contained, containment, coverage, rows, ref_values), exact.

    ``containment`` is the share of a column's distinct values that the key column has, ``coverage`` the share of the key
    column's values that are referred to. Key columns repeat no value; nulls are no values, so a column without any is in no
    relationship. Integral numbers, dates and texts refer to columns of their own kind in other tables. Values are counted
    per column before they meet, and only columns that the sketches name are read again.
    """
    sketches = stored(column_sketches(tables), "sketches")
    found = [r.asDict() for r in candidates(sketches, threshold).collect()]  # pairs of columns: bounded by the schemas
    spark = next(iter(tables.values())).sparkSession
    names = "tbl string, col string, ref_tbl string, ref_col string, estimate double"
    pairs = spark.createDataFrame([tuple(r.values()) for r in found], names)
    asked: dict[str, set[str]] = {}
    for r in found:
        asked.setdefault(r["tbl"], set()).add(r["col"])
        asked.setdefault(r["ref_tbl"], set()).add(r["ref_col"])
    empty = spark.createDataFrame([], "tbl string, col string, kind string, value string")
    values = union_all(empty, *[_values(tables[t], t, sorted(cols)) for t, cols in asked.items()])
    counts = stored(values.groupBy("tbl", "col", "value").agg(F.count(F.lit(1)).alias("n")), "distinct-values")
    sizes = counts.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    keys = sizes.where("most = 1").select(F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.col("values").alias("ref_values"))
    checked = pairs.join(F.broadcast(keys), ["ref_tbl", "ref_col"])
    # Each distinct value once per candidate pair on either side; the small table of pairs is bounded by the schemas.
    mine = counts.join(F.broadcast(checked.select("tbl", "col", "ref_tbl", "ref_col")), ["tbl", "col"]).select("tbl", "col", "ref_tbl", "ref_col", "value")
    theirs = counts.select(F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), "value")
    held = mine.join(theirs, ["ref_tbl", "ref_col", "value"], "left_semi").groupBy("tbl", "col", "ref_tbl", "ref_col").agg(
        F.count(F.lit(1)).alias("contained"))
    out = held.join(sizes.select("tbl", "col", "values", "rows"), ["tbl", "col"]).join(keys, ["ref_tbl", "ref_col"])
    return out.select(
        "tbl", "col", "ref_tbl", "ref_col", "values", "contained", (F.col("contained") / F.col("values")).alias("containment"),
        (F.col("contained") / F.col("ref_values")).alias("coverage"), "rows", "ref_values").where(F.col("containment") >= threshold)
