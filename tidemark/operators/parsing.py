"""Parse success of text columns: which number or date format fits best, how often, and what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = 40  # no number or date is longer; longer values share one mask

# Formats from the narrowest to the widest: a value of one is also one of those that follow it in its own line.
NUMBERS = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$",
    "scientific": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "grouped": r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$",
    "decimal comma": r"^[+-]?[0-9]+,[0-9]+$",
    "currency": r"^[+-]?[$€£] ?[0-9]+(,[0-9]{3})*(\.[0-9]+)?$",
    "percent": r"^[+-]?[0-9]+(\.[0-9]+)? ?%$",
}
DATES = {
    "yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "yyyy/MM/dd": r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    "dd/MM/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "MM/dd/yyyy": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "dd.MM.yyyy": r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$",
    "yyyyMMdd": r"^[0-9]{8}$",
    "yyyy-MM-dd HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
}
FORMATS = [*NUMBERS, *DATES]


def mask(value: Column) -> Column:
    """The shape of a trimmed value: 9 for a digit, A for a letter but e and E, which numbers may hold; # for a long one."""
    text = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-DF-Za-df-z]", "A")
    return F.when(F.length(value) > LONG, "#").otherwise(text)


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mask, dates, n, example): how often each shape occurs, and its smallest value.

    Shapes decide which number formats fit. Whether a date exists is a matter of the value, so ``dates`` has a bit for each
    date format that the value is a day of; it is looked at only where the shape allows it. Counts are combined before the
    shuffle: a column leaves a task as a few shapes. Nulls and blank values have no shape.
    """
    entries = [F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*entries))).where("value <> ''")
    bits = F.lit(0)
    for i, (form, shape) in enumerate(DATES.items()):
        fits = F.col("value").rlike(shape) & F.try_to_timestamp("value", F.lit(form)).isNotNull()
        bits = bits + F.when(fits, 1 << i).otherwise(0)
    return long.withColumn("dates", F.when(F.length("value") <= 19, bits).otherwise(0)).groupBy("column", mask(F.col("value")).alias("mask"), "dates").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("example"))


def format_counts(found: DataFrame) -> DataFrame:
    """(column, format, width, n, parsed, failing): values that each format can read, and the smallest value it cannot."""
    shape = F.regexp_replace("mask", "[A-DF-Za-df-z]", "x")
    tests = [F.when(shape.rlike(p), 1).otherwise(0) for p in NUMBERS.values()]
    tests += [F.when(F.col("dates").bitwiseAND(F.lit(1 << i)) > 0, 1).otherwise(0) for i in range(len(DATES))]
    entries = [F.struct(F.lit(f).alias("format"), F.lit(i).alias("width"), t.alias("fits")) for i, (f, t) in enumerate(zip(FORMATS, tests))]
    return found.select("column", "n", "example", F.inline(F.array(*entries))).groupBy("column", "format", "width").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("fits")).alias("parsed"), F.min(F.when(F.col("fits") == 0, F.col("example"))).alias("failing"))


def parse_success(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """(column, kind, format, values, parsed, share, failing, alert) of each column that has values.

    The format that reads most values is named, the narrowest of those that read equally many; columns of which no format
    reads the share ``least`` are texts, without a format. ``failing`` is the smallest value that the format cannot read.
    Number columns with more than 20 % failures and date columns with less than 80 % success raise an alert. Blank values
    and nulls do not count; empty tables give no rows.
    """
    order = Window.partitionBy("column").orderBy(F.desc("parsed"), "width")  # one row per format
    best = format_counts(shapes(df, columns)).withColumn("place", F.row_number().over(order)).where("place = 1")
    share = F.col("parsed") / F.col("n")
    read = share >= least
    kind = F.when(~read, "text").when(F.col("width") < len(NUMBERS), "number").otherwise("date")
    return best.select(
        "column", kind.alias("kind"), F.when(read, F.col("format")).alias("format"), F.col("n").alias("values"),
        F.when(read, F.col("parsed")).otherwise(0).alias("parsed"), F.when(read, share).otherwise(0.0).alias("share"),
        F.when(read, F.col("failing")).alias("failing"),
        F.when(kind == "number", F.when(share < 0.8, "high")).when(kind == "date", F.when(share < 0.8, "medium")).alias("alert"))
