"""Date continuity: presence bitmaps per key and month, runs and gaps over a calendar, staleness.

A bitmap is one long: bit d - 1 stands for day d of the month. Bitmaps of a key and month merge by OR, so presence of new
files is joined to stored presence without reading the old rows again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """(key, month, days): which days of each month a key has rows on. Rows without a key or a date have no part in it."""
    day = F.col(date).cast("date")
    rows = df.select(F.col(key), day.alias("_day")).where(F.col(key).isNotNull() & F.col("_day").isNotNull())
    return rows.groupBy(key, F.trunc("_day", "month").alias("month")).agg(F.bit_or(_bit(F.col("_day"))).alias("days"))


def merge_presence(*parts: DataFrame) -> DataFrame:
    """Presence of several batches as one: bitmaps of the same key and month merge by OR."""
    key = parts[0].columns[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key, "month").agg(F.bit_or("days").alias("days"))


def _bit(day: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth(day) - 1)


def shared_calendar(found: DataFrame) -> DataFrame:
    """(month, days): the days on which any key has a row. One row per month."""
    return found.groupBy("month").agg(F.bit_or("days").alias("days"))


def weekday_calendar(found: DataFrame) -> DataFrame:
    """(month, days): Monday to Friday of every month between the first and the last with a row."""
    ends = found.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo IS NOT NULL")
    months = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    days = F.expr("filter(sequence(month, last_day(month)), d -> weekday(d) < 5)")
    return months.select("month", F.explode(days).alias("_day")).groupBy("month").agg(F.bit_or(_bit(F.col("_day"))).alias("days"))


def _dates(bitmaps: DataFrame, *kept: str) -> DataFrame:
    """One row per set bit, as a date."""
    set_bits = F.expr("filter(sequence(0, 30), i -> getbit(days, i) = 1)")
    return bitmaps.select(*kept, F.explode(set_bits).alias("_i"), "month").select(*kept, F.expr("date_add(month, _i)").alias("date"))


def calendar_index(calendar: DataFrame) -> DataFrame:
    """(date, di): the calendar's dates numbered from 0. A century of days is 36,525 rows."""
    return _dates(calendar).select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("di"))


def _steps(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """(key, date, di, before, gap): a key's calendar dates, the one before and the calendar dates missing in between."""
    key = found.columns[0]
    at = _dates(found, key).join(F.broadcast(calendar_index(calendar)), "date")
    order = Window.partitionBy(key).orderBy("di")  # a key has at most one row per calendar date
    return at.withColumn("before", F.lag("date").over(order)).withColumn(
        "gap", F.coalesce(F.col("di") - F.lag("di").over(order) - 1, F.lit(0)))


def gaps(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """(key, after, before, missing): every stretch of missing calendar dates between two dates a key has."""
    key = found.columns[0]
    return _steps(found, calendar).where("gap > 0").select(key, F.col("before").alias("after"), F.col("date").alias("before"), F.col("gap").alias("missing"))


def continuity(found: DataFrame, calendar: DataFrame, as_of: dt.date, stale_after: int = 5) -> DataFrame:
    """One row per key: dates it has, runs without a gap, what is missing, the longest gap and run, and how stale it is.

    Dates outside the calendar do not count. ``missing`` counts calendar dates between a key's first and last one, ``behind``
    those after its last one up to ``as_of``; more than ``stale_after`` of these make it stale. Of equally long gaps the
    earliest is named. Keys without any date on the calendar give no row; an empty table gives none either.
    """
    key = found.columns[0]
    run = F.sum(F.when(F.col("gap") > 0, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("di").rowsBetween(Window.unboundedPreceding, 0))
    per_run = _steps(found, calendar).withColumn("run", run).groupBy(key, "run").agg(
        F.count(F.lit(1)).alias("length"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("di").alias("di"),
        F.max("gap").alias("gap"), F.min_by("before", "di").alias("before"))
    longest = F.max(F.struct("gap", (-F.unix_date("first")).alias("early"), F.col("before").alias("after"), F.col("first").alias("until")))
    days = calendar_index(calendar).where(F.col("date") <= F.lit(as_of)).agg(F.max("di").alias("today"))
    out = per_run.groupBy(key).agg(
        F.sum("length").alias("dates"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.count(F.lit(1)).alias("runs"),
        F.sum("gap").alias("missing"), F.max("length").alias("longest_run"), longest.alias("_gap"), F.max("di").alias("_di"))
    behind = F.greatest(F.coalesce(F.col("today") - F.col("_di"), F.lit(0)), F.lit(0)).cast("bigint")
    some = F.col("_gap.gap") > 0
    return out.join(F.broadcast(days)).select(
        key, "dates", "first_date", "last_date", "runs", "missing",
        F.round(F.col("dates") / (F.col("dates") + F.col("missing")), 6).alias("coverage"), "longest_run",
        F.col("_gap.gap").cast("bigint").alias("longest_gap"), F.when(some, F.col("_gap.after")).alias("gap_after"),
        F.when(some, F.col("_gap.until")).alias("gap_until"), behind.alias("behind"), (behind > stale_after).alias("stale"))


def missing_by_month(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """(key, month, expected, present, missing) for every calendar month from a key's first to its last one.

    Only bitmaps are compared: within the first and the last month, days outside the key's own span are masked away.
    """
    key = found.columns[0]
    low = F.expr("date_add(month, bit_count((days & -days) - 1))")
    high = F.expr("date_add(month, length(bin(days)) - 1)")
    spans = found.groupBy(key).agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    months = spans.join(F.broadcast(calendar), F.col("month").between(F.trunc("lo", "month"), F.trunc("hi", "month")))
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    from_first = F.when(F.col("month") == F.trunc("lo", "month"), ones(F.dayofmonth("lo") - 1)).otherwise(F.lit(0).cast("bigint"))
    to_last = F.when(F.col("month") == F.trunc("hi", "month"), ones(F.dayofmonth("hi"))).otherwise(ones(F.lit(31)))
    wanted = F.col("days").bitwiseAND(to_last).bitwiseAND(F.bitwise_not(from_first))
    mine = found.select(key, "month", F.col("days").alias("_own"))
    both = months.select(key, "month", wanted.alias("wanted")).join(mine, [key, "month"], "left")
    has = F.bit_count(F.col("wanted").bitwiseAND(F.coalesce("_own", F.lit(0).cast("bigint"))))
    return both.select(key, "month", F.bit_count("wanted").alias("expected"), has.alias("present"), (F.bit_count("wanted") - has).alias("missing"))
