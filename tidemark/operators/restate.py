"""Restated history: which months of which tickers changed in the input, and metrics recomputed and rewritten only there."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.analytics import MODULES, benchmark_members, mean_return_benchmark
from tidemark.session import pin
from tidemark.sources.sinks import exists, partition_values, write_analytics
from tidemark.sources.tables import stored

# Bars before a date that the longest frame of the modules can reach: 252 returns end one row before, drawdowns hold 253 prices.
WARMUP = 254
# Modules whose rows follow from the ticker's own bars alone, and those of them that remember all of its history.
OWN = ("returns", "technical")
ENDLESS = ("technical",)


def month_of(date: str = "date"):
    return F.date_format(date, "yyyy-MM")


def digests(prices: DataFrame) -> DataFrame:
    """(ticker, month, bars, digest): one row per ticker and month that any change of a bar changes; the order of bars does not."""
    values = [c for c in sorted(prices.columns) if c != "ticker"]
    return prices.where("ticker IS NOT NULL AND date IS NOT NULL").groupBy("ticker", month_of().alias("month")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("digest"))


def changed_since(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ticker, since): the first month of each ticker whose bars are new, gone or other than before."""
    before = old.select("ticker", "month", F.struct("bars", "digest").alias("before"))
    after = new.select("ticker", "month", F.struct("bars", "digest").alias("after"))
    return before.join(after, ["ticker", "month"], "full").where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("ticker").agg(
        F.min("month").alias("since"))


def _reach(prices: DataFrame, since: str) -> str:
    """The earliest date that a metric of the month ``since`` or later may look at, over all tickers.

    Only bars on dates with a benchmark return count as warm-up, since the frames of beta skip the others; and the benchmark's
    own price is carried forward from its last date before.
    """
    start = F.to_date(F.lit(f"{since}-01"))
    defined = mean_return_benchmark(prices).where(F.col("bench_ret").isNotNull()).select("date")
    older = prices.where(F.col("date") < start).join(F.broadcast(defined), "date", "left_semi")  # one row per calendar date
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    counted = older.select("ticker", "date", back.alias("back"))
    full = counted.where(F.col("back") == WARMUP).select("ticker", "date")
    first = prices.groupBy("ticker").agg(F.min("date").alias("first"))
    reach = first.join(full, "ticker", "left").agg(F.min(F.coalesce("date", "first")).alias("d")).first()["d"]
    member = benchmark_members(prices, None).where(F.col("date") <= F.lit(reach)).agg(F.max("date").alias("d")).first()["d"]
    return min(d for d in (reach, member) if d is not None).isoformat()


def _rewritten(new: DataFrame, path: str, market: str, changed: DataFrame, since: str) -> list[str]:
    """Months from ``since`` on, with the rows of changed tickers replaced by ``new`` ones; gives the months written."""
    spark = new.sparkSession
    months = [m for m in partition_values(spark, path, market=market) if m >= since]  # bounded by the calendar
    held = spark.read.parquet(path).where((F.col("market") == market) & F.col("month").isin(months))
    named = changed.withColumnRenamed("ticker", "_ticker")
    kept = held.join(named, (F.col("ticker") == F.col("_ticker")) & (F.col("month") >= F.col("since")), "left_anti")
    rows = pin(kept.drop("month").select(*new.columns).unionByName(new))  # it replaces the partitions it is read from
    write_analytics(rows, path)
    return sorted(r["month"] for r in rows.select(month_of().alias("month")).distinct().collect())


def restate(prices: DataFrame, market: str, root: str, modules: list[str] | None = None) -> dict[str, list[str]]:
    """Bring the stored modules below ``root`` up to ``prices``; gives the months that were rewritten, by module.

    The digests of the last run say which ticker changed from which month on; without them everything is computed. Metrics
    that follow from a ticker's own bars are recomputed for changed tickers only, those that compare tickers or use the
    benchmark for all of them, from the first changed month on, with the warm-up that the longest frame can reach; metrics
    with an endless memory see all bars of the changed tickers. Months before are neither computed nor written. Digests are
    replaced last, so a run that broke off is done again. Removed bars leave the months that still hold other rows; a month
    that loses all its rows keeps its old ones.
    """
    spark, names = prices.sparkSession, list(MODULES) if modules is None else modules
    prices = prices.where("ticker IS NOT NULL AND date IS NOT NULL")
    book = os.path.join(root, "digests")
    new = stored(digests(prices), "digests")

    def each(one: Callable[[str], list[str]]) -> dict[str, list[str]]:
        """The modules are independent jobs over a stored market table, so they are submitted together."""
        with ThreadPoolExecutor(max_workers=len(names)) as pool:
            return dict(zip(names, pool.map(one, names)))

    def written(m: str) -> list[str]:
        write_analytics(MODULES[m](prices, market), os.path.join(root, m))
        return partition_values(spark, os.path.join(root, m), market=market)

    if not exists(spark, book):
        out = each(written)
        new.write.mode("overwrite").parquet(book)
        return out
    changed = stored(changed_since(spark.read.parquet(book), new), "changed")
    since = changed.agg(F.min("since")).first()[0]
    if since is None:
        return {m: [] for m in names}
    start = F.to_date(F.lit(f"{since}-01"))
    mine = prices.join(changed.select("ticker"), "ticker", "left_semi")
    everyone = prices.select("ticker").distinct().withColumn("since", F.lit(since))
    gone = changed.select("ticker", F.lit(since).alias("since"))
    near = stored(prices.where(F.col("date") >= F.lit(_reach(prices, since)).cast("date")), "restated-bars")

    def rewritten(m: str) -> list[str]:
        path = os.path.join(root, m)
        if m in OWN:
            rows = MODULES[m](mine if m in ENDLESS else near.join(changed.select("ticker"), "ticker", "left_semi"), market)
            return _rewritten(rows.join(changed, "ticker").where(month_of() >= F.col("since")).drop("since"), path, market, changed, since)
        rows = MODULES[m](near, market).where(F.col("date") >= start)
        return _rewritten(rows, path, market, everyone.unionByName(gone).distinct(), since)

    out = each(rewritten)
    new.write.mode("overwrite").parquet(book)
    return out
