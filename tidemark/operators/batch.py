"""One analytics run: every module written to its own table, failures recorded, the rest carried on."""

from __future__ import annotations

import datetime as dt
import logging
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.analytics import MODULES
from tidemark.sources.sinks import partition_values, write_analytics

logger = logging.getLogger(__name__)


def run_analytics(prices: DataFrame, market: str, root: str, modules: list[str] | None = None) -> dict[str, int]:
    """Write each module below ``root`` and give its rows, -1 where it failed.

    The modules are independent jobs over a stored market table, so they are submitted together and share the
    cluster.
    """
    spark = prices.sparkSession
    names = list(MODULES) if modules is None else modules

    def one(name: str) -> int:
        path = os.path.join(root, name)
        try:
            write_analytics(MODULES[name](prices, market), path)
            return spark.read.parquet(path).count()
        except Exception:
            logger.exception("module %s failed", name)
            return -1

    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        return dict(zip(names, pool.map(one, names)))


def stored_modules(spark: SparkSession, root: str, modules: list[str] | None = None) -> dict[str, DataFrame]:
    return {m: spark.read.parquet(os.path.join(root, m)) for m in modules or MODULES}


def newest_modules(spark: SparkSession, root: str, market: str, modules: list[str] | None = None) -> dict[str, DataFrame]:
    """The newest month of each stored module, known from the folders' names: a filter on constants, so nothing else is read.

    Modules without a row of the market are left out. The newest date of a module lies in its newest month.
    """
    out = {}
    for m in modules or MODULES:
        path = os.path.join(root, m)
        months = partition_values(spark, path, market=market)
        if months:
            out[m] = spark.read.parquet(path).where((F.col("market") == market) & (F.col("month") == months[-1]))
    return out


def run_log(spark: SparkSession, rows: dict[str, int], market: str, run_date: dt.date, run_id: str) -> DataFrame:
    """(run_date, run_id, market, module, rows), one row per module, to be appended to the run log."""
    return spark.createDataFrame(
        [(run_date, run_id, market, m, n) for m, n in rows.items()],
        "run_date date, run_id string, market string, module string, rows bigint")


def append_log(entries: DataFrame, path: str) -> None:
    """Append entries to the run log, laid out by date."""
    entries.write.mode("append").partitionBy("run_date").parquet(path)


def runs_of(spark: SparkSession, path: str, run_date: dt.date) -> DataFrame:
    """Entries of the runs of a date; other dates are not read."""
    return spark.read.parquet(path).where(F.col("run_date") == F.lit(run_date)).select("run_date", "run_id", "market", "module", "rows")
