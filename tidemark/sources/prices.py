"""Readers of market tables and of metric history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prep import lookback, without_nan
from tidemark.operators.upsert import union_all
from tidemark.schemas import HISTORY_COLUMNS, MARKET_SCHEMA


def scan_prices(spark: SparkSession, path: str, as_of: dt.date | None = None, lookback_days: int | None = None) -> DataFrame:
    """Bars of one market, NaN as null; the date bound is pushed to the parquet scan."""
    df = without_nan(spark.read.schema(MARKET_SCHEMA).parquet(path))
    if lookback_days is not None:
        df = lookback(df, as_of, lookback_days)
    return df


def _quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def jdbc_predicates(tickers: Iterable[str] | None = None, cap: str | None = None, since: dt.date | None = None,
                    slices: int = 1, until: dt.date | None = None) -> list[str]:
    """WHERE clauses for a partitioned JDBC read: one per date slice, all with the ticker and tier tests."""
    tests = []
    if tickers is not None:
        tests.append(f"upper(ticker) IN ({_quoted(t.upper() for t in tickers)})")
    if cap:
        tests.append(f"upper(cap_category) = {_quoted([cap.upper()])}")
    if since is None or until is None or slices <= 1:
        if since is not None:
            tests.append(f"date >= DATE '{since.isoformat()}'")
        return [" AND ".join(tests) or "1 = 1"]
    span = (until - since).days + 1
    edges = [since + dt.timedelta(days=span * i // slices) for i in range(slices)]
    out = []
    for i, start in enumerate(edges):
        own = [*tests, f"date >= DATE '{start.isoformat()}'"]
        if i + 1 < slices:
            own.append(f"date < DATE '{edges[i + 1].isoformat()}'")
        out.append(" AND ".join(own))
    return out


def scan_prices_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
                     **tests) -> DataFrame:
    """Bars from a database table; ticker, tier and date tests run in the database, date slices run in parallel."""
    return spark.read.jdbc(url, table, predicates=jdbc_predicates(**tests), properties=properties or {})


def get_ohlcv(prices: DataFrame, ticker: str, as_of: dt.date, days: int = 504) -> DataFrame:
    """Bars of one ticker, any letter case, within the lookback."""
    return lookback(prices.where(F.upper("ticker") == ticker.upper()), as_of, days).orderBy("date")


def analytics_history(tables: dict[str, DataFrame], ticker: str, market: str, as_of: dt.date, days: int = 504) -> dict[str, DataFrame]:
    """Metric history of one ticker, one frame per module with its fixed columns; of stored modules only the months asked for
    are read."""
    first = (as_of - dt.timedelta(days)).strftime("%Y-%m")
    out = {}
    for name, columns in HISTORY_COLUMNS.items():
        if name in tables:
            df = tables[name].where(F.col("month") >= first) if "month" in tables[name].columns else tables[name]
            mine = df.where((F.upper("ticker") == ticker.upper()) & (F.col("market") == market))
            out[name] = lookback(mine, as_of, days).select("date", *columns).orderBy("date")
    return out


def long_history(history: dict[str, DataFrame]) -> DataFrame:
    """All modules stacked as (module, date, metric, value)."""
    parts = []
    for name, df in history.items():
        columns = HISTORY_COLUMNS[name]
        numeric = df.select("date", *[F.col(c).cast("double").alias(c) for c in columns])
        parts.append(numeric.unpivot("date", columns, "metric", "value").withColumn("module", F.lit(name)))
    return union_all(*parts).where(F.col("value").isNotNull())
