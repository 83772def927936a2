"""Cleaning and shaping of bars before any metric."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import CURATED_COLUMNS, PRICE_COLUMNS

# Tickers that may be requested, tickers and prefixes that never may.
ALLOWLIST = """SPY QQQ DIA IWM RSP XLK XLF XLE AGG HYG UUP GLD USO LQD IEF VEA VWO NVDA AVGO MSFT KLAC CDNS ETN PH HEI
EME PWR FAST BWXT IDCC RDNT DY GPI ACLS TTMI AGM APH GWW BSX""".split()
DENYLIST = ["VIX", "VIXY", "VIXM"]
DENY_PREFIXES = ["^"]

# Days kept per period name; any other period keeps everything.
PERIOD_DAYS = {"6mo": 182, "1y": 365, "2y": 730, "5y": 1825}

# Curated column names and their market counterparts.
CURATED_TO_MARKET = {"trade_date": "date", "symbol": "ticker", "cap_tier": "cap_category"}

# Asset-class groups, labels and tickers of the market overview.
TICKER_GROUPS = [
    ("Core Market", "S&P 500 (SPY)", "SPY"),
    ("Core Market", "Nasdaq-100 (QQQ)", "QQQ"),
    ("Core Market", "Dow 30 (DIA)", "DIA"),
    ("Core Market", "Russell 2000 (IWM)", "IWM"),
    ("Core Market", "S&P 500 Equal-Weight (RSP)", "RSP"),
    ("Sectors", "Technology (XLK)", "XLK"),
    ("Sectors", "Financials (XLF)", "XLF"),
    ("Sectors", "Energy (XLE)", "XLE"),
    ("Rates, Credit & Macro", "US Aggregate (AGG)", "AGG"),
    ("Rates, Credit & Macro", "High Yield (HYG)", "HYG"),
    ("Rates, Credit & Macro", "US Dollar (UUP)", "UUP"),
    ("Rates, Credit & Macro", "Gold (GLD)", "GLD"),
    ("Rates, Credit & Macro", "Crude Oil (USO)", "USO"),
]


def number(c: str) -> Column:
    """Parse to double; anything unparseable, and NaN, becomes null."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null; aggregates skip nulls but spread NaN."""
    return df.selectExpr(*[
        f"CASE WHEN NOT isnan(`{f.name}`) THEN `{f.name}` END AS `{f.name}`" if f.dataType.typeName() in ("double", "float")
        else f"`{f.name}`" for f in df.schema.fields
    ])


def clean_bars(df: DataFrame) -> DataFrame:
    """Coerce the price columns, add absent ones, let adj_close default to close, drop bars without a close."""
    had_adjusted = "adj_close" in df.columns
    for c in PRICE_COLUMNS:
        df = df.withColumn(c, number(c) if c in df.columns else F.lit(None).cast("double"))
    if not had_adjusted:
        df = df.withColumn("adj_close", F.col("close"))
    return df.dropna(subset=["close"])


def normalize_bars(df: DataFrame, asset_class: str, run_id: str, currency: str = "USD", exchange: str = "",
                   source: str = "yfinance", ingested_at: dt.datetime | None = None) -> DataFrame:
    """Raw bars (``_date``, ``ticker``, prices) in the 14-column curated schema."""
    stamp = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    return df.select(
        F.to_date("_date").alias("trade_date"), F.upper("ticker").alias("symbol"),
        F.lit(asset_class).alias("asset_class"), *PRICE_COLUMNS, F.lit(currency).alias("currency"),
        F.lit(exchange).alias("exchange"), F.lit(source).alias("source"), stamp.alias("ingested_at_utc"),
        F.lit(run_id).alias("run_id"),
    ).select(*CURATED_COLUMNS)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``.

    An aggregate, not a window: copies of one key collapse inside each map task before anything is shuffled.
    """
    values = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values]).select(*df.columns)


def normalise_for_store(df: DataFrame, order: list[str]) -> DataFrame:
    """Upper-case tickers, coerce, drop rows without ticker, date or close, keep the last row per (ticker, date)."""
    for c in PRICE_COLUMNS:
        df = df.withColumn(c, number(c) if c in df.columns else F.lit(None).cast("double"))
    df = df.withColumn("ticker", F.upper(F.trim("ticker"))).withColumn("date", F.col("date").try_cast("date"))
    df = df.dropna(subset=["ticker", "date", "close"]).where(F.col("ticker") != "")
    return newest_per_key(df, ["ticker", "date"], order)


def curated_to_market(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(CURATED_TO_MARKET)


def with_cap_tier(df: DataFrame, tiers: DataFrame, key: str = "ticker") -> DataFrame:
    """Attach cap_category from (ticker, cap_category); a ticker outside the list is UNKNOWN.

    The tier list is left to the optimizer, which broadcasts it while it is below the size threshold.
    """
    return df.drop("cap_category").join(tiers.withColumnRenamed("ticker", key), key, "left").withColumn(
        "cap_category", F.coalesce("cap_category", F.lit("UNKNOWN"))
    )


def sanitize_tickers(df: DataFrame, arg: str, allow: Iterable[str] = ALLOWLIST) -> DataFrame:
    """Split a comma list into symbols: ``kept`` ones upper-cased, the others as given."""
    symbols = df.withColumn("symbol", F.explode(F.split(arg, ","))).withColumn("symbol", F.trim("symbol"))
    up = F.upper("symbol")
    denied = up.isin(*DENYLIST)
    for p in DENY_PREFIXES:
        denied = denied | up.startswith(p)
    return (
        symbols.where(F.col("symbol") != "")
        .withColumn("kept", up.isin(*allow) & ~denied)
        .withColumn("symbol", F.when(F.col("kept"), up).otherwise(F.col("symbol")))
    )


def trim_period(df: DataFrame, period: str) -> DataFrame:
    """Keep bars within the period before each ticker's own last bar."""
    days = PERIOD_DAYS.get(period.lower())
    if days is None:
        return df
    last = F.max("date").over(Window.partitionBy("ticker"))
    return df.withColumn("_last", last).where(F.col("date") >= F.date_sub("_last", days)).drop("_last")


def lookback(df: DataFrame, as_of: dt.date, days: int | None) -> DataFrame:
    """Keep bars within ``days`` calendar days of ``as_of``; the bound is a literal, so it reaches the scan."""
    if days is None:
        return df
    return df.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))


def with_ticker_group(df: DataFrame) -> DataFrame:
    """Attach asset-class group and label by ticker; null outside the fixed list."""
    groups = df.sparkSession.createDataFrame(TICKER_GROUPS, "category string, label string, ticker string")
    return df.join(groups, "ticker", "left")


def candle_direction(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.when(F.col("close") >= F.col("open"), "up").otherwise("down"))
