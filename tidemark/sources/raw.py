"""Raw JSON payloads of bars and macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import MACRO_COLUMNS, PRICE_COLUMNS, RAW_BAR_SCHEMA, RAW_MACRO_SCHEMA


def explode_bars(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.select(
        *keep, "ticker", "asset_class", "source", F.col("cap").alias("cap_tier"), F.explode("records").alias("b")
    ).select(*keep, "ticker", "asset_class", "source", "cap_tier", "b._date", *[f"b.{c}" for c in PRICE_COLUMNS])


def scan_raw_bars(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per record of every gzip JSON payload; ``multi_line=False`` for one payload per line."""
    return explode_bars(spark.read.schema(RAW_BAR_SCHEMA).json(path, multiLine=multi_line))


def explode_macro(payloads: DataFrame, run_id: str, ingested_at: Column | None = None) -> DataFrame:
    """Canonical macro rows; "." and unparseable values and undated observations are dropped."""
    m = "meta."
    rows = payloads.select("series_id", "meta", F.explode("observations").alias("o"))
    return rows.select(
        "series_id", F.col("o.date").try_cast("date").alias("observation_date"),
        F.col("o.value").try_cast("double").alias("value"),
        F.col("o.realtime_start").try_cast("date").alias("realtime_start"),
        F.col("o.realtime_end").try_cast("date").alias("realtime_end"),
        F.coalesce(m + "frequency_short", m + "frequency", F.lit("")).alias("frequency"),
        F.coalesce(m + "units", F.lit("")).alias("units"),
        F.coalesce(m + "seasonal_adjustment_short", F.lit("")).alias("seasonal_adjust"),
        F.coalesce(m + "title", "series_id").alias("title"), F.lit("fred").alias("source"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at_utc"),
        F.lit(run_id).alias("run_id"),
    ).where(F.col("value").isNotNull() & F.col("observation_date").isNotNull()).select(*MACRO_COLUMNS)


def scan_raw_macro(spark: SparkSession, path: str, run_id: str, multi_line: bool = True) -> DataFrame:
    return explode_macro(spark.read.schema(RAW_MACRO_SCHEMA).json(path, multiLine=multi_line), run_id)


def bar_payloads(bars: DataFrame, asset_class: str, source: str = "yfinance") -> DataFrame:
    """Pack bars into raw payloads, one per ticker and year (at most one record per day of a year)."""
    record = F.struct(F.col("date").cast("string").alias("_date"), *PRICE_COLUMNS)
    return bars.groupBy("ticker", F.year("date").alias("_y"), F.col("cap_category").alias("cap")).agg(
        F.min("date").cast("string").alias("start_date"), F.max("date").cast("string").alias("end_date"),
        F.count(F.lit(1)).alias("rows"), F.collect_list(record).alias("records"),
    ).select(
        "ticker", F.lit(asset_class).alias("asset_class"), F.lit(source).alias("source"), "cap", "start_date",
        "end_date", F.lit("1d").alias("interval"), "rows", "records",
    )
