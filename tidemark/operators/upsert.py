"""Union, upsert, inventories and freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prep import curated_to_market, newest_per_key
from tidemark.schemas import PRICE_COLUMNS


def merge_upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; rows with a null key are dropped.

    ``existing`` is a table already unique on its key. An anti join keeps it in place: while the batch is small the
    join is a broadcast and the stored table is not shuffled. Pass ``order`` when the batch itself may repeat keys.
    """
    batch = new.dropna(subset=keys)
    if order is not None:
        batch = newest_per_key(batch, keys, order)
    kept = existing.dropna(subset=keys).join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def merge_incremental(existing: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Append recomputed metrics of dates after each ticker's last stored date; earlier rows stay as stored, so the
    empty warm-up rows of a short recomputation never replace good ones."""
    last = existing.groupBy("ticker").agg(F.max("date").alias("_last"))
    fresh = recomputed.join(last, "ticker", "left").where(F.col("_last").isNull() | (F.col("date") > F.col("_last")))
    return existing.unionByName(fresh.drop("_last"))


def warmup_slice(prices: DataFrame, stored: DataFrame, bars: int) -> DataFrame:
    """Bars after the last stored date of each ticker, plus the ``bars`` before it that the windows need."""
    from tidemark.functions.windows import series

    last = stored.groupBy("ticker").agg(F.max("date").alias("_last"))
    df = prices.join(last, "ticker", "left")
    old = F.col("date") <= F.col("_last")
    back = series("ticker", "_old", order="_back")
    df = df.withColumn("_old", F.coalesce(old, F.lit(False))).withColumn("_back", -F.unix_date("date"))
    return df.withColumn("_rn", F.row_number().over(back)).where(~F.col("_old") | (F.col("_rn") <= bars)).select(
        *prices.columns
    )


def build_market(curated: DataFrame, asset_classes: list[str], order: list[str]) -> DataFrame:
    """Stack asset classes in the market schema, last row per (ticker, date)."""
    df = curated_to_market(curated.where(F.col("asset_class").isin(*asset_classes)))
    extra = ["cap_category"] if "cap_category" in df.columns else []
    rows = df.select("ticker", "date", *PRICE_COLUMNS, *extra, F.struct(*order).alias("_order"))
    return newest_per_key(rows, ["ticker", "date"], ["_order"]).drop("_order")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def last_date(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max("date").alias("last_date"))


def last_business_day(as_of: dt.date) -> dt.date:
    """Latest finished weekday: the day before on weekdays, Friday on weekends and Mondays."""
    back = {0: 3, 6: 2}.get(as_of.weekday(), 1)
    return as_of - dt.timedelta(days=back)


def stale_tickers(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Tickers whose newest bar is before the last finished business day, with the range to fetch."""
    target = F.lit(last_business_day(as_of))
    return (
        last_date(df, "ticker").where(F.col("last_date") < target)
        .select("ticker", "last_date", F.date_add("last_date", 1).alias("missing_from"), target.alias("missing_to"))
    )


def list_tickers(df: DataFrame, cap: str | None = None) -> DataFrame:
    if cap:
        df = df.where(F.upper("cap_category") == cap.upper())
    return df.select("ticker").distinct().orderBy("ticker")


def dataset_inventory(curated: DataFrame) -> DataFrame:
    return curated.groupBy("asset_class").agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("rows"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
    )


def missing_holdings(allocations: DataFrame, prices: DataFrame) -> DataFrame:
    return allocations.join(prices.select("ticker").distinct(), "ticker", "left_anti")


def present_holdings(allocations: DataFrame, prices: DataFrame) -> DataFrame:
    return allocations.join(prices.select("ticker").distinct(), "ticker", "left_semi")


def run_summary(rows: DataFrame) -> DataFrame:
    """(run_id, market, module, rows; rows is -1 for a failed step) -> one row per run with its status."""
    failed = F.count(F.when(F.col("rows") < 0, 1))
    good = F.count(F.when(F.col("rows") >= 0, 1))
    return rows.groupBy("run_date", "run_id").agg(
        good.alias("ok_count"), failed.alias("fail_count"),
        F.sum(F.when(F.col("rows") > 0, F.col("rows")).otherwise(0)).alias("rows_written"),
        F.when(failed == 0, "done").when(good == 0, "failed").otherwise("partial").alias("status"),
    )
