"""The given tables, and market shapes derived from them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path


def _trade_order() -> Column:
    """Order of the trades of a day: order, line, price, quantity.

    Packed into one decimal, which a hash aggregation can keep in its buffer; a struct would force a sort.
    """
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(19,0)")
    paid = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100 + F.col("l_quantity").cast("bigint")
    return (line * F.lit(10 ** 16).cast("decimal(17,0)") + paid).cast("decimal(38,0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _trades(spark: SparkSession, sf_dir: str, ticker: str, date: Column) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(ticker).alias("ticker"))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "ticker", date.alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"), _trade_order().alias("k"),
    )


def _to_bars(trades: DataFrame) -> DataFrame:
    # Partial aggregation before the shuffle: a crowded (ticker, date) leaves each map task as one row.
    return trades.groupBy("ticker", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"), F.max_by("px", "k").alias("adj_close"), F.sum("qty").alias("volume"),
    )


def _brand_tier() -> Column:
    number = F.substring("ticker", 7, 3).cast("int")
    return F.when(number <= 9, "LARGE").when(number <= 17, "MID").otherwise("SMALL")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand."""
    day = F.col("l_shipdate").cast("date")
    return _to_bars(_trades(spark, sf_dir, "p_brand", day)).withColumn("cap_category", _brand_tier())


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per brand and Friday-ending week: every brand has a bar on almost every date."""
    friday = F.next_day(F.date_sub(F.col("l_shipdate").cast("date"), 1), "FRI")
    return _to_bars(_trades(spark, sf_dir, "p_brand", friday)).withColumn("cap_category", _brand_tier())


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per part type."""
    day = F.col("l_shipdate").cast("date")
    tier = (
        F.when(F.col("ticker").isin("ECONOMY", "LARGE"), "LARGE")
        .when(F.col("ticker").isin("MEDIUM", "PROMO"), "MID").otherwise("SMALL")
    )
    return _to_bars(_trades(spark, sf_dir, "p_type", day)).withColumn("cap_category", tier)


def calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bars with closes squeezed into a narrow range, so that compounded returns stay finite."""
    return dense_bars(spark, sf_dir).withColumn("close", 100 + F.sqrt("close") / 30)


def stored(df: DataFrame, name: str = "market", compression: str = "snappy") -> DataFrame:
    """Write a derived table to the shared folder and read it back, for queries that use it more than once."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, observation_date, value): mean order total per priority and day."""
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("observation_date")
    ).agg(F.avg("o_totalprice").alias("value"))


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(observation_date, value): mean order total per month, dated on its first day."""
    return table(spark, sf_dir, "orders").groupBy(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("observation_date")
    ).agg(F.avg("o_totalprice").alias("value"))


def investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    marital = F.element_at(F.array(*[F.lit(x) for x in ("single", "married", "divorced", "widowed")]),
                           (k % 4 + 1).cast("int"))
    employment = F.element_at(F.array(*[F.lit(x) for x in ("stable", "variable", "retired")]), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k, (22 + k % 54).alias("age"), (20000 + 50 * F.abs("c_acctbal")).alias("annual_income"),
        (k % 6).alias("dependents"), (1 + k % 35).alias("investment_horizon"),
        (2 + k % 54).alias("loss_tolerance_pct"), (k % 4).alias("investment_experience"),
        marital.alias("marital_status"), employment.alias("employment_type"),
    )
