"""Writers. Output is split by partition value and size, so that one large symbol does not become one task."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prep import newest_per_key
from tidemark.operators.upsert import merge_upsert
from tidemark.session import pin


def _write_parts(df: DataFrame, path: str, parts: list[str], order: list[str]) -> None:
    (
        df.hint("rebalance", *parts).sortWithinPartitions(*parts, *order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        .partitionBy(*parts).parquet(path)
    )


CURATED_KEY = ["asset_class", "symbol", "trade_date"]
FEATURE_KEY = ["asset_class", "symbol_or_series", "feature_set", "feature_name", "date"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the path. Only a missing path counts as no; other errors are raised."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def upsert_months(df: DataFrame, path: str, key: list[str], date: str, parts: list[str], newest: list[str] | None = None) -> None:
    """Upsert into a table laid out by ``parts`` and the month of ``date``: only the months that ``df`` holds are read, with a
    filter on the partition, and rewritten; other rows of those months stay.

    Rows of ``df`` win over stored ones with the same key; with ``newest``, stored columns as well, the greatest of both by
    those columns wins. What is written is pinned first, as it replaces the partitions it is read from.
    """
    new = pin(df.withColumn("month", F.date_format(date, "yyyy-MM")))
    if exists(df.sparkSession, path):
        held = [r["month"] for r in new.select("month").distinct().collect()]  # bounded by the calendar
        stored = df.sparkSession.read.parquet(path).where(F.col("month").isin(held))
        stored = stored.select(*[F.col(f.name).cast(f.dataType) for f in new.schema])
        touched = stored.join(F.broadcast(new.select(*parts, "month").distinct()), [*parts, "month"], "left_semi").select(*new.columns)
        new = pin(merge_upsert(touched, new, key) if newest is None else newest_per_key(touched.unionByName(new), key, newest))
    _write_parts(new, path, [*parts, "month"], [c for c in key if c not in parts])


def write_curated(df: DataFrame, path: str) -> None:
    """Upsert curated bars by asset class, symbol and date."""
    upsert_months(df, path, CURATED_KEY, "trade_date", ["asset_class"])


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def write_macro(df: DataFrame, path: str) -> None:
    _write_parts(df, path, ["series_id"], ["observation_date"])


def write_features(df: DataFrame, path: str) -> None:
    """Upsert features by symbol or series, set, name and date."""
    upsert_months(df, path, FEATURE_KEY, "date", ["asset_class", "feature_set"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def write_analytics(df: DataFrame, path: str) -> None:
    """Module rows by market and month; the months that ``df`` holds are replaced."""
    rows = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    _write_parts(rows, path, ["market", "month"], ["ticker", "date"])


def partition_values(spark: SparkSession, path: str, **parents: str) -> list[str]:
    """Values of the next partition column below ``path`` and the given parents, sorted, from the listing of folders alone."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, value in parents.items():
        names = [s.getPath() for s in files.listStatus(folder) if s.isDirectory()]
        match = [p for p in names if unquote(p.getName()) == f"{name}={value}"]
        if not match:
            return []
        folder = match[0]
    found = [unquote(s.getPath().getName()).split("=", 1) for s in files.listStatus(folder) if s.isDirectory()]
    return sorted(v[1] for v in found if len(v) == 2 and v[1] != "__HIVE_DEFAULT_PARTITION__")


def write_market(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def truncate_prices(spark: SparkSession, path: str) -> None:
    """Leave the table in place with its schema and no rows."""
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.write.mode("overwrite").parquet(path)
