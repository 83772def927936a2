"""Incremental ingest: new raw payload files become curated upserts; a second run over the same files does nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prep import newest_per_key
from tidemark.schemas import PRICE_COLUMNS, RAW_BAR_SCHEMA
from tidemark.sources.raw import explode_bars
from tidemark.sources.sinks import CURATED_KEY, upsert_months

SEEN = ["seen_at", "seen_in", "seen_row"]  # time and path of the payload file, digest of the row: the order among repeats


def curated_rows(payloads: DataFrame) -> DataFrame:
    """Curated bars of a batch of payloads, with what orders repeats of a key."""
    rows = explode_bars(payloads, "seen_at", "seen_in")
    digest = F.xxhash64("_date", "ticker", "source", "cap_tier", *PRICE_COLUMNS)
    return rows.where(F.col("close").isNotNull()).select(
        F.to_date("_date").alias("trade_date"), F.upper("ticker").alias("symbol"), "asset_class", *PRICE_COLUMNS,
        "source", "cap_tier", "seen_at", "seen_in", digest.alias("seen_row"),
    )


def upsert_curated(batch: DataFrame, path: str) -> None:
    """Merge a batch into the curated table, rewriting only the months the batch holds. Of a key's rows, stored or new, the
    one of the newest file stays, so a file that is delivered late does not undo a newer one."""
    new = newest_per_key(batch.dropna(subset=CURATED_KEY), CURATED_KEY, SEEN)
    upsert_months(new, path, CURATED_KEY, "trade_date", ["asset_class"], newest=SEEN)


def run_ingest(spark: SparkSession, raw_path: str, curated_path: str, checkpoint: str, files_per_batch: int = 10_000) -> int:
    """Process all payload files not yet seen, a bounded number of files at a time; gives the number of payloads read."""
    # Without an age limit of a century the source would pass over files a week older than the newest one.
    source = spark.readStream.schema(RAW_BAR_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d")
    stream = source.json(raw_path).withColumns({
        "seen_at": F.col("_metadata.file_modification_time"), "seen_in": F.col("_metadata.file_path")})
    read = []

    def merge(batch: DataFrame, _: int) -> None:
        # Writing is idempotent, so a batch that is retried after a failure ends in the same table.
        count = Observation()
        upsert_curated(curated_rows(batch.observe(count, F.count(F.lit(1)).alias("payloads"))), curated_path)
        read.append(count.get["payloads"])

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(read)
