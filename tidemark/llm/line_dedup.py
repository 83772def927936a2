"""Line dedup: hashes range-partitioned and sorted by document, answered with keep bitmaps instead of text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, ascii_lower, documents, join_rows
from tidemark.sources.tables import stored

SALTS = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    """128 bits from two independent hashes."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


@dataclass
class Rows:
    """Rows of documents, the columns that name one of them, and those that put them in order."""

    docs: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]


def _by_content(docs: DataFrame, carry: tuple[str, ...] = ()) -> Rows:
    """Rows named by id and text; rows equal in both have the same lines, so they may share a bitmap."""
    return Rows(documents(docs, *carry), ("doc_id", "tk"), ("doc_id", "tk"))


def _numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> Rows:
    """Rows named by a number, also where id and text are equal; written, so that the numbers hold. Null ids come last."""
    rows = documents(docs, *carry).withColumn("none", F.col("doc_id").isNull()).withColumn("row", F.monotonically_increasing_id())
    return Rows(stored(rows, "numbered-rows"), ("row",), ("none", "doc_id", "row"))


def repeated_lines(rows: Rows, min_docs: int, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs, first): line hashes found in at least ``min_docs`` documents and their first document.

    Each document gives a key once. Counts are combined per (hash, salt), so that the most common line leaves at most
    ``SALTS`` rows; those are range-partitioned by hash, sorted by document within, and streamed by a window.
    """
    keys = F.array_distinct(F.transform(_lines(F.col("text")), line_key))
    seen = (
        rows.docs
        .select(*rows.order, F.explode(keys).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(*_hashes(F.col("key")), F.struct(*rows.order).alias("doc"))
        .groupBy("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc")
    )
    run = Window.partitionBy("h1", "h2").orderBy("doc")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        seen.withColumn("at", F.row_number().over(run))
        .withColumn("n_docs", F.sum("n").over(whole))
        .where((F.col("at") == 1) & (F.col("n_docs") >= min_docs))
        .select("h1", "h2", "n_docs", F.col("doc").alias("first"))
    )


def drop_bitmaps(rows: Rows, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(key columns, n_dropped, dropped): per document with dropped lines, bit i % 64 of block i / 64 stands for line i.

    Blocks without a dropped line are absent, which keeps the bitmaps of long documents short. With ``keep_first`` the
    first line of the first document that holds a key stays.
    """
    repeated = stored(repeated_lines(rows, min_docs, min_chars), "repeated-lines")
    lines = rows.docs.select(*rows.key, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    hashed = lines.select(*rows.key, "pos", *_hashes(line_key(F.col("line"))))
    hits = hashed.join(repeated, ["h1", "h2"])
    if keep_first:
        order = Window.partitionBy("row", "h1", "h2").orderBy("pos")
        hits = hits.withColumn("nth", F.row_number().over(order)).where((F.col("first.row") != F.col("row")) | (F.col("nth") > 1))
    blocks = hits.groupBy(*rows.key, F.expr("cast(pos div 64 as int)").alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return blocks.groupBy(*rows.key).agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("block", "bits")))).alias("dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, carried columns, n_lines, n_dropped, dropped): every row of ``docs`` without its repeated lines.

    A null or empty text is one empty line. Each row counts as a document, repeated rows and null ids too. Keys are
    compared by 128 bits of hash. ``dropped`` is null where nothing went. With ``keep_first`` a repeated line stays once:
    in the row with the smallest id that has it, one of them if several rows have that id, a row without an id only if
    there is no other. Empty tables give no rows; texts of any length are handled line by line.
    """
    rows = _numbered(docs, carry) if keep_first else _by_content(docs, carry)
    found = drop_bitmaps(rows, min_docs, min_chars, keep_first)
    if keep_first:
        joined = rows.docs.join(found, "row", "left")
    else:
        joined = join_rows(rows.docs, found)
    last = F.array_max(F.map_keys("dropped"))
    dense = F.when(F.col("dropped").isNotNull(), F.transform(
        F.sequence(F.lit(0), last), lambda b: F.coalesce(F.try_element_at(F.col("dropped"), b), F.lit(0).cast("bigint"))))
    lines = joined.select("doc_id", _lines(F.col("text")).alias("lines"), "n_dropped", "dropped", dense.alias("dense"),
                          F.col("text").alias("whole"), *carry)
    kept = F.filter("lines", lambda _, i: F.coalesce(
        F.getbit(F.get(F.col("dense"), F.shiftright(i, 6)), i % 64).cast("int"), F.lit(0)) == 0)
    return lines.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        *carry,
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "dropped")
