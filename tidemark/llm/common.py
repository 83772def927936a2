"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"  # what [\x20\x09-\x0D] matches
ALL_ROWS = 2 ** 63 - 1


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact spelling if there is one, else in any case; the first where a name is repeated.

    Columns that clash with a wanted one by case, or carry its name again, are left behind.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    lower = [c.lower() for c in df.columns]
    at = lambda n: df.columns.index(n) if n in df.columns else lower.index(n.lower())
    return flat.select(*[F.col(f"c{at(n)}").alias(n) for n in names])


def documents(df: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, tk, text, carried columns): null text is empty; (doc_id, tk) names a row up to rows of equal id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carry = tuple(c for c in carry if c not in ("doc_id", "text"))
    rows = pick(df, "doc_id", "text", *carry)
    return rows.select("doc_id", F.xxhash64(text).alias("tk"), text.alias("text"), *carry)


def join_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on (doc_id, tk); a null doc_id meets a null doc_id."""
    right = found.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left").drop("_id", "_tk")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def training_share(rows: int, wanted: int) -> Column:
    """Keep about ``wanted`` of ``rows`` rows, chosen by the hash of doc_id, the same on every run."""
    bound = ALL_ROWS if rows <= wanted else int(ALL_ROWS * (wanted / rows))
    return F.xxhash64(F.lit("fit"), F.col("doc_id")).bitwiseAND(F.lit(ALL_ROWS)) <= F.lit(bound)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id falls into fold 1 and is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1)).cast("int")


def add_columns(rows: DataFrame, fields: str, start: Callable[[], Callable[[str], tuple]], keep_text: bool = False) -> DataFrame:
    """``rows`` with columns worked out from the text of each row alone, in Arrow batches.

    ``start`` runs once a task and returns a function from a text (null: empty) to the values of ``fields``.
    """
    kept = [f for f in rows.schema if keep_text or f.name != "text"]
    added = StructType.fromDDL(fields)
    kinds = list(to_arrow_schema(added).types)
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [of(t or "") for t in b.column("text").to_pylist()]
                made = [pa.array([r[i] for r in found], kinds[i]) for i in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + made, names=names + list(added.names))

    return rows.mapInArrow(work, StructType([*kept, *added]))
