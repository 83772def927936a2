"""From raw documents to a mixed training corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tox
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.similar import without_near_copies
from tidemark.sources.tables import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the model learns from the labelled ones among them."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return tox.toxicity(docs, model, carry=COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten and more documents have stay in the first of them only; n_chars follows the text."""
    out = line_dedup(docs, min_docs=10, min_chars=1, keep_first=True, carry=COLUMNS[2:])
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 5-word Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs, shingle=5, similarity=0.8, carry=COLUMNS[1:]).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item, nor a whole shorter item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, carry=COLUMNS[1:]).where("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix(docs, weights=(5.0, 2.0, 1.0), cap=3.0, carry=("lang", "n_chars")).select(
        "doc_id", "source", "lang", "n_chars", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # the learned toxicity model and XXH64 have no SQL counterpart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
