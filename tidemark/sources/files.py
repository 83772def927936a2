"""User files, price CSVs and a file inventory."""

from __future__ import annotations

import csv
import ctypes
import ctypes.util
import hashlib
import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.prep import number
from tidemark.schemas import PRICE_COLUMNS

# Price CSV headings and their column names.
CSV_HEADINGS = {"Date": "date", "Ticker": "ticker", "Open": "open", "High": "high", "Low": "low", "Close": "close",
                "Adj Close": "adj_close", "Volume": "volume"}
STATE = 256  # bytes set aside for a SHA-256 state, which needs 112
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo|passthrough)$"  # names whose bytes Hadoop's codecs would unpack


def _header_groups(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every distinct header line under ``path``, from one pass over the first lines."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"))
    # All rows of a file's first block come from one task, in order.
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()
    return [(next(csv.reader([r["head"].lstrip("\ufeff")]), []), [unquote(f) for f in r["files"]]) for r in groups]


def scan_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price CSVs with a header; a missing or empty ticker comes from the file name before the first underscore,
    and absent price columns are null. Files of one folder may have different columns, in any order."""
    parts = []
    for names, paths in _header_groups(spark, path):
        schema = T.StructType([T.StructField(CSV_HEADINGS.get(n.strip(), f"{n.strip()}_{i}"), T.StringType()) for i, n in enumerate(names)])
        df = spark.read.schema(schema).option("header", True).csv(paths).withColumn("_file", F.col("_metadata.file_name"))
        plain = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))  # the name as it is on disk
        from_name = F.regexp_extract(plain, r"^([^_.]+)", 1)
        given = F.when(F.trim("ticker") != "", F.col("ticker")) if "ticker" in df.columns else F.lit(None).cast("string")
        date = F.to_date(F.substring("date", 1, 10)) if "date" in df.columns else F.lit(None).cast("date")
        parts.append(df.select(
            F.upper(F.coalesce(given, from_name)).alias("ticker"), date.alias("date"),
            *[(number(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in PRICE_COLUMNS]))
    if not parts:
        return spark.createDataFrame([], "ticker string, date date, " + ", ".join(f"{c} double" for c in PRICE_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def scan_user_file(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A csv, json or parquet upload. JSON may be lines or one array of records."""
    fmt = fmt or os.path.splitext(path)[1].lstrip(".").lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=False, escape='"')
    if fmt == "json":
        return reader.json(path)
    if fmt == "json_array":
        return reader.json(path, multiLine=True)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported upload format: {fmt}")


def _sha256() -> tuple[Callable, Callable, Callable]:
    """SHA-256 in steps: (opened, fed, digest). They are made here so that tasks get them without this package.

    The library behind hashlib has a state of plain bytes that another task can go on from.
    """
    def opened() -> ctypes.CDLL | None:
        """None where that does not work."""
        name = ctypes.util.find_library("crypto")
        lib = ctypes.CDLL(name) if name else None
        if not hasattr(lib, "SHA256_Init"):
            return None
        trial = fed(lib, fed(lib, b"", b"ab"), b"c")
        return lib if digest(lib, trial) == hashlib.sha256(b"abc").hexdigest() else None

    def fed(lib: ctypes.CDLL, state: bytes, data: bytes) -> bytes:
        """The state after ``data``; an empty one is that of no bytes."""
        held = ctypes.create_string_buffer(state, STATE)
        if not state:
            lib.SHA256_Init(held)
        lib.SHA256_Update(held, data, ctypes.c_size_t(len(data)))
        return held.raw

    def digest(lib: ctypes.CDLL, state: bytes) -> str:
        out = ctypes.create_string_buffer(32)
        lib.SHA256_Final(out, ctypes.create_string_buffer(state, STATE))
        return out.raw.hex()

    return opened, fed, digest


def _advance(lines: DataFrame, states: dict[str, tuple[bytes, int]]) -> DataFrame:
    """(file, state, fed) for each named file of a partition, after its lines there. ``fed`` bytes came before, -1 none."""
    opened, fed_with, _ = _sha256()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, mine = opened(), {}
        for b in batches:
            names, some = b.column("file").to_pylist(), b.column("line").to_pylist()
            for name, run in groupby(range(len(names)), names.__getitem__):
                if name in states:
                    state, fed = mine.get(name, states[name])
                    data = (b"" if fed < 0 else b"\n") + b"\n".join([some[i] for i in run])
                    mine[name] = fed_with(lib, state, data), max(fed, 0) + len(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(mine), pa.string()), pa.array([m[0] for m in mine.values()], pa.binary()), pa.array([m[1] for m in mine.values()], pa.int64())],
            names=["file", "state", "fed"])

    return lines.select("file", "line").mapInArrow(work, "file string, state binary, fed long")


def _hashed_in_turn(spark: SparkSession, path: str, sizes: dict[str, int], whole_bytes: int) -> dict[str, str]:
    """SHA-256 of big files, block by block: the task of a block goes on from the state that the one before it left.

    The text source cuts files into blocks at line ends and gives the bytes of lines as they are. A round takes the next block
    of every file. A file whose lines do not add up to its size is left out.
    """
    opened, fed_with, digest = _sha256()
    lib = opened()
    if lib is None or not sizes:
        return {}
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).where(
        (F.col("_metadata.file_size") > whole_bytes) & ~F.col("_metadata.file_path").rlike(PACKED)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
    pieces = lines.groupBy(F.spark_partition_id().alias("part"), "file", "at").agg(F.sum(F.length("line") + 1).alias("bytes")).collect()
    left, total, parts = defaultdict(list), Counter(), defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["file"], r["at"])):
        total[r["file"]] += r["bytes"]
        if r["file"] in sizes:
            left[r["file"]].append(r["at"])
    left = {f: at for f, at in left.items() if total[f] - sizes[f] in (0, 1)}  # the last line may end without a line end
    for r in pieces:
        if r["file"] in left:
            parts[r["part"]].append((r["file"], r["at"]))
    states = {f: (b"", -1) for f in left}
    while ready := [p for p, mine in parts.items() if all(left[f][:1] == [at] for f, at in mine)]:
        now = {f for p in ready for f, _ in parts.pop(p)}
        reached = _advance(lines, {f: states[f] for f in now}).rdd
        for r in spark.sparkContext.runJob(reached, list, ready):
            states[r["file"]] = bytes(r["state"]), r["fed"]
            left[r["file"]].pop(0)
    out = {}
    for f, (state, fed) in states.items():
        if not left[f] and sizes[f] - fed in (0, 1):
            out[f] = digest(lib, fed_with(lib, state, b"\n" * (sizes[f] - fed)))
    return out


def file_inventory(spark: SparkSession, path: str, whole_bytes: int = 128 << 20) -> DataFrame:
    """Name, size and SHA-256 of every file. Files beyond ``whole_bytes`` go through many tasks, a block each.

    Only those that the text source would unpack, or whose lines do not add up to their size, are read in one row even so; of
    them a file that one row cannot hold (2 GB) makes the query fail.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    file = F.col("_metadata.file_path")
    big = files.where((F.col("length") > whole_bytes) & ~file.rlike(PACKED)).select(name, "length", file.alias("file")).collect()
    done = _hashed_in_turn(spark, path, {r["file"]: r["length"] for r in big}, whole_bytes)
    rest = files.where(~file.isin(list(done))) if done else files
    rest = rest.select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    if not done:
        return rest
    known = [(r["file_name"], r["length"], done[r["file"]]) for r in big if r["file"] in done]
    return rest.unionAll(spark.createDataFrame(known, rest.schema))


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows picked by a hash of their key: the same rows on every run, whatever the partitioning.

    Every task keeps its n smallest hashes, so the final merge sees n rows a task.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    return hashed.orderBy("_h", *keys).limit(n).drop("_h")


def profile_sample(df: DataFrame, keys: list[str], n: int = 50_000, seed: int = 42) -> DataFrame:
    return seeded_sample(df, n, keys, seed)
