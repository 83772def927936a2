"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.llm.common import pick
from tidemark.sources.tables import stored

CENTROIDS = 64  # per half: 4,096 cells
FIT_ROWS = 10_000  # vectors that the centroids are fitted on
CALIBRATION = 96  # queries compared with all rows to set how far queries walk
BLOCK = 16_384  # vectors that queries are compared with at once: every block answers each of its queries
QUERY_BLOCK = 1_024


@dataclass
class MultiIndex:
    """Centroids of both halves, and how many distinct vectors each cell (pair of centroids) holds."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    budget: int = 0

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        near = [_nearest(part, c) for part, c in zip((x[:, :self.cut], x[:, self.cut:]), self.halves)]
        return near[0] * len(self.halves[1]) + near[1]

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells that hold vectors, by falling sum of the two halves' inner products: the multi-sequence algorithm.

        The nearer a pair, the larger the sum, so distance is its negative. A pair enters the heap when the pair before it in
        both orders has left.
        """
        scores = [part @ c.T for part, c in zip((q[:self.cut], q[self.cut:]), self.halves)]
        order = [np.argsort(-s, kind="stable") for s in scores]
        ranked = [s[o].tolist() for s, o in zip(scores, order)]
        rows, cols = len(ranked[0]), len(ranked[1])
        heap, left = [(-(ranked[0][0] + ranked[1][0]), 0, 0)], [0] * rows  # left: columns of a row that are done
        names = [o.tolist() for o in order]
        while heap:
            _, i, j = heapq.heappop(heap)
            left[i] = j + 1
            cell = names[0][i] * cols + names[1][j]
            if self.counts[cell]:
                yield cell
            if i + 1 < rows and left[i + 1] == j:
                heapq.heappush(heap, (-(ranked[0][i + 1] + ranked[1][j]), i + 1, j))
            if j + 1 < cols and (i == 0 or left[i - 1] > j + 1):
                heapq.heappush(heap, (-(ranked[0][i] + ranked[1][j + 1]), i, j + 1))

    def probed(self, q: np.ndarray) -> list[int]:
        """Cells until they hold ``budget`` vectors."""
        out, seen = [], 0
        for cell in self.walk(q):
            out.append(cell)
            seen += int(self.counts[cell])
            if seen >= self.budget:
                break
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids ** 2).sum(axis=1), axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2): rows that take part.

    Left out are rows without id, vectors that are null, empty or zero or hold null or non-finite components, and, as an
    inner product needs equal lengths, those of another length than most (the shorter of equally frequent lengths).
    """
    rows = pick(table, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (top["d"] if top else 0)).select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"))


def build(table: DataFrame, k: int, centroids: int = CENTROIDS, seed: int = 0) -> tuple[DataFrame, DataFrame, MultiIndex | None]:
    """(rows, entries, index): all vectors, the distinct ones with their cell and up to k + 1 smallest ids, the index.

    Only the k + 1 smallest ids of equal vectors can be among the k nearest of a query, whose own id is left out, so a
    vector that a third of all rows share is one entry. Equality is that of a 128-bit hash.
    """
    rows = stored(vectors(table), "vectors")
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    distinct = stored(few.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    sample = distinct.orderBy("h1", "h2").limit(FIT_ROWS).select("embedding").toArrow()["embedding"]
    if not len(sample):
        return rows, distinct.withColumn("cell", F.lit(0)), None
    x = _matrix(sample)
    cut, kk = max(1, x.shape[1] // 2), min(centroids, len(x))
    halves = (_k_means(x[:, :cut], kk, 15, seed), _k_means(x[:, cut:], kk, 15, seed + 1) if x.shape[1] > cut else np.zeros((1, 0)))
    index = MultiIndex(halves, np.zeros(len(halves[0]) * len(halves[1]), np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_matrix(b.column("embedding"))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=[*b.schema.names, "cell"])

    entries = stored(distinct.mapInArrow(place, StructType([*distinct.schema, StructField("cell", IntegerType())])), "index")
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row a cell
        index.counts[r["cell"]] = r["n"]
    return rows, entries, index


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then by smaller id; all that tie with the last one are looked at."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def calibrate(entries: DataFrame, index: MultiIndex, queries: DataFrame, k: int, recall: float) -> int:
    """Vectors that a walk must meet so that the pooled recall of a bounded sample of queries reaches ``recall``."""
    sample = queries.orderBy(F.xxhash64("rep"), "rep").limit(CALIBRATION).select("embedding").toArrow()["embedding"]
    q = _matrix(sample)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, ids = q @ _matrix(b.column("embedding")).T, np.asarray(b.column("rep"))
            cells = np.asarray(b.column("cell"))
            found = [(i, p) for i in range(len(q)) for p in _top(scores[i], ids, k)]
            yield pa.RecordBatch.from_pydict({"q": pa.array([i for i, _ in found], pa.int32()), "rep": pa.array([int(ids[p]) for _, p in found], pa.int64()),
                                              "cell": pa.array([int(cells[p]) for _, p in found], pa.int32()), "score": [float(scores[i, p]) for i, p in found]})

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    true = entries.select("rep", "embedding", "cell").mapInArrow(best, "q int, rep long, cell int, score double").withColumn("at", rank).where(F.col("at") <= k)
    wanted: dict[int, list[int]] = {}
    for r in true.collect():
        wanted.setdefault(r["q"], []).append(r["cell"])
    needs = []
    for i, cells in wanted.items():
        met, seen = {}, 0
        for cell in index.walk(q[i]):
            seen += int(index.counts[cell])
            met[cell] = seen
        needs += [met[c] for c in cells]
    needs.sort()
    return needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))] if needs else 0


def _blocks(index: MultiIndex) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of every cell: small cells share a block, large ones are split by hash."""
    first, parts = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64)
    block, held = 0, 0
    for cell, n in enumerate(index.counts.tolist()):
        if n > BLOCK:
            parts[cell] = -(-n // BLOCK)
            first[cell] = block + (held > 0)
            block, held = int(first[cell] + parts[cell]), 0
            continue
        if held + n > BLOCK:
            block, held = block + 1, 0
        first[cell], held = block, held + n
    return first, parts, block + 1


def search(table: DataFrame, is_query: str, k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among all other rows, by inner product.

    Queries walk the cells until they have met the calibrated number of vectors, whose true inner products then rank them.
    Ties go to the smaller vec_id; rows that repeat the query's id are its own. Queries are searched once per distinct
    vector. A query alone in its table has no rows.
    """
    rows, entries, index = build(table, k)
    asked = rows.where(is_query).select("vec_id", "h1", "h2").distinct()
    if index is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    reps = entries.select("h1", "h2", "rep")
    asked = stored(asked.join(reps, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    searched = stored(entries.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding"), "query-vectors")
    index.budget = calibrate(entries, index, searched, k + 1, recall)
    first, parts, _ = _blocks(index)
    shares = max(1, -(-searched.count() // QUERY_BLOCK))

    def deal_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, rep = np.asarray(b.column("cell")), np.asarray(b.column("rep"))
            block = first[cell] + (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *[b.column(n) for n in ("rep", "embedding", "cell")]], names=["block", "rep", "embedding", "cell"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out: list[tuple[int, int, list[int]]] = []
                for i, q in enumerate(_matrix(b.column("embedding"))):
                    by_block: dict[int, list[int]] = {}
                    for cell in index.probed(q):
                        for block in range(first[cell], first[cell] + parts[cell]):
                            by_block.setdefault(int(block), []).append(cell)
                    out += [(i, block, cells) for block, cells in by_block.items()]
                take = pa.array([i for i, _, _ in out], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for _, x, _ in out], pa.int64()), b.column("rep").take(take), b.column("embedding").take(take),
                     pa.array([c for _, _, c in out], pa.list_(pa.int32()))], names=["block", "q", "embedding", "cells"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, reps_, scores = [], [], []
        if left.num_rows and right.num_rows:
            x, cell, ids = _matrix(left["embedding"]), np.asarray(left["cell"]), np.asarray(left["rep"])
            for r in range(0, right.num_rows, 256):
                part = right.slice(r, 256)
                all_scores = _matrix(part["embedding"]) @ x.T
                for q, cells, s in zip(part["q"].to_pylist(), part["cells"].to_pylist(), all_scores):
                    met = np.flatnonzero(np.isin(cell, cells))
                    for p in met[_top(s[met], ids[met], k + 1)]:
                        qs.append(q)
                        reps_.append(int(ids[p]))
                        scores.append(float(s[p]))
        return pa.table({"q": pa.array(qs, pa.int64()), "rep": pa.array(reps_, pa.int64()), "score": pa.array(scores, pa.float64())})

    element = entries.schema["embedding"].dataType.simpleString()
    share = F.pmod(F.xxhash64("q"), F.lit(shares))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    left = entries.mapInArrow(deal_entries, f"block long, rep long, embedding {element}, cell int").withColumn("share", copies)
    right = searched.mapInArrow(deal_queries, f"block long, q long, embedding {element}, cells array<int>").withColumn("share", share)
    met = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(compare, "q long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    best = met.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    named = best.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = named.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    own = asked.join(best, asked["rep"] == best["q"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
