"""Centroid clustering in whole numbers, with Orchard's search for the nearest centroid of every vector."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.tables import stored

REACH = 2 ** 27  # components beyond this could have squared distances that no long holds
ROWS = 4096  # vectors searched together


def whole_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors with exactly ``dims`` components, none null or not finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = pick(rows, "vec_id", "embedding").where((F.size("embedding") == dims) & F.forall("embedding", number))
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """Vectors with the k smallest hashes of ``seed:vec_id``; a null id hashes as an empty one, equal ids go by vector."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r["v"] for r in vectors.orderBy(F.sha2(name, 256), "v").limit(k).collect()]


class Orchard:
    """Nearest centroid by sorted neighbour lists; squared Euclidean distance in whole numbers, ties to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.at = np.array(centroids, np.int64)
        k = len(self.at)
        gaps = np.stack([((self.at - c) ** 2).sum(axis=1) for c in self.at])
        order = np.argsort(gaps, axis=1, kind="stable")
        self.near = order[order != np.arange(k)[:, None]].reshape(k, k - 1)  # each centroid's others, nearest first
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)
        # The search starts at the centroid that is nearest in the one component in which they differ most.
        self.axis = int((self.at.max(axis=0) - self.at.min(axis=0)).argmax())
        self.line = np.argsort(self.at[:, self.axis], kind="stable")

    def guess(self, x: np.ndarray) -> np.ndarray:
        places = self.at[self.line, self.axis]
        right = np.clip(np.searchsorted(places, x[:, self.axis]), 0, len(places) - 1)
        left = np.maximum(right - 1, 0)
        nearer = x[:, self.axis] - places[left] <= places[right] - x[:, self.axis]
        return self.line[np.where(nearer, left, right)]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row of ``x``, and how many distances were computed. All rows step together."""
        n, k = len(x), len(self.at)
        label = self.guess(x)
        best = ((x - self.at[label]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), label] = True
        step = np.zeros(n, np.int64)  # place in the neighbour list of the row's centroid
        live, asked = np.arange(n), n
        while True:
            live = live[step[live] < k - 1]
            live = live[self.gaps[label[live], step[live]] <= 4 * best[live]]  # beyond twice the distance: done
            if not len(live):
                return label, best, asked
            other = self.near[label[live], step[live]]
            step[live] += 1
            fresh = ~seen[live, other]
            rows, other = live[fresh], other[fresh]
            seen[rows, other] = True
            d = ((x[rows] - self.at[other]) ** 2).sum(axis=1)
            asked += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (other < label[rows]))
            rows = rows[closer]
            label[rows], best[rows], step[rows] = other[closer], d[closer], 0  # on with the closer centroid's list


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        if ((x > REACH) | (x < -REACH)).any():
            raise ValueError(f"components beyond {REACH} after scaling have distances that do not fit a long")
        yield part, x


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's mean of its vectors, rounded down; those without vectors stay."""
    k, dims = len(centroids), len(centroids[0])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n, sums = Orchard(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x in _blocks(batch):
                label = find.search(x)[0]
                n += np.bincount(label, minlength=k)
                for c in np.unique(label):
                    sums[c] += x[label == c].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["c", "n", "sums"])

    parts = vectors.select("v").mapInArrow(totals, "c int, n long, sums array<long>")
    wide = F.col("s").cast("decimal(38,0)")
    rows = parts.select("c", "n", F.posexplode("sums").alias("at", "s")).groupBy("c", "at").agg(F.sum(wide).alias("s"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in rows.collect():  # k * dims rows
        out[r["c"]][r["at"]] = int(r["s"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Vectors of another length, and those that are null or hold a null or non-finite component, are left out. Repeated rows
    and null ids count like any other row. With fewer vectors than ``k`` there are as many centroids; no vectors, no rows.
    A component beyond ``REACH`` after scaling raises, as its distances may not fit a long. All arithmetic is exact: tasks
    sum whole numbers, and one row per task and centroid is shuffled.
    """
    vectors = stored(whole_vectors(rows, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        empty = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty.format(vectors.schema["vec_id"].dataType.simpleString()))
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Orchard(centroids)
        for batch in batches:
            for part, x in _blocks(batch):
                label, d, _ = find.search(x)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = stored(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()]  # at most k rows
    of = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
