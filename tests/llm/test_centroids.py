"""Centroid clustering against a plain search over all centroids."""

import hashlib
import math

import numpy as np
import pytest

from tests.llm.conftest import SF
from tidemark.llm import centroids as cc
from tidemark.llm import queries


def brute(rows, k=8, rounds=10, dims=64, seed="3"):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centre[n] = [sum(x) // len(vs) for x in zip(*vs)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    per = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    return sorted((str(i), n, d, per[n], total, hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()) for i, d, n in last)


def got(df):
    return sorted((str(r["vec_id"]), *list(r)[1:]) for r in df.collect())


@pytest.mark.parametrize("k, dims, span", [(1, 3, 5), (2, 2, 3), (9, 4, 6), (40, 3, 12), (25, 16, 900)])
def test_orchard_finds_the_nearest_of_all(k, dims, span):
    rng = np.random.default_rng(k)
    at = rng.integers(-span, span, (k, dims))  # small spans: equal centroids and ties
    x = rng.integers(-span, span, (700, dims))
    label, d, asked = cc.Orchard(at.tolist()).search(x)
    all_d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (label == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()
    assert asked <= all_d.size


def test_orchard_leaves_distances_out():
    rng = np.random.default_rng(5)
    at = rng.integers(-1000, 1000, (60, 8))
    x = np.repeat(at, 20, axis=0) + rng.integers(-20, 20, (1200, 8))
    label, _, asked = cc.Orchard(at.tolist()).search(x)
    assert (label == np.repeat(np.arange(60), 20)).all() and asked < 1200 * 60 / 4


def test_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op11_centroids(spark, SF)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [-0.5, 0.25]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]),
            (8, [None, 1.0]), (9, [0.0, 0.0]), (None, [3.5, -2.25]), (None, [3.5, -2.0]), (10, [1.0, 2.0, 3.0]), (11, [-0.0001, 0.9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, VEC_ID string")
    for k in (1, 3, 20):
        assert got(cc.cluster(df, k=k, rounds=4, dims=2)) == brute(rows, k, 4, 2)
    none = cc.cluster(df.where("false"), dims=2)
    assert none.collect() == [] and none.columns == queries.op11_centroids(spark, SF).columns
    with pytest.raises(Exception, match="do not fit"):
        cc.cluster(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), k=1, dims=2).collect()


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5]) for i in range(200)] + [(200 + i, rng.normal(0, 1, 2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert got(cc.cluster(df, k=5, rounds=6, dims=2)) == brute(rows, 5, 6, 2)
