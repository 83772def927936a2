"""Nearest neighbours against brute force, and exact round trips through archives."""

import base64
import gzip
import hashlib
import io
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import ann, warc
from tidemark.session import new_path


def brute_nearest(ids, x, queries, k):
    scores = x[queries] @ x.T
    out = {}
    for q, s in zip(queries, scores):
        order = np.lexsort((ids, -s))
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order if ids[i] != ids[q]][:k]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    queries = np.flatnonzero(ids % 20 == 0)
    want = brute_nearest(ids, x, queries, 20)
    got = {}
    for r in ann.search(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = {int(i): n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert all(abs(s - x[at[q]] @ x[at[i]]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_walk_meets_cells_in_order():
    rng = np.random.default_rng(1)
    index = ann.MultiIndex((rng.normal(size=(7, 3)), rng.normal(size=(5, 3))), rng.integers(0, 2, 35))
    for _ in range(20):
        q = rng.normal(size=6)
        score = [(index.halves[0][c // 5] @ q[:3] + index.halves[1][c % 5] @ q[3:]) for c in range(35)]
        want = [c for c in sorted(range(35), key=lambda c: -score[c]) if index.counts[c]]
        assert np.allclose([score[c] for c in index.walk(q)], [score[c] for c in want]) and len(set(index.walk(q))) == len(want)


def test_copies_ties_and_odd_vectors(spark):
    rng = random.Random(2)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(0, 300)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300, 400)]
    rows += [(0, same), (400, None), (420, [0.0] * 4), (440, [1.0, None, 1.0, 1.0]), (460, [float("nan")] * 4), (480, [float("inf")] * 4),
             (500, [1.0, 1.0]), (520, []), (None, same)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("VEC_ID", "rep", "cell", "block", "q", "score")])
    got = {}
    for r in ann.search(table, "vec_id % 20 = 0", k=20, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 400, 20))
    assert got[0] == list(range(1, 21)) and got[20] == [*range(0, 20)] and got[280] == list(range(0, 20))
    few = spark.createDataFrame([(0, same), (1, same), (2, [1.0, 0.0, 0.0, 0.0])], table.schema[:2])
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, "vec_id % 20 = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.where("vec_id = 0"), "vec_id % 20 = 0").count() == 0
    assert ann.search(table.where("false"), "vec_id % 20 = 0").count() == 0


def test_blocks_cover_all_cells():
    index = ann.MultiIndex((np.zeros((3, 2)), np.zeros((3, 2))), np.array([10, ann.BLOCK * 2 + 1, 0, ann.BLOCK, 5, 5, 5000, 1, 1]))
    first, parts, n = ann._blocks(index)
    held = np.zeros(n)
    for c, count in enumerate(index.counts):
        held[first[c]:first[c] + parts[c]] += count / parts[c]
    assert held.sum() == index.counts.sum() and held.max() <= ann.BLOCK


def records_by_ranges(data, split):
    handle, out = pa.BufferReader(data), []
    for start in range(0, len(data), split):
        out += list(warc.read_range(handle, len(data), start, start + split))
    return out


def test_every_split_owns_its_records():
    rng = random.Random(4)
    key, bodies, data = b"k" * 16, [], b""
    inner = gzip.compress(warc.record(9, None, b"inner", None))
    own = warc.member(warc.record(8, None, b"copied", None), b"x" * 16, 0)
    for i in range(60):
        payload = rng.choice([b"", rng.randbytes(rng.randint(1, 5000)), b"text " * rng.randint(1, 2000), inner * 3, own * 2, warc.MAGIC * 50])
        bodies.append(warc.record(i, f"http://x/{i}\r\ny", payload, None if i % 3 else 0))
        data += warc.member(bodies[-1], key, len(data))
    assert gzip.decompress(data) == b"".join(bodies)
    for split in (7, 100, 1000, 4096, len(data) // 2, len(data)):
        assert records_by_ranges(data, split) == bodies, split


def test_archives_of_other_writers():
    bodies = [warc.record(i, None, f"<html>{i}</html>".encode() * 200, None) for i in range(40)]
    data = b"".join(gzip.compress(b) for b in bodies)
    for split in (50, 333, 5000):
        assert records_by_ranges(data, split) == bodies
    assert warc.parse(bodies[3])["payload"] == b"<html>3</html>" * 200


def test_round_trip(spark):
    html = ["<p>ünï 😀</p>", "<p>ünï 😀</p>", None, "", "x" * 3_000_000, "same", "same", "same", "null id", "null id", "other null"]
    ids = [5, 3, 2, 7, 11, 20, 19, 19, None, 30, None]
    pages = spark.createDataFrame(list(zip(ids, [f"http://h/{i}" for i in range(10)] + [None], html)), "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit(1).alias(c) for c in ("HTML", "payload", "sha1", "first", "path", "bytes")])
    got = [r.asDict() for r in warc.archive_pages(pages, archive_bytes=2_000, split_bytes=500).collect()]
    assert len(got) == len(html)
    want = {(5, "revisit", 3), (3, "response", None), (2, "response", None), (7, "revisit", 2), (11, "response", None), (20, "revisit", 19),
            (19, "response", None), (None, "revisit", 30), (30, "response", None), (None, "response", None)}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == want
    sent = {i: (h or "").encode() for i, h in zip(ids, html) if i is not None}
    for r in got:
        if r["page_id"] is not None:
            full = sent[r["page_id"]]
            assert r["payload_bytes"] == len(full) and r["payload_digest"] == base64.b32encode(hashlib.sha1(full).digest()).decode()
            assert bytes(r["payload"]) == (full if r["record_type"] == "response" else b"")
    big = [r.asDict() for r in warc.archive_pages(pages, min_bytes=5).collect()]
    assert {(r["page_id"], r["record_type"]) for r in big if r["page_id"] in (2, 7, 20)} == {(2, "response"), (7, "response"), (20, "response")}
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_archives_are_plain_gzip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    from tidemark.session import new_path
    folder = new_path(spark, "warc-test")
    manifest = warc.write_archives(warc.roles(pages), folder if "://" in folder else f"file://{folder}").collect()
    assert sum(m["records"] for m in manifest) == pages.count()
    for m in manifest:
        with open(m["path"], "rb") as f:
            data = f.read()
        assert len(data) == m["bytes"] == os.path.getsize(m["path"])
        assert gzip.open(io.BytesIO(data)).read().startswith(b"WARC/1.1\r\n")


def test_one_reader_per_range(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(400)], "page_id long, url string, html string").repartition(4)
    folder = f"file://{new_path(spark, 'warc')}"
    manifest = warc.write_archives(warc.roles(pages, 0), folder, 4000)
    want = sum(-(-r["bytes"] // 1000) for r in manifest.collect())
    read = warc.read_archives(manifest, split_bytes=1000)
    assert want > 20 and read.rdd.getNumPartitions() == want
    assert sorted(r["page_id"] for r in read.collect()) == list(range(400))


def test_large_records_over_many_chunks(spark, monkeypatch, tmp_path):
    """A record longer than many chunks, and small ones around it, come back whole from any range."""
    import os

    import pyarrow as pa

    monkeypatch.setattr(warc, "CHUNK", 1 << 12)
    monkeypatch.setattr(warc, "STEP", 100)
    bodies = [warc.record(i, "http://x", os.urandom(n), None) for i, n in enumerate([10, 300_000, 0, 7, 50_000] + [20] * 200)]
    data = b""
    for b in bodies:
        data += warc.member(b, b"k" * 16, len(data))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for split in (10_000, 123_457, len(data)):
        found = []
        for start in range(0, len(data), split):
            with pa.OSFile(str(path)) as handle:
                found += list(warc.read_range(handle, len(data), start, min(start + split, len(data))))
        assert found == bodies
