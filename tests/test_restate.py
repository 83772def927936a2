"""Restated history against computing everything again, and reading only the newest month."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import restate as rs
from tidemark.operators.analytics import MODULES
from tidemark.operators.batch import newest_modules, run_analytics, stored_modules
from tidemark.operators.snapshot import latest_rows
from tidemark.session import new_path
from tidemark.sources.sinks import partition_values

START = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double, cap_category string"


def made(seed=1, days=700):
    rng = random.Random(seed)
    rows = []
    for i, (name, tier, share) in enumerate([("A", "LARGE", 1.0), ("B", "LARGE", 0.7), ("C", "MID", 0.95), ("D", "SMALL", 0.5), ("E", "SMALL", 1.0)]):
        price = 100.0 + i
        for d in range(days if name != "E" else 40):
            if rng.random() > share:
                continue
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((name, START + dt.timedelta(d), price, price * 1.01, price * 0.99, price, price, float(rng.randrange(100, 900)), tier))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def values(df, columns):
    return {(r["ticker"], r["date"]): [r[c] for c in columns] for r in df.collect()}


def change(rows, seed):
    """One corrected month, removed bars, a new ticker and new bars at the end."""
    rng = random.Random(seed)
    out = [r for r in rows if not (r[0] == "C" and dt.date(2021, 3, 3) <= r[1] <= dt.date(2021, 3, 6))]
    out = [(*r[:5], r[5] * 1.2, *r[6:]) if r[0] == "B" and r[1].strftime("%Y-%m") == "2021-01" else r for r in out]
    out += [("N", START + dt.timedelta(500 + i), 5.0, 5.5, 4.5, 5 + rng.random(), 5.0, 10.0, "MID") for i in range(90)]
    return out + [(r[0], r[1] + dt.timedelta(700), *r[2:]) for r in rows if r[0] in "AD" and r[1] < START + dt.timedelta(20)]


def test_restated_equals_computing_everything(spark):
    rows = made()
    root = new_path(spark, "restate")
    rs.restate(table(spark, rows), "M", root)
    now = table(spark, change(rows, 3))
    months = rs.restate(now, "M", root)
    stored = stored_modules(spark, root)
    for m, module in MODULES.items():
        full = module(now, "M")
        columns = [c for c in full.columns if c not in ("ticker", "market", "date")]
        got, want = values(stored[m], columns), values(full, columns)
        assert got.keys() == want.keys(), m
        for key, row in want.items():
            for a, b, c in zip(got[key], row, columns):
                assert (a is None) == (b is None) and (b is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), (m, key, c)
        assert months[m][0] == "2021-01" and len(months[m]) < 24
    again = rs.restate(now, "M", root)
    assert all(x == [] for x in again.values())  # nothing changed


def test_only_months_from_the_change_on_are_written(spark, tmp_path):
    import os

    rows = made(4)
    root = str(tmp_path / "modules")
    rs.restate(table(spark, rows), "M", root, ["returns", "momentum"])
    stamp = lambda m: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(os.path.join(root, m)) for f in fs if "month=2020" in d}
    before = {m: stamp(m) for m in ("returns", "momentum")}
    rs.restate(table(spark, change(rows, 5)), "M", root, ["returns", "momentum"])
    assert before["returns"] and before == {m: stamp(m) for m in ("returns", "momentum")}


def test_digests(spark):
    rows = made(2, 60)
    one = {tuple(r) for r in rs.digests(table(spark, rows)).collect()}
    assert one == {tuple(r) for r in rs.digests(table(spark, rows[::-1])).collect()}
    moved = [(*r[:7], r[7] + 1, r[8]) if i == 30 else r for i, r in enumerate(rows)]
    old, new = rs.digests(table(spark, rows)), rs.digests(table(spark, [*moved, (None, START, *moved[0][2:]), ("A", None, *moved[0][2:])]))
    assert [tuple(r) for r in rs.changed_since(old, new).collect()] == [(rows[30][0], rows[30][1].strftime("%Y-%m"))]
    assert [tuple(r) for r in rs.changed_since(old, old.where("ticker <> 'E'")).collect()] == [("E", "2020-01")]
    assert rs.changed_since(old, old).collect() == []


def test_snapshot_reads_one_month_of_each_module(spark):
    rows, root = made(6), new_path(spark, "analytics")
    prices = table(spark, rows)
    run_analytics(prices, "M", root)
    run_analytics(prices.where("date < '2020-03-01'"), "other", root, ["returns"])
    newest = newest_modules(spark, root, "M")
    whole = stored_modules(spark, root)
    for m, df in newest.items():
        files = {r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}
        assert files and all("month=2021-11" in f and "market=M" in f for f in files)
        assert "PartitionFilters: [isnotnull(market" in df._jdf.queryExecution().executedPlan().toString()
        assert partition_values(spark, f"{root}/{m}", market="M")[-1] == "2021-11"
        mine = whole[m].where("market = 'M'")
        columns = [c for c in df.columns if c not in ("market", "month")]
        assert sorted(map(str, latest_rows(df).select(*columns).collect())) == sorted(map(str, latest_rows(mine).select(*columns).collect()))
    assert list(newest_modules(spark, root, "other")) == ["returns"] and newest_modules(spark, root, "none") == {}
