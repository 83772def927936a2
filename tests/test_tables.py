"""Sources, upserts, profile, quality, guard and streaming on small hand-written inputs."""

import glob
import os
import hashlib
import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import adhoc, advisory, charts, prep, profile, quality, upsert
from tidemark.operators.market import resample_bars, ticker_metrics
from tidemark.sources import files, prices, raw, sinks
from tidemark.streaming.ingest import run_ingest

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# -- sources -------------------------------------------------------------------------------------------------------------

def test_price_csv_takes_the_ticker_from_the_file_name(spark, tmp_path):
    (tmp_path / "spy_1d.csv").write_text("Date,Close,Volume\n2024-01-02 00:00:00+00:00,10,5\n2024-01-03,bad,6\n")
    got = rows(files.scan_price_csv(spark, str(tmp_path)).select("ticker", "date", "open", "close", "volume"))
    assert got == [("SPY", D(2024, 1, 2), None, 10.0, 5.0), ("SPY", D(2024, 1, 3), None, None, 6.0)]
    other = tmp_path / "other"
    other.mkdir()
    (other / "gld_1d.csv").write_text("Date,Ticker,Close\n2024-01-02,,1\n2024-01-03,iau,2\n")
    assert [r[0] for r in rows(files.scan_price_csv(spark, str(other)), "date")] == ["GLD", "IAU"]


def payload(ticker, days, close):
    recs = [{"_date": str(d), "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "adj_close": close, "volume": 3.0} for d in days]
    return {"ticker": ticker, "asset_class": "etf", "source": "yfinance", "interval": "1d", "rows": len(recs), "records": recs}


def put(path, name, obj):
    with gzip.open(path / name, "wt") as f:
        json.dump(obj, f)


def test_raw_payload_files(spark, tmp_path):
    put(tmp_path, "a.json.gz", payload("SPY", [D(2024, 1, 2), D(2024, 1, 3)], 10.0))
    got = rows(raw.scan_raw_bars(spark, str(tmp_path)).select("ticker", "_date", "close"))
    assert got == [("SPY", "2024-01-02", 10.0), ("SPY", "2024-01-03", 10.0)]


def test_raw_macro_drops_missing_values(spark, tmp_path):
    obs = [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "5.1"}, {"date": "", "value": "1"},
           {"date": "2024-01-03", "value": "x"}]
    put(tmp_path, "m.json.gz", {"series_id": "DFF", "meta": {"frequency": "Daily", "units": "Percent"}, "observations": obs})
    got = rows(raw.scan_raw_macro(spark, str(tmp_path), "r").select("observation_date", "value", "frequency", "units", "title"))
    assert got == [(D(2024, 1, 2), 5.1, "Daily", "Percent", "DFF")]


def test_jdbc_predicates_cover_every_date_once():
    tests = prices.jdbc_predicates(["spy", "o'x"], "large", D(2024, 1, 1), 3, D(2024, 1, 10))
    assert len(tests) == 3 and all("upper(ticker) IN ('SPY', 'O''X')" in t and "'LARGE'" in t for t in tests)
    assert "date >= DATE '2024-01-01'" in tests[0] and "date <" not in tests[-1]
    assert prices.jdbc_predicates() == ["1 = 1"]


def test_sample_is_stable_and_exact(spark):
    df = spark.range(5000)
    a = rows(files.seeded_sample(df, 100, ["id"]))
    assert a == rows(files.seeded_sample(df.repartition(11), 100, ["id"])) and len(a) == 100
    assert a != rows(files.seeded_sample(df, 100, ["id"], seed=1))
    copies = spark.range(5000).select(F.lit(1).alias("id"))
    assert files.seeded_sample(copies, 100, ["id"]).count() == 100


def test_inventory_hashes_every_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 50)
    got = rows(files.file_inventory(spark, str(tmp_path)))
    assert got == [("a.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("b.bin", 50, hashlib.sha256(b"x" * 50).hexdigest())]


def test_inventory_of_big_files_goes_block_by_block(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    made = {"a b%20[1].bin": rng.randbytes(300_000), "end.bin": rng.randbytes(150_000) + b"\n", "two.bin": rng.randbytes(150_000) + b"\n\n", "cr.txt": b"x\r\n\r" * 40_000,
            "one.bin": b"\0" * 200_000, "lines.bin": b"\n" * 90_000, "mark.csv": b"\xef\xbb\xbf" + b"a,b\n" * 30_000, "p.gz": rng.randbytes(80_000), "small": b"abc"}
    (tmp_path / "sub").mkdir()
    for i, (name, data) in enumerate(made.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(data)
    turns, advance = [], files._advance
    monkeypatch.setattr(files, "_advance", lambda lines, states: turns.append(len(states)) or advance(lines, states))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1_000)
        got = rows(files.file_inventory(spark, str(tmp_path), whole_bytes=60_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got) == sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items())
    assert len(turns) >= 7 and max(turns) >= 5  # blocks in turn, files beside each other


def test_scan_turns_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("A", D(2024, 1, 1), float("nan")), ("A", D(2024, 1, 2), 2.0)], "ticker string, date date, close double").write.parquet(path)
    assert rows(prices.scan_prices(spark, path).select("date", "close", "open")) == [(D(2024, 1, 1), None, None), (D(2024, 1, 2), 2.0, None)]


def test_curated_write_replaces_only_its_own_symbols(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([("etf", "A", D(2024, 1, 1), 1.0), ("etf", "B", D(2024, 1, 1), 2.0)],
                                "asset_class string, symbol string, trade_date date, close double")
    sinks.write_curated(one, path)
    sinks.write_curated(one.where("symbol = 'B'").withColumn("close", F.lit(9.0)), path)
    assert rows(spark.read.parquet(path).select("symbol", "close")) == [("A", 1.0), ("B", 9.0)]


# -- upserts -------------------------------------------------------------------------------------------------------------------

KEYS = ["ticker", "date"]
SCHEMA = "ticker string, date date, v double"


def test_upsert_new_wins_and_splits_do_not_matter(spark):
    old = spark.createDataFrame([("A", D(2024, 1, d), float(d)) for d in range(1, 9)] + [(None, D(2024, 1, 1), 0.0)], SCHEMA)
    new = spark.createDataFrame([("A", D(2024, 1, d), d * 10.0) for d in range(5, 12)] + [("B", None, 1.0)], SCHEMA)
    once = rows(upsert.merge_upsert(old, new, KEYS))
    assert len(once) == 11 and once[4] == ("A", D(2024, 1, 5), 50.0)
    first = new.where(F.dayofmonth("date") < 8)
    twice = upsert.merge_upsert(upsert.merge_upsert(old, first, KEYS), new.where(F.dayofmonth("date") >= 8), KEYS)
    assert rows(twice) == once
    assert rows(upsert.merge_upsert(spark.createDataFrame(once, SCHEMA), new, KEYS)) == once


def test_upsert_of_a_batch_with_repeats(spark):
    old = spark.createDataFrame([("A", D(2024, 1, 1), 1.0)], SCHEMA)
    new = spark.createDataFrame([("A", D(2024, 1, 1), float(v)) for v in range(500)], SCHEMA)
    assert rows(upsert.merge_upsert(old, new, KEYS, order=["v"])) == [("A", D(2024, 1, 1), 499.0)]


def test_incremental_equals_full(spark):
    from tests.test_windows import make

    from tidemark.operators.analytics import returns

    df, _ = make(spark, n=400)
    full = returns(df, "M").select("ticker", "date", "ret_21d")
    cut = D(2020, 10, 1)
    stored = full.where(F.col("date") <= cut)
    recent = returns(upsert.warmup_slice(df, stored, 22), "M").select("ticker", "date", "ret_21d")
    assert rows(upsert.merge_incremental(stored, recent)) == rows(full)


def test_last_business_day():
    days = {D(2024, 5, 6): D(2024, 5, 3), D(2024, 5, 7): D(2024, 5, 6), D(2024, 5, 11): D(2024, 5, 10), D(2024, 5, 12): D(2024, 5, 10)}
    assert all(upsert.last_business_day(a) == b for a, b in days.items())


def test_build_market_orders_runs(spark):
    cols = ["open", "high", "low", "close", "adj_close", "volume"]
    base = spark.createDataFrame([("etf", "A", D(2024, 1, 1), r, c) for r, c in (("1", 5.0), ("2", 7.0))] + [("macro", "M", D(2024, 1, 1), "1", 1.0)],
                                 "asset_class string, symbol string, trade_date date, run_id string, close double")
    full = base.withColumns({c: F.col("close") for c in cols})
    assert rows(upsert.build_market(full, ["etf"], ["run_id"]).select("ticker", "close")) == [("A", 7.0)]


# -- cleaning and summary --------------------------------------------------------------------------------------------------------

def test_clean_and_store(spark):
    raw_rows = spark.createDataFrame([("a ", "2024-01-01", "1.5"), ("A", "2024-01-01", "2.5"), ("", "2024-01-01", "1"), ("A", "x", "1"), ("A", "2024-01-02", "NaN")],
                                     "ticker string, date string, close string").withColumn("n", F.monotonically_increasing_id())
    assert rows(prep.normalise_for_store(raw_rows, ["n"]).select("ticker", "date", "close")) == [("A", D(2024, 1, 1), 2.5)]
    cleaned = prep.clean_bars(raw_rows)
    assert cleaned.where("adj_close = close").count() == 4 and "volume" in cleaned.columns


def test_metrics_of_a_single_bar(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 2), 5.0)], "ticker string, date date, close double")
    assert rows(ticker_metrics(df)) == [("A", 5.0, None, 0.0, None, None, None, None, 5.0, 5.0, None)]
    assert ticker_metrics(df.where("false")).count() == 0


def test_resample_skips_nulls_and_empty_weeks(spark):
    bars = [("A", D(2024, 1, 1), None, 2.0), ("A", D(2024, 1, 3), 3.0, 4.0), ("A", D(2024, 1, 19), 5.0, None), ("A", D(2024, 1, 20), 6.0, 7.0)]
    df = spark.createDataFrame(bars, "ticker string, date date, open double, close double").withColumns(
        {c: F.col("close") for c in ("high", "low", "adj_close", "volume")})
    got = rows(resample_bars(df, "1wk").select("date", "open", "close"))
    assert got == [(D(2024, 1, 5), 3.0, 4.0), (D(2024, 1, 19), 5.0, None), (D(2024, 1, 26), 6.0, 7.0)]


# -- workbench -----------------------------------------------------------------------------------------------------------------------

def test_names_and_labels():
    assert profile.normalized_names(["A b", "a-B", " ", "!!", "x"]) == ["a_b", "a_b_2", "col", "col_2", "x"]
    assert profile.name_label("price") == "amount" and profile.name_label("order_date") == ""
    assert profile.name_label("order_date", by_token=True) == "date" and profile.name_label("id") == "id"


def table(spark):
    data = [(i, float(i), float(2 * i), "x" if i % 2 else "y", f"2024-01-{i % 28 + 1:02d}", "k" * 90 + str(i), None, 1) for i in range(100)]
    return spark.createDataFrame(data + data[:20], "key int, a double, b double, cat string, day string, body string, empty string, one int")


def test_types_profile_and_rules(spark):
    df = table(spark)
    facts = profile.column_facts(df)
    kinds = {n: c["inferred_type"] for n, c in facts.columns.items()}
    assert kinds == {"key": "numeric", "a": "numeric", "b": "numeric", "cat": "categorical", "day": "datetime", "body": "text",
                     "empty": "mixed", "one": "numeric"}
    columns = profile.column_profile(df, facts)
    by = {r["column_name"]: r for r in columns.collect()}
    pd_a = df.toPandas()["a"]
    assert by["a"]["median"] == pytest.approx(pd_a.median()) and by["a"]["skewness"] == pytest.approx(pd_a.skew())
    assert by["a"]["kurtosis"] == pytest.approx(pd_a.kurtosis()) and by["empty"]["null_pct"] == 1.0
    assert by["body"]["distinct_count"] == 100 and by["day"]["date_range_days"] == 27
    dups = profile.duplicate_rows(df)
    assert rows(dups) == [(120, 20, 0.1667)]
    issues = quality.quality_issues(columns, dups, profile.correlations(df, facts))
    found = {(r["rule"], ",".join(r["columns"])) for r in issues.collect()}
    assert found == {("high_null_rate", "empty"), ("moderate_duplicate_rows", ""), ("high_correlation", "a,b"), ("high_correlation", "key,a"),
                     ("high_correlation", "key,b"), ("constant_column", "one"), ("pii_detected", "key")}
    text = {r["rule"]: r["message"] for r in issues.collect()}
    assert text["high_null_rate"] == "100.0% of the rows have no value in 'empty'."
    score = quality.quality_score(issues)
    assert rows(score.select("high", "warning", "score")) == [(1, 2, 70)]
    assert rows(quality.quality_subscores(score, dups)) == [(75, 67, 84, 70)]
    masked = {r["column_name"]: r for r in profile.mask_profile(columns).collect()}
    assert masked["key"]["mean_value"] is None and masked["a"]["mean_value"] is not None


def test_empty_table_profile(spark):
    df = table(spark).where("false")
    facts = profile.column_facts(df)
    assert set(c["inferred_type"] for c in facts.columns.values()) == {"mixed"}
    assert profile.column_profile(df, facts).count() == 8
    assert rows(profile.duplicate_rows(df)) == [(0, 0, 0.0)]
    assert charts.histogram(df, "a").count() == 0


def test_charts(spark):
    df = table(spark)
    hist = rows(charts.histogram(df, "a"))
    assert sum(r[3] for r in hist) == 120 and len(hist) == 40
    assert rows(charts.histogram(df, "one")) == [(0, 1.0, 1.0, 120)]
    assert rows(charts.pie(df, "cat").select("value", "n", "share")) == [("x", 60, 0.5), ("y", 60, 0.5)]
    roll = charts.rolling_line(df, "day", "a", 3, ["key"])
    assert roll.count() == 120
    assert len([s for s in charts.view_specs(profile.column_facts(df), [("a", "b")], True) if s["chart"] == "histogram"]) == len(
        profile.column_facts(df).of_type("numeric"))
    specs = charts.view_specs(profile.column_facts(df), [("a", "b")], True, histograms=4, bars=3, lines=3, groups=2, heatmap=12, scatters=2)
    assert [s["chart"] for s in specs] == ["kpi", "missingness", *["histogram"] * 4, "bar", *["line"] * 3, "group", "heatmap", "scatter", "rolling"]


@pytest.mark.parametrize("word", adhoc.FORBIDDEN)
def test_guard_refuses_words(spark, word):
    assert adhoc.check_sql(spark, f"SELECT 1 FROM data WHERE x = '{word.lower()} it'")


@pytest.mark.parametrize("sql", ["DELETE FROM data", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1; SELECT 2",
                                 "SELECT * FROM other", "SELECT * FROM data JOIN secret ON true", "SELECT * FROM parquet.`/etc/x`",
                                 "SELECT * FROM dataset, secret", "SELECT * FROM (secret)", "SELECT * FROM/**/secret", "SELECT (SELECT max(id) FROM secret) FROM data",
                                 "SELECT * FROM data WHERE EXISTS (SELECT 1 FROM `secret`)", "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM range(9)",
                                 "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM data", "SELECT FROM data WHERE ("])
def test_guard_refuses_statements(spark, sql):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(ValueError):
        adhoc.run_sql(table(spark), sql)


def test_guard_leaves_literals_and_views_alone(spark):
    spark.range(2).createOrReplaceTempView("data")
    assert rows(adhoc.answer(spark.range(1), "SELECT 'x from data y' AS v, id FROM Data -- from other")) == [("x from data y", 0)]
    assert spark.table("data").count() == 2
    spark.catalog.dropTempView("data")
    with pytest.raises(Exception):
        adhoc.answer(spark.range(200_000_000_000), "SELECT sum(id * 1.5) FROM data", seconds=1)


def test_guard_limits_every_result(spark):
    df = spark.range(100)
    assert adhoc.run_sql(df, "select id from df", row_limit=7).count() == 7
    assert adhoc.run_sql(df, "SELECT id FROM (SELECT id FROM data LIMIT 50) t", row_limit=20).count() == 20
    assert len(adhoc.fetch(adhoc.run_sql(df, "SELECT id FROM table", row_limit=3))) == 3


def test_nearest_fund_outside_every_range(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 2.0), (3, 9.0), (4, 4.4)], "id int, score double")
    got = [(r["id"], r["fund"]) for r in advisory.recommend_funds(df, "score").orderBy("id", "fund").collect()]
    assert got == [(1, "F1"), (2, "F1"), (2, "F2"), (3, "F4"), (4, "F3")]


# -- streaming ---------------------------------------------------------------------------------------------------------------------------

def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    src, out, ck = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    put(src, "1.json.gz", payload("spy", [D(2024, 1, 2), D(2024, 1, 3)], 10.0))
    assert run_ingest(spark, str(src), out, ck) == 1
    first = rows(spark.read.parquet(out).select("symbol", "trade_date", "close"))
    assert run_ingest(spark, str(src), out, ck) == 0
    assert rows(spark.read.parquet(out).select("symbol", "trade_date", "close")) == first
    put(src, "2.json.gz", payload("SPY", [D(2024, 1, 3), D(2024, 1, 4)], 11.0))
    put(src, "3.json.gz", payload("GLD", [D(2024, 1, 4)], 5.0))
    assert run_ingest(spark, str(src), out, ck) == 2
    assert rows(spark.read.parquet(out).select("symbol", "trade_date", "close")) == [
        ("GLD", D(2024, 1, 4), 5.0), ("SPY", D(2024, 1, 2), 10.0), ("SPY", D(2024, 1, 3), 11.0), ("SPY", D(2024, 1, 4), 11.0)]


def test_ingest_late_files_ties_and_broken_tables(spark, tmp_path):
    src, out, ck = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    put(src, "new.json.gz", payload("SPY", [D(2024, 1, 2), D(2024, 2, 1)], 10.0))
    assert run_ingest(spark, str(src), out, ck) == 1
    put(src, "late.json.gz", payload("SPY", [D(2024, 1, 2), D(2024, 1, 3)], 99.0))
    os.utime(src / "late.json.gz", (1_000_000_000, 1_000_000_000))
    for name, close in (("a.json.gz", 5.0), ("b.json.gz", 6.0)):
        put(src, name, payload("GLD", [D(2024, 1, 4)], close))
        os.utime(src / name, (1_100_000_000, 1_100_000_000))
    february = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/asset_class=etf/month=2024-02/*.parquet")}
    assert run_ingest(spark, str(src), out, ck, files_per_batch=1) == 3
    assert rows(spark.read.parquet(out).select("symbol", "trade_date", "close")) == [
        ("GLD", D(2024, 1, 4), 6.0), ("SPY", D(2024, 1, 2), 10.0), ("SPY", D(2024, 1, 3), 99.0), ("SPY", D(2024, 2, 1), 10.0)]
    assert february and {f: os.path.getmtime(f) for f in glob.glob(f"{out}/asset_class=etf/month=2024-02/*.parquet")} == february
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "x.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        sinks.exists(spark, str(broken))
    assert not sinks.exists(spark, str(tmp_path / "nowhere"))


# -- plans ----------------------------------------------------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_the_date_and_reads_only_what_is_used(spark, tmp_path):
    from tests.test_windows import make

    path = str(tmp_path / "m")
    sinks.write_market(make(spark, 50)[0], path)
    text = plan(prices.scan_prices(spark, path, D(2020, 3, 1), 20).select("ticker", "close"))
    assert "GreaterThanOrEqual(date,2020-02-10)" in text and "ReadSchema: struct<ticker:string,date:date,close:double>" in text


def test_metrics_of_a_ticker_share_one_shuffle(spark, tmp_path):
    from tests.test_windows import make

    from tidemark.operators.analytics import technical

    path = str(tmp_path / "m")
    sinks.write_market(make(spark, 50)[0], path)
    text = plan(technical(prices.scan_prices(spark, path), "M"))
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "GLD_a.csv").write_text("Date,Open,Close\n2024-01-02,1,2\n2024-01-03,3,4\n")
    (tmp_path / "b c.csv").write_text("Close,\"Ticker\",Date,Volume,Extra\n12,spy,2024-01-02,7,x\n13,,2024-01-04,8,y\n")
    (tmp_path / "IAU.csv").write_text("Date,Open,Close\n2024-01-05,5,6\n")
    got = rows(files.scan_price_csv(spark, str(tmp_path)).select("ticker", F.col("date").cast("string"), "open", "close", "volume"))
    assert sorted(got) == [("B C", "2024-01-04", None, 13.0, 8.0), ("GLD", "2024-01-02", 1.0, 2.0, None), ("GLD", "2024-01-03", 3.0, 4.0, None),
                           ("IAU", "2024-01-05", 5.0, 6.0, None), ("SPY", "2024-01-02", None, 12.0, 7.0)]


def test_features_of_other_symbols_stay(spark, tmp_path):
    path = str(tmp_path / "f")
    schema = "date date, asset_class string, symbol_or_series string, feature_set string, feature_name string, feature_value double"
    day = dt.date(2024, 1, 5)
    sinks.write_features(spark.createDataFrame([(day, "macro", s, "v1", "x", 1.0) for s in "ab"] + [(dt.date(2024, 2, 1), "macro", "a", "v1", "x", 4.0)], schema), path)
    sinks.write_features(spark.createDataFrame([(day, "macro", "COMPOSITE", "v1", "x", 2.0), (day, "macro", "a", "v1", "x", 3.0)], schema), path)
    assert sorted(rows(sinks.read_features(spark, path).select("symbol_or_series", F.month("date"), "feature_value"))) == [
        ("COMPOSITE", 1, 2.0), ("a", 1, 3.0), ("a", 2, 4.0), ("b", 1, 1.0)]


@pytest.mark.parametrize("sql", [
    "SELECT '== Analyzed Logical Plan ==' AS a, x, y FROM secret_view",
    "SELECT (SELECT max(x) FROM secret_view) AS a, '== Analyzed Logical Plan ==' FROM data",
    "SELECT x AS `== Analyzed Logical Plan ==` FROM secret_view",
    "SELECT * FROM values (1)",
    "SELECT * FROM data WHERE x IN (SELECT x FROM secret_view)",
    "SELECT * FROM data d WHERE EXISTS (SELECT 1 FROM secret_view s WHERE s.x = d.x)",
    "SELECT * FROM (WITH q AS (SELECT * FROM secret_view) SELECT * FROM q)",
    "SELECT * FROM data, LATERAL (SELECT * FROM secret_view)",
    "SELECT x FROM data UNION ALL SELECT x FROM `secret_view`",
    "SELECT * FROM IDENTIFIER('secret_view')",
    "SELECT * FROM range(5)",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM global_temp.data",
])
def test_guard_reads_the_parsed_plan(spark, sql):
    spark.createDataFrame([(1, 2)], "x int, y int").createOrReplaceTempView("secret_view")
    try:
        with pytest.raises(ValueError):
            adhoc.run_sql(spark.createDataFrame([(1, 2)], "x int, y int"), sql)
    finally:
        spark.catalog.dropTempView("secret_view")


@pytest.mark.parametrize("sql", [
    "SELECT x, sum(y) OVER (PARTITION BY x ORDER BY y) AS s FROM data",
    "SELECT x, count(*) AS n FROM dataset GROUP BY x HAVING count(*) >= 1 ORDER BY n LIMIT 3",
    "SELECT DISTINCT d.x FROM data d JOIN (SELECT max(x) AS m FROM tbl) t ON d.x = t.m",
    "SELECT x, e FROM df LATERAL VIEW explode(array(y)) t AS e",
    "SELECT x FROM data WHERE y = (SELECT max(y) FROM data) UNION SELECT y FROM `table`",
])
def test_guard_lets_queries_of_the_dataset_through(spark, sql):
    assert adhoc.run_sql(spark.createDataFrame([(1, 2)], "x int, y int"), sql).count() >= 1


@pytest.mark.parametrize("columns", [1, 2, 7])
def test_correlations_in_one_pass(spark, columns):
    import numpy as np
    import pandas as pd

    from tidemark.operators.market import pairwise_corr

    rng = np.random.default_rng(columns)
    x = rng.normal(0, 1, (400, columns)) * 10.0 ** np.arange(columns) + 1e6
    x[:, -1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(columns)]).assign(const=7.3, empty=np.nan)
    frame.loc[:3, "const"] = np.nan
    names = list(frame.columns)
    df = spark.createDataFrame([[None if v != v else float(v) for v in row] for row in frame.to_numpy().tolist()], ", ".join(f"`{c}` double" for c in names))
    got = {(r["col1"], r["col2"]): r["corr"] for r in pairwise_corr(df.repartition(5), names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    want = frame.corr()
    for (a, b), c in got.items():
        if "const" in (a, b) or "empty" in (a, b):
            assert c is None
        else:
            assert c == pytest.approx(want.loc[a, b], abs=1e-9)
    assert all(r["corr"] is None for r in pairwise_corr(df.where("false"), names).collect())


def test_undated_rows_are_no_duplicates(spark):
    import datetime as dt

    from tidemark.operators.market import bar_quality, series_quality

    d = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([("a", x, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for x in (d, d, None, None)],
                                 "symbol string, trade_date date, open double, high double, low double, close double, adj_close double, volume double")
    assert bar_quality(bars).first()["duplicate_rows"] == 1
    series = spark.createDataFrame([("a", x, 1.0) for x in (d, d, d, None, None)], "series_id string, observation_date date, value double")
    assert series_quality(series).first()["duplicate_rows"] == 2


def test_top_values_as_json(spark):
    import json

    df = spark.createDataFrame([(x,) for x in ["b", "a", "a", 'q"uote', None, "b", "c"]], "x string")
    facts = profile.column_facts(df)
    got = profile.top_values_json(df, facts, 3).first()["top_values"]
    assert list(json.loads(got).items()) == [("a", 2), ("b", 2), ("c", 1)]
    assert profile.top_values_json(df.where("false"), profile.column_facts(df.where("false"))).collect() == []
