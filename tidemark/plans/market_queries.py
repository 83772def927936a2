"""Queries over sources, sinks, cleaning, upserts and the market summary (S, F01-F08, F16, F23, A01-A05, A40, U, T)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import analytics as an
from tidemark.operators import market as mk
from tidemark.operators import prep
from tidemark.operators import upsert as up
from tidemark.operators.batch import append_log, run_analytics, run_log, runs_of, stored_modules
from tidemark.operators.restate import restate
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import FRIDAY, block, changed, modules, r, rolled, statement
from tidemark.schemas import HISTORY_COLUMNS, PRICE_COLUMNS
from tidemark.session import new_path
from tidemark.sources import files, prices, raw, sinks
from tidemark.sources import tables as src

AS_OF = dt.date(2001, 11, 5)
P = ", ".join(PRICE_COLUMNS)
RP = r(*PRICE_COLUMNS)
_M = modules("bars")
_W = modules("weekly")


@query("t00_top_momentum", statement(
    f"""SELECT ticker, date, {r('mom_1m')} FROM bars_m_momentum WHERE date = (SELECT max(date) FROM bars_m_momentum)
    AND mom_1m IS NOT NULL ORDER BY mom_1m DESC, ticker LIMIT 3""", "bars_m_momentum"))
def _flagship(spark, sf_dir):
    from tidemark.operators.snapshot import latest_rows

    mom = an.momentum(src.stored(src.bars(spark, sf_dir)), "US_EQ").select("ticker", "date", "mom_1m")
    top = latest_rows(mom).where(F.col("mom_1m").isNotNull()).orderBy(F.col("mom_1m").desc(), "ticker").limit(3)
    return rounded(top)


# -- scans, sources, sinks -------------------------------------------------------------------------------------------

@query("s22_market_bars", statement(f"SELECT ticker, date, {RP}, cap_category FROM bars", "bars"))
def _bars(spark, sf_dir):
    return rounded(src.bars(spark, sf_dir))


@query("s22_dense_bars", statement(f"SELECT ticker, date, {RP}, cap_category FROM dense", "dense"))
def _dense(spark, sf_dir):
    return rounded(src.dense_bars(spark, sf_dir))


@query("s22_weekly_bars", statement(f"SELECT ticker, date, {RP}, cap_category FROM weekly", "weekly"))
def _weekly(spark, sf_dir):
    return rounded(src.weekly_bars(spark, sf_dir))


@query("s01_scan_prices", statement(
    f"SELECT ticker, date, {RP}, cap_category FROM bars WHERE date >= DATE '2001-11-05' - 400", "bars"))
def _scan(spark, sf_dir):
    path = new_path(spark, "market")
    sinks.write_market(src.bars(spark, sf_dir), path)
    return rounded(prices.scan_prices(spark, path, AS_OF, 400))


@query("s03_scan_price_csv", statement(f"SELECT ticker, date, {RP} FROM bars", "bars"))
def _scan_csv(spark, sf_dir):
    path = new_path(spark, "csv")
    headed = {v: k for k, v in files.CSV_HEADINGS.items()}
    bars = src.bars(spark, sf_dir).withColumn("ticker", F.lower("ticker"))
    bars = bars.drop("cap_category").withColumnsRenamed(headed)
    kind = F.crc32(F.col("Ticker").cast("binary")) % 2
    # Files of one folder with different columns in a different order.
    sinks.export_csv(bars.where(kind == 0), path)
    turned = bars.where(kind == 1).select(*reversed(bars.columns), F.lit("x").alias("Note"))
    turned.write.mode("append").csv(path, header=True)
    return rounded(files.scan_price_csv(spark, path).withColumn("ticker", F.initcap("ticker")))


@query("s04_scan_raw_bars", statement(
    f"SELECT ticker, CAST(date AS VARCHAR) AS _date, {RP}, cap_category AS cap_tier, 'equities' AS asset_class FROM bars",
    "bars"))
def _scan_raw(spark, sf_dir):
    path = new_path(spark, "raw")
    raw.bar_payloads(src.bars(spark, sf_dir), "equities").write.json(path, compression="gzip")
    return rounded(raw.scan_raw_bars(spark, path, multi_line=False).drop("source"))


@query("s05_scan_raw_macro", statement(
    f"""SELECT series_id, observation_date, {r('value')}, 'D' AS frequency, 'USD' AS units, '' AS seasonal_adjust,
    series_id AS title, 'fred' AS source FROM macro WHERE day(observation_date) <> 13""", "macro"))
def _scan_macro(spark, sf_dir):
    day = F.col("observation_date")
    value = F.when(F.dayofmonth(day) == 13, F.lit(".")).otherwise(F.col("value").cast("string"))
    none = F.lit(None).cast("string")
    meta = F.struct(none.alias("frequency_short"), F.lit("D").alias("frequency"), F.lit("USD").alias("units"))
    obs = F.struct(day.cast("string").alias("date"), value.alias("value"), day.cast("string").alias("realtime_start"),
                   day.cast("string").alias("realtime_end"))
    packed = src.macro_series(spark, sf_dir).groupBy("series_id", F.year(day).alias("_y")).agg(
        F.collect_list(obs).alias("observations")).select("series_id", meta.alias("meta"), "observations")
    path = new_path(spark, "macro")
    packed.write.json(path, compression="gzip")
    df = raw.scan_raw_macro(spark, path, "run-1", multi_line=False)
    return rounded(df.select("series_id", "observation_date", "value", "frequency", "units", "seasonal_adjust",
                             "title", "source"))


@query("s06_scan_user_file", " UNION ALL ".join(
    f"SELECT '{f}' AS fmt, c_custkey, c_name, c_nationkey, round(c_acctbal + 1e-9, 6) AS c_acctbal, c_mktsegment FROM customer"
    for f in ("csv", "json", "parquet")))
def _scan_user(spark, sf_dir):
    parts = []
    customer = src.table(spark, sf_dir, "customer")
    for fmt in ("csv", "json", "parquet"):
        path = new_path(spark, fmt)
        writer = customer.write.option("header", True)
        writer.format(fmt).save(path)
        df = files.scan_user_file(spark, path, fmt)
        parts.append(df.select(F.lit(fmt).alias("fmt"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                               F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment"))
    return rounded(up.union_all(*parts))


def _curated(spark, sf_dir):
    kind = (F.when(F.col("cap_category") == "LARGE", "equities").when(F.col("cap_category") == "MID", "etf")
            .otherwise("fixed_income"))
    return src.bars(spark, sf_dir).select(
        F.col("date").alias("trade_date"), F.col("ticker").alias("symbol"), kind.alias("asset_class"), *PRICE_COLUMNS,
        F.col("cap_category").alias("cap_tier"))


block("curated", ["bars"], """SELECT date AS trade_date, ticker AS symbol, CASE cap_category WHEN 'LARGE' THEN 'equities'
  WHEN 'MID' THEN 'etf' ELSE 'fixed_income' END AS asset_class, open, high, low, close, adj_close, volume,
  cap_category AS cap_tier FROM bars""")


@query("s07_write_curated", statement(f"SELECT trade_date, symbol, asset_class, {RP}, cap_tier FROM curated", "curated"))
def _write_curated(spark, sf_dir):
    path = new_path(spark, "curated")
    sinks.write_curated(_curated(spark, sf_dir), path)
    return rounded(sinks.read_curated(spark, path))


@query("s09_build_market", statement(
    f"SELECT ticker, date, {RP}, cap_category FROM bars WHERE cap_category <> 'SMALL'", "bars"))
def _build_market(spark, sf_dir):
    once = _curated(spark, sf_dir).withColumn("run_id", F.lit("b"))
    # An older run of the same bars, with other prices, must lose.
    older = once.withColumn("run_id", F.lit("a")).withColumn("close", F.col("close") * 2)
    return rounded(up.build_market(older.unionByName(once), ["equities", "etf"], ["run_id"]))


block("old_metrics", ["bars_m_returns"], """SELECT ticker, 'US_EQ' AS market, date, ret_1d, ret_5d FROM bars_m_returns
  WHERE date < DATE '2000-07-01'""")
block("new_metrics", ["bars_m_returns"], """SELECT ticker, 'US_EQ' AS market, date, ret_1d + 1 AS ret_1d, ret_5d
  FROM bars_m_returns WHERE date >= DATE '2000-01-01'""")


@query("s10_merge_analytics", statement(
    f"""SELECT ticker, market, date, {r('ret_1d', 'ret_5d')} FROM (SELECT * FROM new_metrics UNION ALL
    SELECT o.* FROM old_metrics o ANTI JOIN new_metrics n USING (ticker, market, date))""", "old_metrics", "new_metrics"))
def _merge_analytics(spark, sf_dir):
    rets = an.returns(src.stored(src.bars(spark, sf_dir)), "US_EQ").select("ticker", "market", "date", "ret_1d", "ret_5d")
    old = rets.where(F.col("date") < dt.date(2000, 7, 1))
    new = rets.where(F.col("date") >= dt.date(2000, 1, 1)).withColumn("ret_1d", F.col("ret_1d") + 1)
    return rounded(up.merge_upsert(old, new, ["ticker", "market", "date"]))


@query("s10_incremental_metrics", statement(f"SELECT ticker, market, date, {r('ret_1d', 'ret_252d')} FROM (SELECT *, 'US_EQ' AS "
                                            "market FROM bars_m_returns)", "bars_m_returns"))
def _incremental(spark, sf_dir):
    bars = src.stored(src.bars(spark, sf_dir))
    columns = ["ticker", "market", "date", "ret_1d", "ret_252d"]
    kept = an.returns(bars.where(F.col("date") < dt.date(2000, 7, 1)), "US_EQ").select(*columns)
    recent = an.returns(up.warmup_slice(bars, kept, 253), "US_EQ").select(*columns)
    return rounded(up.merge_incremental(kept, recent))


# A later delivery corrects the closes of one brand in March 1999, takes bars of another back, and adds the newest months.
_FIX = "ticker = 'Brand#7' AND date >= DATE '1999-03-01' AND date < DATE '1999-04-01'"
_GONE = "ticker = 'Brand#3' AND date >= DATE '2000-05-01' AND date < DATE '2000-05-04'"
block("fixed", ["bars"], f"SELECT * REPLACE (CASE WHEN {_FIX} THEN close * 1.1::DOUBLE ELSE close END AS close) FROM bars WHERE NOT ({_GONE})")
_F = modules("fixed")
_RESTATED = {"returns": ["ret_21d", "ret_252d"], "risk": ["vol_63d", "beta_252d", "max_dd_252d"], "momentum": ["mom_3m", "rs_vs_bench", "rank_universe"],
             "zscore": ["z_ret_21d", "z_cs_ret_1d", "pct_mom_3m"], "technical": ["rsi_14", "macd_signal", "ma_50", "obv"]}
_SHOWN = [c for cs in _RESTATED.values() for c in cs]


_DONE: dict[tuple[str, str], tuple[str, dict[str, list[str]]]] = {}  # of this application


def _restated(spark, sf_dir):
    """(root, months rewritten): modules of the first delivery, brought up to the corrected one; done once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _DONE:
        return _DONE[key]
    bars, root = src.stored(src.bars(spark, sf_dir)), new_path(spark, "analytics")
    restate(bars.where(F.col("date") < dt.date(2001, 6, 1)), "US_EQ", root)
    fixed = bars.withColumn("close", F.when(F.expr(_FIX), F.col("close") * 1.1).otherwise(F.col("close"))).where(~F.expr(_GONE))
    _DONE[key] = root, restate(src.stored(fixed), "US_EQ", root)
    return _DONE[key]


@query("s10_restated_history", statement(f"SELECT ticker, date, {r(*[c for c in _SHOWN if c != 'rank_universe'])}, rank_universe FROM {_F['returns']}"
       + "".join(f" LEFT JOIN {_F[m]} USING (ticker, date)" for m in list(_RESTATED)[1:]), *_F.values()))
def _restated_history(spark, sf_dir):
    """All stored metrics after the correction: they equal those computed from scratch."""
    root, _ = _restated(spark, sf_dir)
    made = {m: df.select("ticker", "date", *_RESTATED[m]) for m, df in stored_modules(spark, root, list(_RESTATED)).items()}
    out = made["returns"]
    for m in list(_RESTATED)[1:]:
        out = out.join(made[m], ["ticker", "date"], "left")
    return rounded(out)


@query("s10_months_rewritten", statement(" UNION ALL ".join(
    f"SELECT DISTINCT '{m}' AS module, strftime(date, '%Y-%m') AS month FROM {_F[m]} WHERE date >= DATE '1999-03-01'" for m in _RESTATED), *_F.values()))
def _months_rewritten(spark, sf_dir):
    _, months = _restated(spark, sf_dir)
    return spark.createDataFrame([(m, x) for m, xs in months.items() for x in xs], "module string, month string")


@query("s11_upsert_prices", f"""WITH px AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
  l_orderkey, l_extendedprice / l_quantity AS close, l_quantity AS volume, ROW(l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
  old AS (SELECT ticker, date, arg_max(close, k) AS close, arg_max(volume, k) AS volume FROM px
    WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
  new AS (SELECT ticker, date, arg_max(close, k) AS close, arg_max(volume, k) AS volume FROM px
    WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)
  SELECT ticker, date, {r('close', 'volume')} FROM (SELECT * FROM new UNION ALL
  SELECT o.* FROM old o ANTI JOIN new n USING (ticker, date))""")
def _upsert_prices(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    part = src.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    trades = src.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "ticker", F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"), *order)
    even = prep.newest_per_key(trades.where(F.col("l_orderkey") % 2 == 0), ["ticker", "date"], order)
    odd = trades.where(F.col("l_orderkey") % 2 == 1)
    merged = up.merge_upsert(even, odd, ["ticker", "date"], order)
    return rounded(merged.select("ticker", "date", "close", "volume"))


@query("s12_last_date", statement("SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker", "bars"))
def _last_date(spark, sf_dir):
    return up.last_date(src.bars(spark, sf_dir), "ticker")


@query("s13_stale_tickers", statement("""SELECT ticker, max(date) AS last_date, CAST(max(date) + 1 AS DATE) AS missing_from,
  DATE '2001-11-02' AS missing_to FROM bars GROUP BY ticker HAVING max(date) < DATE '2001-11-02'""", "bars"))
def _stale(spark, sf_dir):
    return up.stale_tickers(src.bars(spark, sf_dir), AS_OF)


@query("s14_list_tickers", statement("SELECT DISTINCT ticker FROM bars WHERE cap_category = 'LARGE'", "bars"))
def _list_tickers(spark, sf_dir):
    return up.list_tickers(src.bars(spark, sf_dir), "large")


@query("s15_get_ohlcv", statement(
    f"SELECT ticker, date, {RP}, cap_category FROM bars WHERE upper(ticker) = 'BRAND#7' AND date >= DATE '2001-11-05' - 504",
    "bars"))
def _ohlcv(spark, sf_dir):
    return rounded(prices.get_ohlcv(src.bars(spark, sf_dir), "brand#7", AS_OF))


def _history_sql() -> str:
    parts = []
    for name, columns in HISTORY_COLUMNS.items():
        for c in columns:
            parts.append(f"SELECT '{name}' AS module, date, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {_M[name]} "
                         "WHERE ticker = 'Brand#7' AND date >= DATE '2001-11-05' - 504")
    return statement(f"SELECT module, date, metric, {r('value')} FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL",
                     *_M.values())


@query("s16_analytics_history", _history_sql())
def _history(spark, sf_dir):
    root = new_path(spark, "analytics")
    run_analytics(src.stored(src.bars(spark, sf_dir)), "US_EQ", root)
    made = stored_modules(spark, root)
    return rounded(prices.long_history(prices.analytics_history(made, "brand#7", "US_EQ", AS_OF)))


@query("s17_export_csv", statement(f"SELECT ticker, date, {r('ret_1d', 'ret_21d')} FROM bars_m_returns", "bars_m_returns"))
def _export(spark, sf_dir):
    path = new_path(spark, "export")
    rets = an.returns(src.bars(spark, sf_dir), "US_EQ").select("ticker", "date", "ret_1d", "ret_21d")
    sinks.export_csv(rets, path)
    return rounded(spark.read.csv(path, header=True, schema=rets.schema))


@query("s18_profile_sample", """SELECT c_custkey, c_name, c_mktsegment FROM customer
  ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 200""")
def _sample(spark, sf_dir):
    customer = src.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return files.profile_sample(customer, ["c_custkey"], n=200)


@query("s19_file_inventory")
def _inventory(spark, sf_dir):
    return files.file_inventory(spark, sf_dir)


@query("s20_dataset_inventory", statement("""SELECT asset_class, count(DISTINCT symbol) AS symbols, count(*) AS rows,
  min(trade_date) AS first_date, max(trade_date) AS last_date FROM curated GROUP BY 1""", "curated"))
def _datasets(spark, sf_dir):
    return up.dataset_inventory(_curated(spark, sf_dir))


@query("s21_truncate_prices", statement("""SELECT 'loaded' AS stage, count(*) AS rows FROM bars
  UNION ALL SELECT 'truncated', 0 UNION ALL SELECT 'reloaded', count(*) FROM bars""", "bars"))
def _truncate(spark, sf_dir):
    path = new_path(spark, "market")
    bars = src.bars(spark, sf_dir)

    def rows(stage: str):
        # Counted at once: the files change between the stages.
        n = spark.read.parquet(path).count()
        return spark.range(1).select(F.lit(stage).alias("stage"), F.lit(n).cast("bigint").alias("rows"))

    sinks.write_market(bars, path)
    loaded = rows("loaded")
    sinks.truncate_prices(spark, path)
    truncated = rows("truncated")
    sinks.write_market(bars, path)
    return up.union_all(loaded, truncated, rows("reloaded"))


# -- cleaning and filters ------------------------------------------------------------------------------------------------

@query("f01_clean_bars", statement(f"""SELECT ticker, date, {r('open', 'high', 'close', 'adj_close', 'volume')},
  CAST(NULL AS DOUBLE) AS low FROM (SELECT * REPLACE (CASE WHEN volume % 7 = 1 THEN NULL ELSE open END AS open)
  FROM bars WHERE volume % 5 <> 1)""", "bars"))
def _clean(spark, sf_dir):
    text = src.bars(spark, sf_dir).select(
        "ticker", "date", F.when(F.col("volume") % 7 == 1, "n/a").otherwise(F.col("open").cast("string")).alias("open"),
        F.col("high").cast("string").alias("high"),
        F.when(F.col("volume") % 5 == 1, "NaN").otherwise(F.col("close").cast("string")).alias("close"),
        F.col("volume").cast("string").alias("volume"))
    return rounded(prep.clean_bars(text))


@query("f02_normalize_bars", statement(f"""SELECT date AS trade_date, upper(ticker) AS symbol, 'equities' AS asset_class,
  {RP}, 'USD' AS currency, 'NYSE' AS exchange, 'yfinance' AS source, 'run-1' AS run_id FROM bars""", "bars"))
def _normalize(spark, sf_dir):
    rows = src.bars(spark, sf_dir).withColumn("_date", F.col("date").cast("string"))
    return rounded(prep.normalize_bars(rows, "equities", "run-1", exchange="NYSE").drop("ingested_at_utc"))


@query("f03_normalise_for_store", f"""SELECT upper(trim(p_name)) AS ticker, CAST(l_shipdate AS DATE) AS date,
  {r('close', 'volume')}, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low,
  CAST(NULL AS DOUBLE) AS adj_close FROM (SELECT upper(trim(p_name)) AS p_name, l_shipdate,
  arg_max(l_extendedprice, k) AS close, arg_max(l_quantity, k) AS volume FROM (SELECT *, ROW(l_orderkey, l_linenumber,
  l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE l_quantity <> 13 GROUP BY ALL)""")
def _store(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    part = src.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = src.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit(" "), "p_name").alias("ticker"), F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.when(F.col("l_quantity") == 13, "?").otherwise(F.col("l_extendedprice").cast("string")).alias("close"),
        F.col("l_quantity").cast("string").alias("volume"), *order)
    return rounded(prep.normalise_for_store(rows, order).select("ticker", "date", *PRICE_COLUMNS))


@query("f04_curated_to_market", statement(
    f"SELECT trade_date AS date, symbol AS ticker, asset_class, {RP}, cap_tier AS cap_category FROM curated", "curated"))
def _rename(spark, sf_dir):
    return rounded(prep.curated_to_market(_curated(spark, sf_dir)))


@query("f05_cap_tier", statement("""SELECT ticker, date, CASE WHEN ticker = 'PROMO' THEN 'UNKNOWN' WHEN ticker IN
  ('ECONOMY', 'LARGE') THEN 'LARGE' WHEN ticker = 'MEDIUM' THEN 'MID' ELSE 'SMALL' END AS cap_category FROM dense""", "dense"))
def _cap_tier(spark, sf_dir):
    tiers = spark.createDataFrame([("ECONOMY", "LARGE"), ("LARGE", "LARGE"), ("MEDIUM", "MID"), ("SMALL", "SMALL"),
                                   ("STANDARD", "SMALL")], "ticker string, cap_category string")
    return prep.with_cap_tier(src.dense_bars(spark, sf_dir), tiers).select("ticker", "date", "cap_category")


@query("f06_sanitize_tickers", """SELECT c_custkey, CASE WHEN ok THEN upper(s) ELSE s END AS symbol, ok AS kept FROM (
  SELECT c_custkey, s, upper(s) IN ('SPY', 'BUILDING', 'MACHINERY', '^TNX', 'VIX') AND upper(s) NOT IN
  ('VIX', 'VIXY', 'VIXM') AND NOT starts_with(upper(s), '^') AS ok FROM (SELECT c_custkey,
  trim(unnest(string_split(' spy,' || lower(c_mktsegment) || ' ,^TNX,, vix,' || c_mktsegment, ','))) AS s FROM customer)
  WHERE s <> '')""")
def _sanitize(spark, sf_dir):
    asked = src.table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        F.lit(" spy,"), F.lower("c_mktsegment"), F.lit(" ,^TNX,, vix,"), F.col("c_mktsegment")).alias("arg"))
    allow = ["SPY", "BUILDING", "MACHINERY", "^TNX", "VIX"]
    return prep.sanitize_tickers(asked, "arg", allow).select("c_custkey", "symbol", "kept")


@query("f07_trim_period", statement("""SELECT ticker, date FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS m
  FROM bars) WHERE date >= m - 182""", "bars"))
def _trim(spark, sf_dir):
    return prep.trim_period(src.bars(spark, sf_dir), "6mo").select("ticker", "date")


@query("f08_lookback", statement(f"SELECT ticker, date, {r('close')} FROM bars WHERE date >= DATE '2001-11-05' - 30", "bars"))
def _lookback(spark, sf_dir):
    return rounded(prep.lookback(src.bars(spark, sf_dir), AS_OF, 30).select("ticker", "date", "close"))


@query("f16_candle_direction", statement(
    "SELECT ticker, date, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM bars", "bars"))
def _candle(spark, sf_dir):
    return prep.candle_direction(src.bars(spark, sf_dir)).select("ticker", "date", "direction")


_RENAMED = {"ECONOMY": "SPY", "LARGE": "XLK", "MEDIUM": "GLD"}


@query("f23_ticker_category", statement("""SELECT ticker, count(*) AS bars, category, label FROM (
  SELECT CASE ticker WHEN 'ECONOMY' THEN 'SPY' WHEN 'LARGE' THEN 'XLK' WHEN 'MEDIUM' THEN 'GLD' ELSE ticker END AS ticker,
  CASE ticker WHEN 'ECONOMY' THEN 'Core Market' WHEN 'LARGE' THEN 'Sectors' WHEN 'MEDIUM' THEN 'Rates, Credit & Macro' END
  AS category, CASE ticker WHEN 'ECONOMY' THEN 'S&P 500 (SPY)' WHEN 'LARGE' THEN 'Technology (XLK)' WHEN 'MEDIUM' THEN
  'Gold (GLD)' END AS label FROM dense) GROUP BY ALL""", "dense"))
def _category(spark, sf_dir):
    df = src.dense_bars(spark, sf_dir).replace(_RENAMED, subset=["ticker"])
    return prep.with_ticker_group(df).groupBy("ticker", "category", "label").agg(F.count(F.lit(1)).alias("bars"))


# -- market summary --------------------------------------------------------------------------------------------------------

block("metrics", ["bars"], f"""SELECT ticker, last, (last / nullif(p1, 0) - 1) * 100 AS chg_1d_pct,
  (last / nullif(ys, 0) - 1) * 100 AS ytd_pct, (last / nullif(p21, 0) - 1) * 100 AS ret_1m_pct,
  (last / nullif(p63, 0) - 1) * 100 AS ret_3m_pct, (last / nullif(p126, 0) - 1) * 100 AS ret_6m_pct,
  (last / nullif(p252, 0) - 1) * 100 AS ret_1y_pct, hi_52w, lo_52w, vol_ann_pct FROM (SELECT ticker,
  max(close) FILTER (rn = 1) AS last, max(close) FILTER (rn = 2) AS p1, max(close) FILTER (rn = 22) AS p21,
  max(close) FILTER (rn = 64) AS p63, max(close) FILTER (rn = 127) AS p126, max(close) FILTER (rn = 253) AS p252,
  arg_min(close, date) FILTER (year(date) = y) AS ys, max(close) FILTER (rn <= 252) AS hi_52w,
  min(close) FILTER (rn <= 252) AS lo_52w, stddev_samp(ret) * sqrt(252) * 100 AS vol_ann_pct FROM (SELECT *,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn, year(max(date) OVER (PARTITION BY ticker)) AS y,
  {changed('close', 1)} AS ret FROM bars) GROUP BY ticker)""")
_METRICS = ["last", "chg_1d_pct", "ytd_pct", "ret_1m_pct", "ret_3m_pct", "ret_6m_pct", "ret_1y_pct", "hi_52w", "lo_52w",
            "vol_ann_pct"]


@query("a01_ticker_metrics", statement(f"SELECT ticker, {r(*_METRICS)} FROM metrics", "metrics"))
def _metrics(spark, sf_dir):
    return rounded(mk.ticker_metrics(src.bars(spark, sf_dir)))


@query("f15_range_position", statement(f"""SELECT ticker, {r('range_pct')} FROM (SELECT ticker, CASE WHEN lo_52w <> 0 AND
  hi_52w > lo_52w THEN greatest(0, least(100, (last - lo_52w) / (hi_52w - lo_52w) * 100)) ELSE 0 END AS range_pct
  FROM metrics)""", "metrics"))
def _range(spark, sf_dir):
    return rounded(mk.range_position(mk.ticker_metrics(src.bars(spark, sf_dir))).select("ticker", "range_pct"))


@query("t01_movers", statement(f"""SELECT ticker, {r('chg_1d_pct')}, side FROM (
  (SELECT *, 'gainer' AS side FROM metrics WHERE chg_1d_pct IS NOT NULL ORDER BY chg_1d_pct DESC, ticker LIMIT 3) UNION ALL
  (SELECT *, 'loser' AS side FROM metrics WHERE chg_1d_pct IS NOT NULL ORDER BY chg_1d_pct, ticker LIMIT 3))""", "metrics"))
def _movers(spark, sf_dir):
    df = mk.movers(mk.ticker_metrics(src.bars(spark, sf_dir)))
    return rounded(df.select("ticker", "chg_1d_pct", "side"))


def _resample_sql(label: str) -> str:
    return statement(f"""SELECT ticker, date, {r('open', 'high', 'low', 'close', 'adj_close', 'volume')} FROM (
      SELECT ticker, {label} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, date) AS close, arg_max(adj_close, date) AS adj_close, sum(volume) AS volume FROM bars GROUP BY 1, 2)
      """, "bars")


@query("a02_resample_weekly", _resample_sql(FRIDAY.format("date")))
def _resample_w(spark, sf_dir):
    return rounded(mk.resample_bars(src.bars(spark, sf_dir), "1wk"))


@query("a02_resample_monthly", _resample_sql("last_day(date)"))
def _resample_m(spark, sf_dir):
    return rounded(mk.resample_bars(src.bars(spark, sf_dir), "1mo"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("a03_corr_matrix", statement(f"""SELECT a.ticker AS col1, b.ticker AS col2,
  round(CASE WHEN a.ticker = b.ticker THEN 1.0 ELSE corr(a.cs_ret, b.cs_ret) END + 1e-9, 6) AS corr
  FROM dense_m_sig a JOIN dense_m_sig b USING (date) GROUP BY 1, 2""", modules("dense")["zscore"]))
def _corr(spark, sf_dir):
    return rounded(mk.corr_matrix(src.dense_bars(spark, sf_dir), _TYPES))


_RAW_ROWS = """raw_rows AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
  CASE WHEN l_quantity > 40 THEN NULL ELSE l_extendedprice END AS open, l_extendedprice AS high, l_extendedprice AS low,
  l_extendedprice AS close, CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice END AS adj_close
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("a04_bar_quality", f"""WITH {_RAW_ROWS} SELECT symbol, rows, round(m + 1e-9, 4) AS missing_pct, duplicate_rows, first_date,
  last_date, m < 0.05 AND duplicate_rows = 0 AS passed FROM (SELECT symbol, count(*) AS rows,
  (5.0::DOUBLE * count(*) - count(open) - count(high) - count(low) - count(close) - count(adj_close)) / (5 * count(*)) AS m,
  count(*) - count(DISTINCT trade_date) AS duplicate_rows, min(trade_date) AS first_date, max(trade_date) AS last_date
  FROM raw_rows GROUP BY symbol)""")
def _bar_quality(spark, sf_dir):
    part = src.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    px, qty = F.col("l_extendedprice"), F.col("l_quantity")
    rows = src.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", F.col("l_shipdate").cast("date").alias("trade_date"), F.when(qty <= 40, px).alias("open"),
        px.alias("high"), px.alias("low"), px.alias("close"), F.when(qty != 13, px).alias("adj_close"))
    return rounded(mk.bar_quality(rows))


@query("a05_series_quality", """SELECT series_id, rows, round(m + 1e-9, 4) AS missing_pct, duplicate_rows, first_date, last_date,
  m < 0.1 AND duplicate_rows = 0 AS passed FROM (SELECT o_orderpriority AS series_id, count(*) AS rows,
  1.0::DOUBLE * count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 300000) / count(*) AS m,
  count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) AS duplicate_rows, min(CAST(o_orderdate AS DATE)) AS first_date,
  max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1)""")
def _series_quality(spark, sf_dir):
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)
    rows = src.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("observation_date"),
        F.when(~bad, F.col("o_totalprice")).alias("value"))
    return rounded(mk.series_quality(rows))


_RSI_G = rolled("avg", "g", 14)
_RSI_L = rolled("avg", "l", 14)


@query("w31_rsi_sma", statement(f"""SELECT ticker, date, {r('rsi')} FROM (SELECT ticker, date, 100 - 100 / (1 + mg /
  CASE WHEN ml = 0 THEN 2.220446049250313e-16 ELSE ml END) AS rsi FROM (SELECT ticker, date, {_RSI_G} AS mg, {_RSI_L} AS ml
  FROM (SELECT ticker, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN
  greatest(-d, 0) END AS l FROM (SELECT ticker, date, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS d
  FROM bars))))""", "bars"))
def _rsi_sma(spark, sf_dir):
    return rounded(mk.rsi_sma(src.bars(spark, sf_dir)))


_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"


@query("w32_chart_indicators", statement(f"""SELECT ticker, date, {r('bb_upper', 'bb_mid', 'bb_lower', 'macd', 'signal',
  'histogram', 'atr')} FROM (SELECT ticker, date, macd_line AS macd, macd_signal AS signal, macd_hist AS histogram
  FROM bars_m_ema) JOIN (SELECT ticker, date, bb_upper, bb_mid, bb_lower FROM bars_m_technical) USING (ticker, date)
  JOIN (SELECT ticker, date, {rolled('avg', 'tr', 14)} AS atr FROM (SELECT ticker, date, {_TR} AS tr FROM (SELECT *,
  lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM bars))) USING (ticker, date)""",
    "bars_m_ema", "bars_m_technical"))
def _chart_indicators(spark, sf_dir):
    return rounded(mk.chart_indicators(src.bars(spark, sf_dir)))


@query("w33_rebase_100", statement(f"""SELECT ticker, date, {r('"index"')} FROM (
  SELECT ticker, date, close / nullif(first_value(close) OVER (PARTITION BY ticker ORDER BY date), 0) * 100 AS "index"
  FROM bars)""", "bars"))
def _rebase(spark, sf_dir):
    return rounded(mk.rebase_100(src.bars(spark, sf_dir)))


@query("r02_pivot_prices", statement("SELECT date, " + ", ".join(
    f"round(avg(close) FILTER (ticker = '{t}') + 1e-9, 6) AS \"{t}\"" for t in _TYPES) +
    " FROM dense GROUP BY date", "dense"))
def _pivot(spark, sf_dir):
    return rounded(mk.pivot_prices(src.dense_bars(spark, sf_dir), _TYPES))


@query("r03_melt", statement(f"SELECT date, ticker, {r('close')} FROM dense", "dense"))
def _melt(spark, sf_dir):
    wide = mk.pivot_prices(src.dense_bars(spark, sf_dir), _TYPES)
    return rounded(wide.unpivot("date", _TYPES, "ticker", "close").where(F.col("close").isNotNull()))


@query("a40_module_summary", statement("SELECT '2001-11-05'::DATE AS run_date, 'run-1' AS run_id, " + f"""
  CAST(count(*) FILTER (rows >= 0) AS BIGINT) AS ok_count, CAST(count(*) FILTER (rows < 0) AS BIGINT) AS fail_count,
  CAST(sum(greatest(rows, 0)) AS BIGINT) AS rows_written, 'partial' AS status FROM (""" + " UNION ALL ".join(
    f"SELECT count(*) AS rows FROM {_M[m]}" for m in ("returns", "momentum")) + " UNION ALL SELECT -1)",
    _M["returns"], _M["momentum"]))
def _summary(spark, sf_dir):
    root = new_path(spark, "analytics")
    rows = run_analytics(src.stored(src.bars(spark, sf_dir)), "US_EQ", root, ["returns", "momentum"])
    log = new_path(spark, "run-log")
    append_log(run_log(spark, rows, "US_EQ", AS_OF - dt.timedelta(1), "run-0"), log)
    append_log(run_log(spark, {**rows, "risk": -1}, "US_EQ", AS_OF, "run-1"), log)
    return up.run_summary(runs_of(spark, log, AS_OF))


# -- set operations ----------------------------------------------------------------------------------------------------------

@query("u01_union", statement(f"SELECT ticker, date, {r('close')}, cap_category FROM bars UNION ALL "
                              f"SELECT ticker, date, {r('close')}, NULL FROM dense", "bars", "dense"))
def _union(spark, sf_dir):
    a = src.bars(spark, sf_dir).select("ticker", "date", "close", "cap_category")
    return rounded(up.union_all(a, src.dense_bars(spark, sf_dir).select("ticker", "date", "close")))


@query("u02_union_dedupe", f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
  round(arg_max(o_totalprice, o_orderkey) + 1e-9, 6) AS last_value, round(arg_min(o_totalprice, o_orderkey) + 1e-9, 6) AS first_value
  FROM orders GROUP BY 1, 2""")
def _union_dedupe(spark, sf_dir):
    rows = src.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("value"), "o_orderkey")
    stacked = up.union_all(rows, rows)
    keys = ["series_id", "date"]
    last = prep.newest_per_key(stacked, keys, ["o_orderkey"]).select(*keys, F.col("value").alias("last_value"))
    back = stacked.withColumn("_k", -F.col("o_orderkey"))
    first = prep.newest_per_key(back, keys, ["_k"]).select(*keys, F.col("value").alias("first_value"))
    return rounded(last.join(first, keys))


@query("u05_distinct_symbols", "SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT DISTINCT p_type FROM part")
def _symbols(spark, sf_dir):
    part = src.table(spark, sf_dir, "part")
    both = part.select(F.col("p_brand").alias("ticker")).unionByName(part.select(F.col("p_type").alias("ticker")))
    return up.list_tickers(both)


@query("t06_ordered_output", statement(f"""SELECT ticker, date, {r('close')},
  count(*) OVER (PARTITION BY ticker) AS bars, true AS in_order FROM bars""", "bars"))
def _ordered(spark, sf_dir):
    path = new_path(spark, "ordered")
    bars = src.bars(spark, sf_dir)
    sinks.write_market(bars, path)
    stored = prices.scan_prices(spark, path)
    # The order in which the rows lie in each block of each file.
    lying = spark.read.parquet(path).select("ticker", "date", F.col("_metadata.file_path").alias("file"),
                                            F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    before = F.lag("date").over(Window.partitionBy("file", "at", "ticker").orderBy("row"))
    ordered = lying.withColumn("ok", F.coalesce(before <= F.col("date"), F.lit(True))).groupBy("ticker").agg(F.every("ok").alias("in_order"))
    counts = stored.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars")).join(ordered, "ticker")
    return rounded(stored.select("ticker", "date", "close").join(counts, "ticker"))
