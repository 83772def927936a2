"""The five rolling metric modules: returns, risk, momentum, zscore, technical.

Each takes a market table (ticker, date, open .. volume, cap_category; one row per ticker and date) and gives
(ticker, market, date, metrics).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators.ordering import ranks_within
from tidemark.sources.tables import stored

TRADING_DAYS = 252
ANNUAL = math.sqrt(TRADING_DAYS)
KEYS = ["ticker", "market", "date"]


def _nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def _enough(x: Column, least: int) -> Column:
    return F.count(x).over(Window.partitionBy("ticker")) >= least


# -- returns ------------------------------------------------------------------------------------------------------

def returns(prices: DataFrame, market: str) -> DataFrame:
    o, close = win.series(), F.col("close")
    spans = [1, 5, 21, 63, 126, 252]
    return (
        prices.select(
            "ticker", F.lit(market).alias("market"), "date", close,
            *[win.change(close, k, o).alias(f"ret_{k}d") for k in spans],
            F.ln(F.try_divide(close, F.lag(close, 1).over(o))).alias("log_ret_1d"),
            F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("_bars"),
        )
        .where("_bars >= 2")
        .select(*KEYS, "ret_1d", "log_ret_1d", *[f"ret_{k}d" for k in spans[1:]])
    )


# -- benchmarks -----------------------------------------------------------------------------------------------------

def benchmark_members(prices: DataFrame, ticker: str | None) -> DataFrame:
    """Bars of the benchmark ticker, else of the LARGE tier, else (no such tier) of the whole market."""
    if ticker is not None:
        return prices.where(F.col("ticker") == ticker)
    large = prices.where(F.col("cap_category") == "LARGE")
    return prices if large.isEmpty() else large


def mean_per_bar(prices: DataFrame, *values: str) -> DataFrame:
    """One row per (date, ticker): duplicates are averaged, with map-side combine."""
    return prices.groupBy("date", "ticker").agg(*[F.avg(v).alias(v) for v in values])


def mean_return_benchmark(prices: DataFrame, ticker: str | None = None) -> DataFrame:
    """(date, bench_ret): row return of one ticker, or equal-weight mean of calendar returns."""
    members = benchmark_members(prices, ticker)
    if ticker is not None:
        return members.select("date", win.change(F.col("close"), 1, win.series()).alias("bench_ret"))
    bars = win.with_calendar_index(mean_per_bar(members, "close"))
    rets = bars.select("date", win.calendar_change(F.col("close"), 1, "ticker").alias("r"))
    return rets.groupBy("date").agg(F.avg("r").alias("bench_ret"))


def mean_price_benchmark(prices: DataFrame, n: int, ticker: str | None = None) -> DataFrame:
    """(date, bench_price, bench_change) on every date of the market, gaps filled with the last seen price."""
    members = benchmark_members(prices, ticker)
    level = mean_per_bar(members, "close").groupBy("date").agg(F.avg("close").alias("level"))
    # One row per calendar date from here on.
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        prices.select("date").distinct().join(F.broadcast(level), "date", "left")
        .select("date", F.last("level", ignorenulls=True).over(run).alias("bench_price"))
    )
    return filled.withColumn("bench_change", win.change(F.col("bench_price"), n, Window.orderBy("date")))


def align_benchmark(prices: DataFrame, bench: DataFrame) -> DataFrame:
    """Left join on date; a benchmark has one row per calendar date."""
    return prices.join(F.broadcast(bench), "date", "left")


# -- risk -------------------------------------------------------------------------------------------------------------

def risk(prices: DataFrame, market: str, bench_ticker: str | None = None) -> DataFrame:
    o = win.series()
    r = F.col("ret")
    df = prices.select("ticker", "date", "close", win.change(F.col("close"), 1, o).alias("ret"))
    df = df.withColumn("_ok", _enough(r, 22)).where("_ok").drop("_ok").withColumn("_neg", F.when(r < 0, r))
    df = win.with_window_drawdown(df, "close", TRADING_DAYS, "max_dd_252d")
    df = win.with_rolling(df, 21, {"m21": ("avg", "ret"), "s21": ("std", "ret")})
    df = win.with_rolling(df, 63, {"m63": ("avg", "ret"), "s63": ("std", "ret")})
    df = win.with_rolling(df, 252, {"m252": ("avg", "ret"), "s252": ("std", "ret")})
    df = win.with_rolling(df, 252, {"down": ("std", "_neg")}, need=2)
    df = align_benchmark(df, mean_return_benchmark(prices, bench_ticker))
    return with_beta(df).selectExpr(
        "ticker", f"'{market}' AS market", "date", *[f"s{n} * {ANNUAL!r}D AS vol_{n}d" for n in (21, 63, 252)],
        *[f"try_divide(m{n}, s{n}) * {ANNUAL!r}D AS sharpe_{n}d" for n in (63, 252)],
        f"CASE WHEN m252 IS NOT NULL THEN try_divide(m252, down) * {ANNUAL!r}D END AS sortino_252d", "max_dd_252d",
        "beta_252d", "alpha_252d", "m21 - 1.645D * s21 AS var_95_21d", "m21 - 2.063D * s21 AS cvar_95_21d",
    )


def with_beta(df: DataFrame, n: int = TRADING_DAYS) -> DataFrame:
    """Beta and yearly alpha of ``ret`` on ``bench_ret`` over the n aligned pairs before the current row.

    Rows without both returns do not count, so they form their own series; the frame ends one row back.
    """
    keys = ("ticker", "_pair")
    stats = {"_mr": ("avg", "ret"), "_mb": ("avg", "bench_ret"), "_sb": ("std", "bench_ret"), "_cov": ("cov", "ret,bench_ret")}
    paired = df.selectExpr("*", "ret IS NOT NULL AND bench_ret IS NOT NULL AS _pair")
    rolled = win.with_rolling(paired, n, stats, keys)
    before = [f"lag({c}) OVER (PARTITION BY ticker, _pair ORDER BY date) AS p{c}" for c in stats]
    beta = "CASE WHEN _pair AND p_sb * p_sb >= 1e-12D THEN try_divide(p_cov, p_sb * p_sb) END AS beta_252d"
    return rolled.selectExpr("*", *before).selectExpr("*", beta).selectExpr(
        *df.columns, "beta_252d", f"(p_mr - beta_252d * p_mb) * {TRADING_DAYS} AS alpha_252d")


# -- momentum -----------------------------------------------------------------------------------------------------------

def momentum(prices: DataFrame, market: str, bench_ticker: str | None = None) -> DataFrame:
    o, close = win.series(), F.col("close")
    df = prices.select(
        "ticker", "date",
        *[win.change(close, k, o).alias(f"mom_{m}m") for m, k in ((1, 21), (3, 63), (6, 126), (12, 252))],
        (F.try_divide(F.lag(close, 21).over(o), F.lag(close, 252).over(o)) - 1).alias("mom_12m_skip1m"),
        (win.change(close, 20, o) * 100).alias("roc_20d"),
        (win.change(close, 60, o) * 100).alias("roc_60d"),
        "close", F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("_bars"),
    ).where("_bars >= 22")
    df = win.with_rolling(df, 252, {"_hi": ("max", "close"), "_lo": ("min", "close")}).withColumns({
        "hi_52w_pct": (F.try_divide(close, F.col("_hi")) - 1) * 100,
        "lo_52w_pct": (F.try_divide(close, F.col("_lo")) - 1) * 100,
    })
    bench = mean_price_benchmark(prices, TRADING_DAYS, bench_ticker).select("date", "bench_change")
    df = align_benchmark(df, bench).withColumn(
        "rs_vs_bench", F.try_divide(1 + F.col("mom_12m"), 1 + _nonzero(F.col("bench_change")))
    )
    df = rank_universe(df, "mom_12m")
    return df.select(
        "ticker", F.lit(market).alias("market"), "date", "mom_1m", "mom_3m", "mom_6m", "mom_12m", "mom_12m_skip1m",
        "roc_20d", "roc_60d", "hi_52w_pct", "lo_52w_pct", "rs_vs_bench", "rank_universe",
    )


def rank_universe(df: DataFrame, value: str) -> DataFrame:
    """Rank per date, best first; ties share the smallest rank and nulls share the place after the last value."""
    ranks = ranks_within(df, ["date"], value, descending=True)
    totals = df.groupBy("date").agg(F.count(value).alias("_valued"))
    return (
        df.join(ranks.select("date", value, "below"), ["date", value], "left")
        .join(F.broadcast(totals), "date")
        .withColumn("rank_universe", (F.coalesce("below", "_valued") + 1).cast("int"))
        .drop("below", "_valued")
    )


# -- zscore -----------------------------------------------------------------------------------------------------------------

def percentile_ranks(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Percentile ranks per date, 0 to 100, ties averaged, nulls left out of the count, of all columns in one pass.

    The rows are written once and read by the ranking and by the join that brings the ranks back.
    """
    rows = stored(df, "signals")
    entries = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values])
    long = rows.select("date", "ticker", F.explode(entries).alias("e")).select("date", "ticker", "e.*").where("value IS NOT NULL")
    ranks = ranks_within(long, ["date", "metric"], "value", descending=False)
    place = (F.col("below") + 1 + (F.col("ties") - 1) / 2) / F.col("total") * 100
    placed = long.join(ranks.select("date", "metric", "value", place.alias("place")), ["date", "metric", "value"])
    wide = placed.groupBy("date", "ticker").agg(*[F.max(F.when(F.col("metric") == v, F.col("place"))).alias(out) for v, out in values.items()])
    return rows.join(wide, ["date", "ticker"], "left")


def cross_section_zscores(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Standardise columns over all tickers of a date.

    Mean and spread come from a partial aggregation and return as one row per date, so a crowded date is never
    gathered in one task.
    """
    stats = df.groupBy("date").agg(
        *[F.avg(v).alias(f"_{v}_mean") for v in values], *[F.stddev_samp(v).alias(f"_{v}_std") for v in values]
    )
    df = df.join(F.broadcast(stats), "date")
    for v, out in values.items():
        df = df.withColumn(out, F.try_divide(F.col(v) - F.col(f"_{v}_mean"), F.col(f"_{v}_std")))
    return df.drop(*[f"_{v}_{s}" for v in values for s in ("mean", "std")])


def calendar_signals(prices: DataFrame) -> DataFrame:
    """(date, ticker) with calendar return, distance from the 20-date mean, volume ratio and 63-date change."""
    df = win.with_calendar_index(mean_per_bar(prices, "close", "volume"))
    close, volume = F.col("close"), F.col("volume")
    return df.select(
        "date", "ticker",
        win.calendar_change(close, 1, "ticker").alias("cs_ret"),
        (F.try_divide(close, win.calendar_mean(close, 20, "ticker")) - 1).alias("cs_gap"),
        F.try_divide(volume, win.calendar_mean(volume, 21, "ticker")).alias("cs_volume"),
        win.calendar_change(close, 63, "ticker").alias("cs_mom"),
    )


def zscore_series(prices: DataFrame) -> DataFrame:
    df = prices.select("ticker", "date", "close", "volume", win.change(F.col("close"), 1, win.series()).alias("_ret"))
    df = win.with_zscores(df, 21, {"close": "z_price_21d", "volume": "z_volume_21d", "_ret": "z_ret_21d"})
    return win.with_zscores(df, 63, {"close": "z_price_63d"})


def zscore(prices: DataFrame, market: str) -> DataFrame:
    cross = cross_section_zscores(
        calendar_signals(prices),
        {"cs_ret": "z_cs_ret_1d", "cs_gap": "z_cs_price_vs_ma20", "cs_volume": "z_cs_volume"},
    )
    cross = percentile_ranks(cross, {"cs_ret": "pct_ret_1d", "cs_mom": "pct_mom_3m"})
    df = zscore_series(prices).join(cross, ["ticker", "date"], "left")
    return df.select(
        "ticker", F.lit(market).alias("market"), "date", "z_price_21d", "z_price_63d", "z_volume_21d", "z_ret_21d",
        "z_cs_ret_1d", "z_cs_price_vs_ma20", "z_cs_volume", "pct_ret_1d", "pct_mom_3m",
    )


# -- technical --------------------------------------------------------------------------------------------------------------

def true_range(high: Column, low: Column, close: Column) -> Column:
    """Largest of the three ranges; parts with a missing operand are skipped."""
    prev = F.lag(close, 1).over(win.series())
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def with_bands(df: DataFrame, price: str, n: int = 20, width: float = 2.0) -> DataFrame:
    """Add bb_upper, bb_mid and bb_lower."""
    kept = df.columns
    df = win.with_rolling(df, n, {"bb_mid": ("avg", price), "_std": ("std", price)})
    mid, std = F.col("bb_mid"), F.col("_std") * width
    return df.select(*kept, (mid + std).alias("bb_upper"), "bb_mid", (mid - std).alias("bb_lower"))


def with_ema_indicators(df: DataFrame, price: str, wilder_guard: bool, period: int = 14) -> DataFrame:
    """Add rsi_14, macd_line, macd_signal, macd_hist and atr_14 computed on ``price``."""
    kept = df.columns
    c = F.col(price)
    delta = c - F.lag(c, 1).over(win.series())
    df = df.withColumns({
        "_gain": F.greatest(delta, F.when(delta.isNotNull(), F.lit(0.0))),
        "_loss": F.greatest(-delta, F.when(delta.isNotNull(), F.lit(0.0))),
        "_tr": true_range(F.col("high"), F.col("low"), c),
    })
    df = win.with_ema(df, {
        "_gain": [("_up", "_gain", 1 / period), ("_dn", "_loss", 1 / period)],
        "_tr": [("_atr", "_tr", 1 / period)],
        price: [("_fast", price, 2 / 13), ("_slow", price, 2 / 27)],
    })
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    df = win.with_ema(df, {"macd_line": [("macd_signal", "macd_line", 2 / 10)]})
    rsi = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_up"), _nonzero(F.col("_dn"))))
    atr = F.try_divide(F.col("_atr"), c)
    if wilder_guard:
        seen = win.running()
        rsi = F.when(F.count("_gain").over(seen) >= period, rsi)
        atr = F.when(F.count("_tr").over(seen) >= period, atr)
    return df.withColumns({
        "rsi_14": rsi, "macd_hist": F.col("macd_line") - F.col("macd_signal"), "atr_14": atr,
    }).select(*kept, "rsi_14", "macd_line", "macd_signal", "macd_hist", "atr_14")


def technical(prices: DataFrame, market: str) -> DataFrame:
    o, close = win.series(), F.col("close")
    df = prices.select(
        "ticker", "date", "close", "high", "low", F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )
    df = df.withColumn("_ok", _enough(close, 21)).where("_ok").drop("_ok")
    df = with_ema_indicators(df, "close", wilder_guard=True)
    df = with_bands(df, "close")
    for n in (50, 200):
        df = win.with_rolling(df, n, {f"ma_{n}": ("avg", "close")})
    step = F.signum(F.coalesce(close - F.lag(close, 1).over(o), F.lit(0.0)))
    df = df.withColumn("_flow", step * F.col("volume"))
    spread = _nonzero(F.col("bb_upper") - F.col("bb_lower"))
    return df.select(
        "ticker", F.lit(market).alias("market"), "date", "rsi_14", "bb_upper", "bb_mid", "bb_lower",
        F.try_divide(close - F.col("bb_lower"), spread).alias("bb_pct_b"),
        F.try_divide(spread, F.col("bb_mid")).alias("bb_width"),
        "macd_line", "macd_signal", "macd_hist",
        F.col("bb_mid").alias("ma_20"), "ma_50", "ma_200",
        ((F.try_divide(close, F.col("ma_50")) - 1) * 100).alias("pct_vs_ma50"),
        ((F.try_divide(close, F.col("ma_200")) - 1) * 100).alias("pct_vs_ma200"),
        F.coalesce(F.col("ma_50") > F.col("ma_200"), F.lit(False)).alias("golden_cross"),
        "atr_14",
        F.sum("_flow").over(win.running()).alias("obv"),
    )


MODULES = {"returns": returns, "risk": risk, "momentum": momentum, "zscore": zscore, "technical": technical}
