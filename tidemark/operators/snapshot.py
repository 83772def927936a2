"""Latest metrics per ticker, screening and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import SNAPSHOT_COLUMNS


def latest_rows(df: DataFrame) -> DataFrame:
    """Rows at the newest date of the table; the one-row maximum is broadcast."""
    newest = df.agg(F.max("date").alias("_max"))
    return df.join(F.broadcast(newest), F.col("date") == F.col("_max")).drop("_max")


def last_price(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.max_by("close", "date").alias("last_price"))


def snapshot(tables: dict[str, DataFrame], prices: DataFrame | None = None, cap: str | None = None) -> DataFrame:
    """One row per ticker that has a bar on the newest date of the base module, with every module's newest metrics.

    Each module is cut to its own newest date before it is joined; modules that are missing are skipped.
    """
    order = [m for m in SNAPSHOT_COLUMNS if m in tables]
    base, *others = order
    keep = ["ticker", F.col("date").alias("as_of")] if base == "returns" else ["ticker"]
    df = latest_rows(tables[base]).select(*keep, *SNAPSHOT_COLUMNS[base])
    for m in others:
        df = df.join(latest_rows(tables[m]).select("ticker", *SNAPSHOT_COLUMNS[m]), "ticker", "left")
    if prices is not None:
        df = df.join(last_price(prices), "ticker", "left")
        if cap:
            df = cap_filter(df, prices, cap)
    return df


def cap_filter(df: DataFrame, prices: DataFrame, cap: str) -> DataFrame:
    members = prices.where(F.upper("cap_category") == cap.upper()).select("ticker").distinct()
    return df.join(members, "ticker", "left_semi")


# Screener presets as (column, comparison, bound, value that stands for null).
PRESETS: dict[str, list[tuple[str, str, float, float]]] = {
    "Momentum Leaders": [("mom_3m", ">=", 0.05, -999), ("rsi_14", "<=", 70, 999)],
    "Oversold Bounce": [("rsi_14", "<=", 35, 999), ("mom_1m", ">=", -0.10, -999)],
    "High Sharpe": [("sharpe_252d", ">=", 1.0, -999), ("vol_252d", "<=", 0.30, 999)],
    "Near 52w High": [("hi_52w_pct", ">=", -3.0, -999)],
    "Strong Relative RS": [("rs_vs_bench", ">=", 1.05, -999)],
    "Low Volatility": [("vol_252d", "<=", 0.18, 999)],
    "Deep Value": [("pct_vs_ma200", "<=", -10.0, 999)],
    "Golden Cross": [("golden_cross", "true", 0, 0)],
}

# Manual thresholds as (argument, column, scale, comparison, default, value that stands for null).
MANUAL: list[tuple[str, str, float, str, float, float]] = [
    ("ret_1d_min", "ret_1d", 100, ">=", -100.0, -999),
    ("ret_5d_min", "ret_5d", 100, ">=", -100.0, -999),
    ("ret_21d_min", "ret_21d", 100, ">=", -100.0, -999),
    ("ret_63d_min", "ret_63d", 100, ">=", -100.0, -999),
    ("mom_1m_min", "mom_1m", 100, ">=", -100.0, -999),
    ("mom_3m_min", "mom_3m", 100, ">=", -100.0, -999),
    ("mom_12m_min", "mom_12m", 100, ">=", -100.0, -999),
    ("rs_min", "rs_vs_bench", 1, ">=", 0.0, -999),
    ("vol_max", "vol_252d", 100, "<=", 200.0, 999),
    ("sharpe_min", "sharpe_252d", 1, ">=", -10.0, -999),
    ("max_dd_min", "max_dd_252d", 100, ">=", -100.0, -999),
    ("beta_max", "beta_252d", 1, "<=", 5.0, 999),
    ("rsi_min", "rsi_14", 1, ">=", 0.0, 0),
    ("rsi_max", "rsi_14", 1, "<=", 100.0, 100),
    ("pct_vs_ma50_min", "pct_vs_ma50", 1, ">=", -100.0, -999),
    ("pct_vs_ma200_min", "pct_vs_ma200", 1, ">=", -100.0, -999),
]

# Displayed columns as (column, heading, scale, digits; 0 digits leaves the value alone).
DISPLAY: list[tuple[str, str, float, int]] = [
    ("ticker", "Ticker", 1, 0), ("last_price", "Price", 1, 2), ("ret_1d", "1d %", 100, 2), ("ret_5d", "5d %", 100, 2),
    ("ret_21d", "21d %", 100, 2), ("mom_3m", "3m Mom%", 100, 2), ("mom_12m", "12m Mom%", 100, 2),
    ("rsi_14", "RSI", 1, 3), ("vol_252d", "Ann Vol%", 100, 2), ("sharpe_252d", "Sharpe", 1, 3),
    ("max_dd_252d", "MaxDD%", 100, 2), ("beta_252d", "Beta", 1, 3), ("rs_vs_bench", "RS Bench", 1, 3),
    ("rank_universe", "Universe Rank", 1, 0), ("hi_52w_pct", "52w Hi%", 1, 2), ("pct_vs_ma50", "vs MA50%", 1, 2),
    ("pct_vs_ma200", "vs MA200%", 1, 2), ("golden_cross", "GldCross", 1, 0),
]
COMPARE: list[tuple[str, str, float, int]] = [
    ("last_price", "Price", 1, 2), ("ret_1d", "1d Ret%", 100, 2), ("ret_5d", "5d Ret%", 100, 2),
    ("mom_3m", "3m Mom%", 100, 2), ("mom_12m", "12m Mom%", 100, 2), ("rsi_14", "RSI", 1, 3),
    ("vol_252d", "Ann Vol%", 100, 2), ("sharpe_252d", "Sharpe", 1, 3), ("sortino_252d", "Sortino", 1, 3),
    ("max_dd_252d", "MaxDD%", 100, 2), ("beta_252d", "Beta", 1, 3), ("alpha_252d", "Alpha%", 100, 2),
    ("rs_vs_bench", "RS Bench", 1, 3), ("rank_universe", "Rank", 1, 0), ("hi_52w_pct", "52w Hi%", 1, 3),
    ("pct_vs_ma50", "vs MA50%", 1, 3), ("pct_vs_ma200", "vs MA200%", 1, 3), ("bb_pct_b", "BB %B", 1, 3),
    ("macd_hist", "MACD Hist", 1, 3),
]
# Which compared metrics are better when high, and when low.
HIGH_IS_GOOD = ["ret_1d", "ret_5d", "mom_3m", "mom_12m", "sharpe_252d", "sortino_252d", "rs_vs_bench"]
LOW_IS_GOOD = ["vol_252d", "max_dd_252d"]

# Radar axes as (axis, column, value for null, offset, span); the axis is (value + offset) / span in 0..1.
RADAR: list[tuple[str, str, float, float, float]] = [
    ("sharpe", "sharpe_252d", 0.0, 1.0, 4.0), ("vol_inv", "vol_252d", 0.0, -0.6, -0.6),
    ("mom_3m", "mom_3m", 0.0, 0.2, 0.5), ("rel_strength", "rs_vs_bench", 1.0, -0.5, 1.0),
    ("drawdown_inv", "max_dd_252d", 0.0, 0.5, 0.5),
]


def _test(value: Column, how: str, bound: float) -> Column:
    return value >= bound if how == ">=" else value <= bound


def preset_test(preset: str) -> Column:
    out = F.lit(True)
    for column, how, bound, absent in PRESETS[preset]:
        if how == "true":
            out = out & F.coalesce(F.col(column), F.lit(False))
        else:
            out = out & _test(F.coalesce(F.col(column), F.lit(float(absent))), how, bound)
    return out


def screen_preset(df: DataFrame, preset: str) -> DataFrame:
    return df.where(preset_test(preset))


def screen_manual(df: DataFrame, **bounds: float) -> DataFrame:
    """Sixteen thresholds that must all hold; percent bounds are given in percent."""
    for arg, column, scale, how, default, absent in MANUAL:
        value = F.coalesce(F.col(column), F.lit(float(absent))) * scale
        df = df.where(_test(value, how, bounds.get(arg, default)))
    return df


def _shown(df: DataFrame, columns: list[tuple[str, str, float, int]]) -> list[Column]:
    return [
        (F.round(F.col(c) * scale, digits) if digits else F.col(c)).alias(heading)
        for c, heading, scale, digits in columns if c in df.columns
    ]


def screener_display(df: DataFrame, sort_by: str = "3m Mom%", ascending: bool = False) -> DataFrame:
    """Displayed columns, percentages scaled and rounded, sorted with missing values last."""
    shown = df.select(*_shown(df, DISPLAY))
    by = F.col(f"`{sort_by if sort_by in shown.columns else 'Ticker'}`")
    return shown.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last())


def compare_table(df: DataFrame, tickers: list[str]) -> DataFrame:
    chosen = df.where(F.col("ticker").isin(*tickers))
    return chosen.select(F.col("ticker").alias("Ticker"), *_shown(chosen, COMPARE))


def compare_scores(df: DataFrame, tickers: list[str]) -> DataFrame:
    """Min-max place of each metric within the chosen, short list of tickers."""
    chosen = df.where(F.col("ticker").isin(*tickers))
    names = [*HIGH_IS_GOOD, *LOW_IS_GOOD]
    ends = chosen.agg(*[F.min(c).alias(f"_lo_{c}") for c in names], *[F.max(c).alias(f"_hi_{c}") for c in names])
    joined = chosen.withColumn("_k", F.lit(1)).join(F.broadcast(ends.withColumn("_k", F.lit(1))), "_k")
    return joined.select("ticker", *[
        F.coalesce((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-9), F.lit(0.0)).alias(c)
        for c in names
    ])


def radar_scores(df: DataFrame, tickers: list[str]) -> DataFrame:
    def clip(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    axes = [
        clip((F.coalesce(F.col(c), F.lit(absent)) + offset) / span).alias(axis) for axis, c, absent, offset, span in RADAR
    ]
    rsi = clip(1 - F.abs(F.coalesce("rsi_14", F.lit(50.0)) - 50) / 50).alias("rsi_norm")
    return df.where(F.col("ticker").isin(*tickers)).select("ticker", *axes, rsi)
