"""Queries over the five metric modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators import analytics as an
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import modules, r, statement
from tidemark.sources import tables as src

MARKET = "US_EQ"
_M = modules("bars")
_D = modules("dense")
_T = modules("bars", "Brand#1")


def _pick(name: str, module: str, columns: list[str], exact: list[str] | None = None, **kw) -> None:
    """Register the chosen metrics of one module, over every bar."""
    exact = exact or []
    dense = module == "zscore"
    block = (_D if dense else _T if kw.get("bench_ticker") else _M)[module]
    doubles = [c for c in columns if c not in exact]
    shown = ", ".join(["ticker", "date", *([r(*doubles)] if doubles else []), *exact])
    sql = statement(f"SELECT {shown} FROM {block}", block)

    def run(spark, sf_dir):
        prices = (src.dense_bars if dense else src.bars)(spark, sf_dir)
        if module in ("risk", "momentum", "zscore"):
            prices = src.stored(prices)
        return rounded(an.MODULES[module](prices, MARKET, **kw).select("ticker", "date", *columns))

    query(name, sql)(run)


_pick("w01_returns", "returns", ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d"])
_pick("w02_log_return", "returns", ["log_ret_1d"])
_pick("w03_volatility", "risk", ["vol_21d", "vol_63d", "vol_252d"])
_pick("w04_sharpe", "risk", ["sharpe_63d", "sharpe_252d"])
_pick("w05_sortino", "risk", ["sortino_252d"])
_pick("w06_max_drawdown", "risk", ["max_dd_252d"])
_pick("w07_beta_alpha", "risk", ["beta_252d", "alpha_252d"])
_pick("w07_beta_alpha_one_ticker", "risk", ["beta_252d", "alpha_252d"], bench_ticker="Brand#1")
_pick("w08_value_at_risk", "risk", ["var_95_21d", "cvar_95_21d"])
_pick("w09_momentum", "momentum", ["mom_1m", "mom_3m", "mom_6m", "mom_12m"])
_pick("w10_momentum_skip_month", "momentum", ["mom_12m_skip1m"])
_pick("w11_rate_of_change", "momentum", ["roc_20d", "roc_60d"])
_pick("w12_distance_52w", "momentum", ["hi_52w_pct", "lo_52w_pct"])
_pick("w13_relative_strength", "momentum", ["rs_vs_bench"])
_pick("w13_relative_strength_one_ticker", "momentum", ["rs_vs_bench"], bench_ticker="Brand#1")
_pick("w14_rank_universe", "momentum", ["mom_12m", "rank_universe"], ["rank_universe"])
_pick("w15_z_series", "zscore", ["z_price_21d", "z_price_63d", "z_volume_21d", "z_ret_21d"])
_pick("w16_z_cross_return", "zscore", ["z_cs_ret_1d"])
_pick("w17_z_cross_ma20", "zscore", ["z_cs_price_vs_ma20"])
_pick("w18_z_cross_volume", "zscore", ["z_cs_volume"])
_pick("w19_percentile_rank", "zscore", ["pct_ret_1d", "pct_mom_3m"])
_pick("w20_rsi", "technical", ["rsi_14"])
_pick("w21_bollinger", "technical", ["bb_upper", "bb_mid", "bb_lower", "bb_pct_b", "bb_width"])
_pick("w22_macd", "technical", ["macd_line", "macd_signal", "macd_hist"])
_pick("w23_moving_averages", "technical", ["ma_20", "ma_50", "ma_200"])
_pick("w24_distance_ma", "technical", ["pct_vs_ma50", "pct_vs_ma200"])
_pick("w25_golden_cross", "technical", ["golden_cross"], ["golden_cross"])
_pick("w26_atr", "technical", ["atr_14"])
_pick("w27_obv", "technical", ["obv"])


@query("a37_bench_mean_return", statement(f"SELECT date, {r('b')} FROM bars_m_bret", "bars_m_bret"))
def _bench_return(spark, sf_dir):
    return rounded(an.mean_return_benchmark(src.stored(src.bars(spark, sf_dir))).withColumnRenamed("bench_ret", "b"))


@query("a38_bench_mean_price", statement(f"SELECT date, {r('px', 'chg')} FROM bars_m_bpx", "bars_m_bpx"))
def _bench_price(spark, sf_dir):
    df = an.mean_price_benchmark(src.stored(src.bars(spark, sf_dir)), 252)
    return rounded(df.select("date", F.col("bench_price").alias("px"), F.col("bench_change").alias("chg")))


@query("j05_bench_align", statement(
    f"SELECT ticker, x.date, {r('ret', 'b')} FROM bars_m_ret x LEFT JOIN bars_m_bret USING (date)",
    "bars_m_ret", "bars_m_bret"))
def _bench_align(spark, sf_dir):
    prices = src.stored(src.bars(spark, sf_dir))
    rets = prices.select("ticker", "date", win.change(F.col("close"), 1, win.series()).alias("ret"))
    bench = an.mean_return_benchmark(prices).withColumnRenamed("bench_ret", "b")
    return rounded(an.align_benchmark(rets, bench).select("ticker", "date", "ret", "b"))


@query("j06_cross_section_back", statement(
    f"SELECT ticker, date, {r('z_price_21d', 'z_cs_ret_1d', 'pct_ret_1d')} FROM dense_m_zscore", "dense_m_zscore"))
def _cross_back(spark, sf_dir):
    df = an.zscore(src.stored(src.dense_bars(spark, sf_dir)), MARKET)
    return rounded(df.select("ticker", "date", "z_price_21d", "z_cs_ret_1d", "pct_ret_1d"))


@query("a41_dedupe_mean", f"""SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date,
  round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS close, round(avg(l_quantity) + 1e-9, 6) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _dedupe_mean(spark, sf_dir):
    part = src.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("ticker"))
    rows = src.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "ticker", F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"))
    return rounded(an.mean_per_bar(rows, "close", "volume").select("ticker", "date", "close", "volume"))
