"""Column contracts of the market, macro and feature tables."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]

MARKET_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
    + [T.StructField("cap_category", T.StringType())]
)

CURATED_COLUMNS = [
    "trade_date", "symbol", "asset_class", *PRICE_COLUMNS,
    "currency", "exchange", "source", "ingested_at_utc", "run_id",
]

MACRO_COLUMNS = [
    "series_id", "observation_date", "value", "realtime_start", "realtime_end", "frequency", "units",
    "seasonal_adjust", "title", "source", "ingested_at_utc", "run_id",
]

FEATURE_COLUMNS = [
    "date", "asset_class", "symbol_or_series", "feature_set", "feature_name", "feature_value", "window",
    "source_ref", "generated_at_utc", "run_id",
]

RAW_BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("cap", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("records", T.ArrayType(T.StructType(
        [T.StructField("_date", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
    ))),
])

RAW_MACRO_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("asset_class", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("meta", T.StructType([
        T.StructField(c, T.StringType())
        for c in ("frequency_short", "frequency", "units", "seasonal_adjustment_short", "title")
    ])),
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField(c, T.StringType()) for c in ("date", "value", "realtime_start", "realtime_end")
    ]))),
])

# Fixed column lists of the snapshot and of the metric history, module by module.
SNAPSHOT_COLUMNS = {
    "returns": ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d"],
    "risk": ["vol_21d", "vol_252d", "sharpe_63d", "sharpe_252d", "sortino_252d", "max_dd_252d", "beta_252d",
             "alpha_252d", "var_95_21d", "cvar_95_21d"],
    "momentum": ["mom_1m", "mom_3m", "mom_6m", "mom_12m", "mom_12m_skip1m", "hi_52w_pct", "lo_52w_pct",
                 "rs_vs_bench", "rank_universe"],
    "technical": ["rsi_14", "bb_pct_b", "bb_width", "macd_hist", "ma_50", "ma_200", "pct_vs_ma50", "pct_vs_ma200",
                  "golden_cross", "atr_14"],
    "zscore": ["z_price_21d", "z_price_63d", "z_ret_21d", "z_cs_ret_1d", "pct_ret_1d", "pct_mom_3m"],
}
HISTORY_COLUMNS = {
    "returns": ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_126d", "ret_252d"],
    "risk": ["vol_21d", "vol_63d", "vol_252d", "sharpe_63d", "sharpe_252d", "sortino_252d", "max_dd_252d",
             "beta_252d", "alpha_252d"],
    "momentum": ["mom_1m", "mom_3m", "mom_6m", "mom_12m", "hi_52w_pct", "lo_52w_pct", "rs_vs_bench"],
    "zscore": ["z_price_21d", "z_price_63d", "z_ret_21d", "z_cs_ret_1d", "pct_ret_1d", "pct_mom_3m"],
    "technical": ["rsi_14", "bb_upper", "bb_mid", "bb_lower", "bb_pct_b", "bb_width", "macd_line", "macd_signal",
                  "macd_hist", "ma_20", "ma_50", "ma_200", "pct_vs_ma50", "pct_vs_ma200", "golden_cross"],
}
