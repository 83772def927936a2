"""Long-format feature store: technical features per symbol, macro features per series and across series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators.analytics import ANNUAL, with_bands, with_ema_indicators
from tidemark.operators.upsert import union_all
from tidemark.schemas import FEATURE_COLUMNS

TECHNICAL_SET = "technical_v1"
MACRO_SET = "macro_v1"

# Window label of every feature.
TECHNICAL_WINDOWS = {
    "returns_1d": "1d", "returns_5d": "5d", "returns_21d": "21d", "returns_63d": "63d", "returns_252d": "252d",
    "vol_21d": "21d", "vol_63d": "63d", "rsi_14": "14d", "macd_line": "12d/26d", "macd_signal": "9d",
    "macd_hist": "12d/26d/9d", "bb_upper": "20d", "bb_mid": "20d", "bb_lower": "20d", "bb_pct_b": "20d",
    "bb_width": "20d", "ma_20": "20d", "ma_50": "50d", "ma_200": "200d", "pct_vs_ma50": "50d", "pct_vs_ma200": "200d",
    "golden_cross": "50d/200d", "atr_14": "14d",
}
SERIES_WINDOWS = {"mom_1m": "1m", "mom_3m": "3m", "mom_12m": "12m", "zscore_1y": "252d", "zscore_3y": "756d"}
COMPOSITE_WINDOWS = {
    "t10y2y_spread": "10y-2y", "t10y3m_spread": "10y-3m", "t30y10y_spread": "30y-10y", "rate_regime": "252d",
    "inflation_regime": "252d",
}


def technical_features(bars: DataFrame) -> DataFrame:
    """Indicators on the adjusted close (ticker, date, high, low, adj_close); changes bridge missing closes."""
    o, c = win.series(), F.col("adj_close")
    df = bars.select("ticker", "date", c, "high", "low").withColumn(
        "_pad", F.last("adj_close", ignorenulls=True).over(win.running())
    )
    df = df.withColumn("_ret", win.change(F.col("_pad"), 1, o))
    df = with_ema_indicators(df, "adj_close", wilder_guard=False)
    df = with_bands(df, "adj_close").withColumn("ma_20", F.col("bb_mid"))
    for n in (50, 200):
        df = win.with_rolling(df, n, {f"ma_{n}": ("avg", "adj_close")})
    for n in (21, 63):
        df = win.with_rolling(df, n, {f"_s{n}": ("std", "_ret")}).withColumn(f"vol_{n}d", F.col(f"_s{n}") * ANNUAL)
    df = df.withColumns({f"returns_{k}d": win.change(F.col("_pad"), k, o) for k in (1, 5, 21, 63, 252)})
    spread = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({
        "bb_width": F.try_divide(spread, F.col("bb_mid")),
        "bb_pct_b": F.try_divide(c - F.col("bb_lower"), spread),
        "pct_vs_ma50": F.try_divide(c - F.col("ma_50"), F.col("ma_50")),
        "pct_vs_ma200": F.try_divide(c - F.col("ma_200"), F.col("ma_200")),
        "golden_cross": F.coalesce((F.col("ma_50") > F.col("ma_200")).cast("double"), F.lit(0.0)),
    }).select("ticker", "date", *TECHNICAL_WINDOWS)


def wide_to_long(wide: DataFrame, windows: dict[str, str], feature_set: str, asset_class: str, run_id: str,
                 key: str, date: str, source_ref: str = "", generated_at: dt.datetime | None = None) -> DataFrame:
    """One row per non-null feature value in the canonical layout."""
    label = F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])
    stamp = F.lit(generated_at).cast("timestamp") if generated_at else F.current_timestamp()
    return (
        wide.unpivot([key, date], list(windows), "feature_name", "feature_value")
        .where(F.col("feature_value").isNotNull())
        .select(
            F.col(date).alias("date"), F.lit(asset_class).alias("asset_class"), F.col(key).alias("symbol_or_series"),
            F.lit(feature_set).alias("feature_set"), "feature_name", "feature_value",
            label[F.col("feature_name")].alias("window"), F.lit(source_ref).alias("source_ref"),
            stamp.alias("generated_at_utc"), F.lit(run_id).alias("run_id"),
        )
        .select(*FEATURE_COLUMNS)
    )


# -- macro -----------------------------------------------------------------------------------------------------------

def macro_features(macro: DataFrame) -> DataFrame:
    """Differences and rolling z-scores per series; a series has one value per date."""
    o, v = win.series("series_id", order="observation_date"), F.col("value")
    df = macro.select(
        "series_id", "observation_date", "value", *[(v - F.lag(v, k).over(o)).alias(f"mom_{k}m") for k in (1, 3, 12)]
    )
    for n, need, out in ((252, 30, "zscore_1y"), (756, 63, "zscore_3y")):
        df = win.with_zscores(df, n, {"value": out}, ("series_id",), "observation_date", need)
    return df


def align_series(macro: DataFrame, roles: dict[str, str], base: str) -> DataFrame:
    """One column per role on the calendar of the base role. ``roles`` maps role names to series ids."""
    wanted = macro.where(F.col("series_id").isin(*roles.values()))
    wide = wanted.groupBy("observation_date").agg(
        F.max(F.col("series_id") == roles[base]).alias("_on"),
        *[F.max(F.when(F.col("series_id") == sid, F.col("value"))).alias(role) for role, sid in roles.items()],
    )
    return wide.where("_on").drop("_on")


def percentile_of_last(x: Column, n: int, order: str) -> Column:
    """Percentile rank of the current value among the last n rows, ties averaged; needs n/2 values in the frame.

    The frame is gathered as an array of at most n values; the table has one row per calendar date.
    """
    frame = F.collect_list(x).over(Window.orderBy(order).rowsBetween(-(n - 1), 0))
    below = F.size(F.filter(frame, lambda y: y < x))
    same = F.size(F.filter(frame, lambda y: y == x))
    return F.when(x.isNotNull() & (F.size(frame) >= n // 2), (below + (same + 1) / 2) / F.size(frame))


def macro_composite(macro: DataFrame, roles: dict[str, str], cpi: DataFrame | None = None) -> DataFrame:
    """Yield spreads and regimes per date of the 10-year yield. ``roles`` names DGS10 and, where present, DGS2,
    DGS3MO, DGS30 and DFF; ``cpi`` has (observation_date, value)."""
    df = align_series(macro, roles, "DGS10")
    if cpi is not None:
        level = cpi.groupBy("observation_date").agg(F.max("value").alias("CPI"))
        df = df.join(F.broadcast(level), "observation_date", "left")  # one row per date
    have = set(df.columns)
    day = Window.orderBy("observation_date")

    def spread(a: str, b: str) -> Column:
        return F.col(a) - F.col(b) if {a, b} <= have else F.lit(None).cast("double")

    df = df.withColumns({
        "t10y2y_spread": spread("DGS10", "DGS2"), "t10y3m_spread": spread("DGS10", "DGS3MO"),
        "t30y10y_spread": spread("DGS30", "DGS10"),
        "rate_regime": percentile_of_last(F.col("DFF"), 252, "observation_date") if "DFF" in have
        else F.lit(None).cast("double"),
    })
    if "CPI" in have:
        df = df.withColumn("_cpi", F.last("CPI", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("_yoy", win.change(F.col("_cpi"), 12, day))
        df = df.withColumn("inflation_regime", percentile_of_last(F.col("_yoy"), 252, "observation_date"))
    else:
        df = df.withColumn("inflation_regime", F.lit(None).cast("double"))
    return df.select("observation_date", *COMPOSITE_WINDOWS)


def composite_long(composite: DataFrame, run_id: str) -> DataFrame:
    rows = composite.withColumn("series_id", F.lit("COMPOSITE"))
    return wide_to_long(rows, COMPOSITE_WINDOWS, MACRO_SET, "macro", run_id, "series_id", "observation_date")


# -- as-of fill --------------------------------------------------------------------------------------------------------

def fill_on_calendar(calendar: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Value on each calendar date, the largest of several; gaps take the last value that fell on a calendar date."""
    once = series.groupBy("date").agg(F.max(value).alias(value))  # one row per date, so its broadcast is bounded
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = calendar.select("date").join(F.broadcast(once), "date", "left")
    return joined.select("date", F.last(value, ignorenulls=True).over(run).alias(value))


def asof_on_calendar(calendar: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Last value on or before each calendar date, whatever date it fell on."""
    both = union_all(
        series.select("date", value, F.lit(False).alias("_keep")),
        calendar.select("date", F.lit(True).alias("_keep")),
    ).groupBy("date").agg(F.max(value).alias(value), F.max("_keep").alias("_keep"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(run)).where("_keep").select("date", value)
