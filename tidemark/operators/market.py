"""Market summary: per-ticker metrics, resampling, rebased series, correlations, bar quality, chart indicators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators.analytics import mean_per_bar, true_range, with_bands
from tidemark.schemas import PRICE_COLUMNS

EPSILON = 2.220446049250313e-16  # fixed value: spacing of doubles at one


def ticker_metrics(prices: DataFrame) -> DataFrame:
    df = prices.where(F.col("close").isNotNull())
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    df = df.select(
        "ticker", "date", "close", F.row_number().over(newest).alias("rn"),
        win.change(F.col("close"), 1, win.series()).alias("ret"),
        F.year(F.max("date").over(Window.partitionBy("ticker"))).alias("last_year"),
    )

    def back(k: int):
        return F.max(F.when(F.col("rn") == k + 1, F.col("close")))

    year_start = F.min_by("close", F.when(F.year("date") == F.col("last_year"), F.col("date")))
    year = F.when(F.col("rn") <= 252, F.col("close"))
    spans = {"chg_1d_pct": 1, "ret_1m_pct": 21, "ret_3m_pct": 63, "ret_6m_pct": 126, "ret_1y_pct": 252}
    agg = df.groupBy("ticker").agg(
        back(0).alias("last"), *[back(k).alias(f"_{n}") for n, k in spans.items()], year_start.alias("_ytd_pct"),
        F.max(year).alias("hi_52w"), F.min(year).alias("lo_52w"),
        (F.stddev_samp("ret") * math.sqrt(252) * 100).alias("vol_ann_pct"),
    )
    pct = {n: ((F.try_divide(F.col("last"), F.col(f"_{n}")) - 1) * 100).alias(n) for n in [*spans, "ytd_pct"]}
    return agg.select(
        "ticker", "last", pct["chg_1d_pct"], pct["ytd_pct"], pct["ret_1m_pct"], pct["ret_3m_pct"],
        pct["ret_6m_pct"], pct["ret_1y_pct"], "hi_52w", "lo_52w", "vol_ann_pct",
    )


def range_position(metrics: DataFrame) -> DataFrame:
    """Place of the last price inside the 52-week range, 0 to 100."""
    lo, hi = F.col("lo_52w"), F.col("hi_52w")
    place = F.try_divide(F.col("last") - lo, hi - lo) * 100
    return metrics.withColumn(
        "range_pct", F.when((lo != 0) & (hi > lo), F.greatest(F.lit(0.0), F.least(F.lit(100.0), place))).otherwise(0.0)
    )


def movers(metrics: DataFrame, k: int = 3, by: str = "chg_1d_pct") -> DataFrame:
    """The k largest gains and the k largest losses; rows without a value are left out."""
    valued = metrics.where(F.col(by).isNotNull())
    up = valued.orderBy(F.col(by).desc(), "ticker").limit(k).withColumn("side", F.lit("gainer"))
    down = valued.orderBy(F.col(by).asc(), "ticker").limit(k).withColumn("side", F.lit("loser"))
    return up.unionByName(down)


def resample_bars(prices: DataFrame, interval: str) -> DataFrame:
    """Weekly (Friday label) or monthly (month-end label) bars; only periods that hold bars."""
    if interval == "1d":
        return prices
    label = F.next_day(F.date_sub("date", 1), "FRI") if interval == "1wk" else F.last_day("date")

    def first(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)

    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)

    return prices.groupBy("ticker", label.alias("period")).agg(
        first("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close"), last("adj_close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("period", "date")


def rebase_100(prices: DataFrame) -> DataFrame:
    bars = mean_per_bar(prices, "close").where(F.col("close").isNotNull())
    first = F.first("close").over(win.series())
    return bars.select("ticker", "date", (F.try_divide(F.col("close"), first) * 100).alias("index"))


@np.errstate(all="ignore")
def _gram(x: np.ndarray) -> np.ndarray:
    """Pairwise counts, means, squared deviations and co-deviations (4, k, k) of the rows of ``x``; NaN is missing.

    Entry (i, j) of the means and squared deviations is that of column i over the rows that have both. Values are centred
    first, by the first one and by the mean of what it leaves, so a constant column has exactly no deviation.
    """
    seen = ~np.isnan(x)
    first = np.where(seen.any(axis=0), x[seen.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    x = np.where(seen, x - first, 0.0)
    shift = x.sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
    x = np.where(seen, x - shift, 0.0)
    has = seen.astype(np.float64)
    n, total = has.T @ has, x.T @ has
    size = np.maximum(n, 1)
    return np.stack([n, (first + shift)[:, None] + total / size, (x * x).T @ has - total * total / size, x.T @ x - total * total.T / size])


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Two such blocks as one."""
    if a is None:
        return b
    n = a[0] + b[0]
    size = np.maximum(n, 1)
    away = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    weight = a[0] * b[0] / size
    mean = np.where(a[0] > 0, np.where(b[0] > 0, a[1] + away * b[0] / size, a[1]), b[1])
    return np.stack([n, mean, a[2] + b[2] + away * away * weight, a[3] + b[3] + away * away.T * weight])


def _packed(blocks: Iterable[np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    state = None
    for block in blocks:
        state = _merged(state, block)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["part", "state"])


MERGERS = 32  # blocks that reach the driver, at most


def pairwise_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col1, col2, corr) for every pair of the given columns, over the rows where both hold a value.

    One pass: each task folds its rows into one centred block of k x k numbers by matrix products, blocks merge in groups,
    and at most ``MERGERS`` of them reach the driver; no row is repeated per pair. Null without spread; NaN where infinite
    values leave none.
    """
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double")
    k = len(columns)
    values = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(columns)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches)
        yield from _packed((_gram(x) for x in rows if len(x)), TaskContext.get().partitionId() % MERGERS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed((np.frombuffer(s, np.float64).reshape(4, k, k) for b in batches for s in b.column("state").to_pylist()), 0)

    schema = "part int, state binary"
    states = values.mapInArrow(fold, schema).repartition(MERGERS, "part").mapInArrow(merge, schema).collect()
    with np.errstate(all="ignore"):
        state = None
        for r in states:
            state = _merged(state, np.frombuffer(r["state"], np.float64).reshape(4, k, k))
        out = []
        for i, j in pairs if state is not None else []:
            spread = float(np.sqrt(state[2, i, j]) * np.sqrt(state[2, j, i])) if state[0, i, j] else 0.0
            out.append((columns[i], columns[j], None if spread == 0 else float(state[3, i, j]) / spread))
    return df.sparkSession.createDataFrame(out, "col1 string, col2 string, corr double")


def symmetric(pairs: DataFrame, columns: list[str]) -> DataFrame:
    flipped = pairs.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "corr")
    ones = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col1 string, col2 string, corr double")
    return pairs.unionByName(flipped).unionByName(ones)


def corr_matrix(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """Correlations of the calendar returns of a chosen, short list of tickers.

    One column per chosen ticker and one row per date, so no pair of rows is ever formed.
    """
    bars = mean_per_bar(prices.where(F.col("ticker").isin(*tickers)), "close")
    rets = win.with_calendar_index(bars, prices).select(
        "date", "ticker", win.calendar_change(F.col("close"), 1, "ticker").alias("r")
    )
    wide = rets.groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, F.col("r"))).alias(t) for t in tickers])
    return symmetric(pairwise_corr(wide, tickers), tickers)


def bar_quality(curated: DataFrame) -> DataFrame:
    """Rows, missing values and dates per symbol. Dated rows that repeat a date are duplicates; undated ones are not."""
    values = [c for c in PRICE_COLUMNS if c != "volume"]
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in values), F.lit(0))
    df = curated.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(missing).alias("_missing"),
        F.countDistinct("trade_date").alias("_days"), F.count("trade_date").alias("_dated"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
    )
    share = F.col("_missing") / (F.col("rows") * len(values))
    return df.withColumn("duplicate_rows", F.col("_dated") - F.col("_days")).select(
        "symbol", "rows", F.round(share, 4).alias("missing_pct"), "duplicate_rows", "first_date", "last_date",
        ((share < 0.05) & (F.col("duplicate_rows") == 0)).alias("passed"),
    )


def series_quality(macro: DataFrame) -> DataFrame:
    """The same per series."""
    df = macro.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("_missing"),
        F.countDistinct("observation_date").alias("_days"), F.count("observation_date").alias("_dated"),
        F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"),
    )
    share = F.col("_missing") / F.col("rows")
    return df.withColumn("duplicate_rows", F.col("_dated") - F.col("_days")).select(
        "series_id", "rows", F.round(share, 4).alias("missing_pct"), "duplicate_rows", "first_date", "last_date",
        ((share < 0.1) & (F.col("duplicate_rows") == 0)).alias("passed"),
    )


def rsi_sma(prices: DataFrame, period: int = 14) -> DataFrame:
    """RSI over plain means; a zero loss counts as machine epsilon."""
    o = win.series()
    delta = F.col("close") - F.lag("close", 1).over(o)
    df = prices.select(
        "ticker", "date", F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))).alias("gain"),
        F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))).alias("loss"),
    )
    df = win.with_rolling(df, period, {"mg": ("avg", "gain"), "ml": ("avg", "loss")})
    safe = F.when(F.col("ml") == 0, EPSILON).otherwise(F.col("ml"))
    return df.select("ticker", "date", (100 - 100 / (1 + F.col("mg") / safe)).alias("rsi"))


def chart_indicators(prices: DataFrame) -> DataFrame:
    """Bands, MACD and the plain 14-bar mean of the true range, as drawn on the price chart."""
    df = with_bands(prices.select("ticker", "date", "high", "low", "close"), "close")
    df = df.withColumn("tr", true_range(F.col("high"), F.col("low"), F.col("close")))
    df = win.with_rolling(df, 14, {"atr": ("avg", "tr")})
    df = win.with_ema(df, {"close": [("_fast", "close", 2 / 13), ("_slow", "close", 2 / 27)]})
    df = win.with_ema(df.withColumn("macd", F.col("_fast") - F.col("_slow")), {"macd": [("signal", "macd", 2 / 10)]})
    return df.select(
        "ticker", "date", "bb_upper", "bb_mid", "bb_lower", "macd", "signal",
        (F.col("macd") - F.col("signal")).alias("histogram"), "atr",
    )


def pivot_prices(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """Date x ticker closes for a chosen list of tickers, for export."""
    return prices.groupBy("date").pivot("ticker", tickers).agg(F.avg("close"))
