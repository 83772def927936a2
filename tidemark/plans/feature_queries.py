"""Queries over the feature store and macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import _bands, block, changed, ema_blocks, r, rolled, statement
from tidemark.session import new_path
from tidemark.sources import sinks
from tidemark.sources import tables as src

_PADDED = [f"returns_{k}d" for k in (1, 5, 21, 63, 252)] + ["vol_21d", "vol_63d"]
_SMOOTH = ["rsi_14", "macd_line", "macd_signal", "macd_hist", "bb_upper", "bb_mid", "bb_lower", "bb_pct_b", "bb_width",
           "ma_20", "ma_50", "ma_200", "atr_14"]
_RATIO = ["pct_vs_ma50", "pct_vs_ma200", "golden_cross"]


def _feature_blocks(p: str, src_block: str) -> str:
    """Blocks of technical_v1 over a bars block; gives the name of the wide one."""
    ema = ema_blocks(p, src_block, "adj_close")
    up, mid, low = _bands("adj_close")
    rets = ", ".join(f"{changed('pad', k)} AS returns_{k}d" for k in (1, 5, 21, 63, 252))
    vols = ", ".join(f"{rolled('stddev_samp', 'returns_1d', n)} * sqrt(252) AS vol_{n}d" for n in (21, 63))
    block(f"{p}_ret", [src_block], f"""SELECT ticker, date, {rets} FROM (SELECT ticker, date,
      last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS pad FROM {src_block})""")
    block(f"{p}_wide", [src_block, ema, f"{p}_ret"], f"""SELECT ticker, date, {', '.join(_PADDED)}, rsi AS rsi_14, macd_line,
      macd_signal, macd_hist, bb_upper, bb_mid, bb_lower, (c - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct_b,
      (bb_upper - bb_lower) / nullif(bb_mid, 0) AS bb_width, bb_mid AS ma_20, ma_50, ma_200, atr AS atr_14,
      (c - ma_50) / nullif(ma_50, 0) AS pct_vs_ma50, (c - ma_200) / nullif(ma_200, 0) AS pct_vs_ma200,
      CASE WHEN ma_50 > ma_200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS golden_cross
      FROM (SELECT ticker, date, adj_close AS c, {up} AS bb_upper, {mid} AS bb_mid, {low} AS bb_lower,
      {rolled('avg', 'adj_close', 50)} AS ma_50, {rolled('avg', 'adj_close', 200)} AS ma_200 FROM {src_block})
      JOIN {ema} USING (ticker, date) JOIN (SELECT *, {vols} FROM {p}_ret) USING (ticker, date)""")
    return f"{p}_wide"


_FB = _feature_blocks("bars_f", "bars")
_FW = _feature_blocks("weekly_f", "weekly")
block("gappy", ["bars"], "SELECT * REPLACE (CASE WHEN volume % 11 <> 3 THEN adj_close END AS adj_close) FROM bars")
_FG = _feature_blocks("gappy_f", "gappy")


@query("w28_feature_returns", statement(f"""SELECT ticker, date, {r(*_PADDED)} FROM (SELECT *, {', '.join(
    f"{rolled('stddev_samp', 'returns_1d', n)} * sqrt(252) AS vol_{n}d" for n in (21, 63))} FROM gappy_f_ret)""",
    "gappy_f_ret"))
def _feature_returns(spark, sf_dir):
    gappy = src.bars(spark, sf_dir).withColumn("adj_close", F.when(F.col("volume") % 11 != 3, F.col("adj_close")))
    return rounded(ft.technical_features(gappy).select("ticker", "date", *_PADDED))


@query("w29_feature_smoothed", statement(f"SELECT ticker, date, {r(*_SMOOTH)} FROM {_FB}", _FB))
def _feature_smooth(spark, sf_dir):
    return rounded(ft.technical_features(src.bars(spark, sf_dir)).select("ticker", "date", *_SMOOTH))


@query("w30_feature_ratios", statement(f"SELECT ticker, date, {r(*_RATIO)} FROM {_FB}", _FB))
def _feature_ratio(spark, sf_dir):
    return rounded(ft.technical_features(src.bars(spark, sf_dir)).select("ticker", "date", *_RATIO))


def _long_sql(wide: str, windows: dict[str, str], key: str, date: str, asset: str, feature_set: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {date} AS date, '{asset}' AS asset_class, {key} AS symbol_or_series, '{feature_set}' AS feature_set, "
        f"'{f}' AS feature_name, round({f} + 1e-9, 6) + 0.0 AS feature_value, '{w}' AS \"window\", '' AS source_ref, "
        f"'run-1' AS run_id FROM {wide} WHERE {f} IS NOT NULL" for f, w in windows.items())


_TECH_LONG = statement(_long_sql(_FW, ft.TECHNICAL_WINDOWS, "ticker", "date", "equities", "technical_v1"), _FW)


def _technical_long(spark, sf_dir):
    wide = ft.technical_features(src.weekly_bars(spark, sf_dir))
    return ft.wide_to_long(wide, ft.TECHNICAL_WINDOWS, ft.TECHNICAL_SET, "equities", "run-1", "ticker", "date")


@query("r01_wide_to_long", _TECH_LONG)
def _wide_to_long(spark, sf_dir):
    return rounded(_technical_long(spark, sf_dir).drop("generated_at_utc"))


@query("s08_write_features", _TECH_LONG)
def _write_features(spark, sf_dir):
    path = new_path(spark, "features")
    rows = src.stored(_technical_long(spark, sf_dir), "features")
    half = F.crc32(F.col("symbol_or_series").cast("binary")) % 2
    for part in (0, 1, 1):  # other symbols of a month stay, and a repeated write changes nothing
        sinks.write_features(rows.where(half == part), path)
    return rounded(sinks.read_features(spark, path).drop("generated_at_utc"))


_MD = [f"mom_{k}m" for k in (1, 3, 12)]
_MO = dict(part="series_id", order="observation_date")
_LAG = "lag(value, {0}) OVER (PARTITION BY series_id ORDER BY observation_date)"


def _mz(n: int, need: int) -> str:
    mean, std = rolled("avg", "value", n, need, **_MO), rolled("stddev_samp", "value", n, need, **_MO)
    return f"(value - {mean}) / nullif({std}, 0)"


block("macro_wide", ["macro"], f"""SELECT series_id, observation_date, {', '.join(
    f"value - {_LAG.format(k)} AS mom_{k}m" for k in (1, 3, 12))}, {_mz(252, 30)} AS zscore_1y, {_mz(756, 63)} AS zscore_3y
  FROM macro""")


@query("w34_macro_changes", statement(f"SELECT series_id, observation_date, {r(*_MD)} FROM macro_wide", "macro_wide"))
def _macro_mom(spark, sf_dir):
    return rounded(ft.macro_features(src.macro_series(spark, sf_dir)).select("series_id", "observation_date", *_MD))


@query("w35_macro_zscores", statement(
    f"SELECT series_id, observation_date, {r('zscore_1y', 'zscore_3y')} FROM macro_wide", "macro_wide"))
def _macro_z(spark, sf_dir):
    df = ft.macro_features(src.macro_series(spark, sf_dir))
    return rounded(df.select("series_id", "observation_date", "zscore_1y", "zscore_3y"))


ROLES = {"DGS10": "1-URGENT", "DGS2": "2-HIGH", "DGS3MO": "3-MEDIUM", "DGS30": "4-NOT SPECIFIED", "DFF": "5-LOW"}
block("aligned", ["macro"], "SELECT observation_date, " + ", ".join(
    f"max(value) FILTER (series_id = '{s}') AS {k}" for k, s in ROLES.items())
    + " FROM macro GROUP BY observation_date HAVING bool_or(series_id = '1-URGENT')")
block("aligned_n", ["aligned", "monthly"], """SELECT *, CPI_fill / nullif(lag(CPI_fill, 12) OVER (ORDER BY observation_date), 0)
  - 1 AS yoy FROM (SELECT a.*, last_value(m.value IGNORE NULLS) OVER (ORDER BY observation_date) AS CPI_fill,
  row_number() OVER (ORDER BY observation_date) AS n FROM aligned a LEFT JOIN monthly m USING (observation_date))""")


def _regime(x: str) -> str:
    return f"""SELECT a.observation_date, CASE WHEN count(b.{x}) >= 126 THEN (count(*) FILTER (b.{x} < a.{x})
      + (count(*) FILTER (b.{x} = a.{x}) + 1) / 2.0::DOUBLE) / count(b.{x}) END AS v FROM aligned_n a JOIN aligned_n b
      ON b.n BETWEEN a.n - 251 AND a.n WHERE a.{x} IS NOT NULL GROUP BY a.observation_date, a.{x}"""


block("composite", ["aligned_n"], f"""SELECT observation_date, DGS10 - DGS2 AS t10y2y_spread, DGS10 - DGS3MO AS t10y3m_spread,
  DGS30 - DGS10 AS t30y10y_spread, p.v AS rate_regime, q.v AS inflation_regime FROM aligned_n
  LEFT JOIN ({_regime('DFF')}) p USING (observation_date) LEFT JOIN ({_regime('yoy')}) q USING (observation_date)""")


def _composite(spark, sf_dir):
    return ft.macro_composite(src.macro_series(spark, sf_dir), ROLES, src.monthly_series(spark, sf_dir))


@query("j08_series_align", statement(f"SELECT observation_date, {r(*ROLES)} FROM aligned", "aligned"))
def _align(spark, sf_dir):
    return rounded(ft.align_series(src.macro_series(spark, sf_dir), ROLES, "DGS10"))


@query("w36_macro_spreads", statement(
    f"SELECT observation_date, {r('t10y2y_spread', 't10y3m_spread', 't30y10y_spread')} FROM composite", "composite"))
def _spreads(spark, sf_dir):
    return rounded(_composite(spark, sf_dir).drop("rate_regime", "inflation_regime"))


@query("w37_rate_regime", statement(f"SELECT observation_date, {r('rate_regime')} FROM composite", "composite"))
def _rate(spark, sf_dir):
    return rounded(_composite(spark, sf_dir).select("observation_date", "rate_regime"))


@query("w38_inflation_regime", statement(f"SELECT observation_date, {r('inflation_regime')} FROM composite", "composite"))
def _inflation(spark, sf_dir):
    return rounded(_composite(spark, sf_dir).select("observation_date", "inflation_regime"))


@query("r04_composite_long", statement(
    "SELECT * FROM (" + _long_sql("composite", ft.COMPOSITE_WINDOWS, "'COMPOSITE'", "observation_date", "macro", "macro_v1") + ")",
    "composite"))
def _composite_long(spark, sf_dir):
    return rounded(ft.composite_long(_composite(spark, sf_dir), "run-1").drop("generated_at_utc"))


@query("r01_macro_long", statement(
    "SELECT * FROM (" + _long_sql("macro_wide", ft.SERIES_WINDOWS, "series_id", "observation_date", "macro", "macro_v1") + ")",
    "macro_wide"))
def _macro_long(spark, sf_dir):
    wide = ft.macro_features(src.macro_series(spark, sf_dir))
    long = ft.wide_to_long(wide, ft.SERIES_WINDOWS, ft.MACRO_SET, "macro", "run-1", "series_id", "observation_date")
    return rounded(long.drop("generated_at_utc"))


def _calendar_and_series(spark, sf_dir):
    one = src.bars(spark, sf_dir).where("ticker = 'Brand#3'").select("date", "close")
    days = src.bars(spark, sf_dir).where("ticker = 'Brand#7'").select("date")
    return days, one


@query("j07_asof_on_calendar_dates", statement(f"""SELECT date, {r('close')} FROM (SELECT d.date,
  last_value(close IGNORE NULLS) OVER (ORDER BY d.date) AS close FROM (SELECT date FROM bars WHERE ticker = 'Brand#7') d
  LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#3') USING (date))""", "bars"))
def _fill(spark, sf_dir):
    return rounded(ft.fill_on_calendar(*_calendar_and_series(spark, sf_dir), "close"))


@query("j07_asof_any_date", statement(f"""SELECT d.date, {r('close')} FROM (SELECT date FROM bars WHERE ticker = 'Brand#7') d
  ASOF LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'Brand#3') s ON d.date >= s.date""", "bars"))
def _asof(spark, sf_dir):
    return rounded(ft.asof_on_calendar(*_calendar_and_series(spark, sf_dir), "close"))
