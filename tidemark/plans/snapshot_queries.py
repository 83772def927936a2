"""Queries over the snapshot, the screener and the comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import snapshot as sn
from tidemark.operators.batch import newest_modules, run_analytics
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import block, modules, r, statement
from tidemark.schemas import SNAPSHOT_COLUMNS
from tidemark.session import new_path
from tidemark.sources import tables as src

_W = modules("weekly")
_EXACT = ["rank_universe", "golden_cross"]
_COLUMNS = [c for m in SNAPSHOT_COLUMNS.values() for c in m]
_DOUBLES = [c for c in _COLUMNS if c not in _EXACT]
_CHOSEN = ["Brand#1", "Brand#3", "Brand#7", "Brand#12", "Brand#21"]
_IN = "(" + ", ".join(f"'{t}'" for t in _CHOSEN) + ")"


def _snapshot_sql() -> str:
    parts = [f"SELECT ticker, date AS as_of, {', '.join(SNAPSHOT_COLUMNS['returns'])} FROM {_W['returns']} "
             f"WHERE date = (SELECT max(date) FROM {_W['returns']})"]
    for m in list(SNAPSHOT_COLUMNS)[1:]:
        parts.append(f"SELECT ticker, {', '.join(SNAPSHOT_COLUMNS[m])} FROM {_W[m]} "
                     f"WHERE date = (SELECT max(date) FROM {_W[m]})")
    parts.append("SELECT ticker, arg_max(close, date) AS last_price FROM weekly GROUP BY ticker")
    joined = f"({parts[0]}) base" + "".join(f" LEFT JOIN ({p}) m{i} USING (ticker)" for i, p in enumerate(parts[1:]))
    return f"SELECT * FROM {joined}"


block("snap", ["weekly", *_W.values()], _snapshot_sql())


_WRITTEN: dict[tuple[str, str], tuple[str, str]] = {}  # of this application: where bars and modules of a folder were written


def _modules(spark, sf_dir):
    """(bars, root) of the weekly bars and their modules, computed by the first query that asks and then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path, root = new_path(spark, "market"), new_path(spark, "analytics")
        src.weekly_bars(spark, sf_dir).write.parquet(path)
        run_analytics(spark.read.parquet(path), "US_EQ", root)
        _WRITTEN[key] = (path, root)
    path, root = _WRITTEN[key]
    return spark.read.parquet(path), root


def _snapshot(spark, sf_dir, cap=None):
    prices, root = _modules(spark, sf_dir)
    return sn.snapshot(newest_modules(spark, root, "US_EQ"), prices, cap)


@query("j01_snapshot", statement(
    f"SELECT ticker, as_of, {r(*_DOUBLES, 'last_price')}, {', '.join(_EXACT)} FROM snap", "snap"))
def _snap(spark, sf_dir):
    return rounded(_snapshot(spark, sf_dir))


@query("j02_last_price", statement(
    f"SELECT ticker, {r('last_price')} FROM (SELECT ticker, arg_max(close, date) AS last_price FROM weekly GROUP BY ticker)",
    "weekly"))
def _last_price(spark, sf_dir):
    return rounded(sn.last_price(src.weekly_bars(spark, sf_dir)))


@query("j03_latest_rows", statement(
    f"""SELECT ticker, date, {r('mom_1m', 'mom_12m')}, rank_universe FROM {_W['momentum']}
    WHERE date = (SELECT max(date) FROM {_W['momentum']})""", _W["momentum"]))
def _latest(spark, sf_dir):
    _, root = _modules(spark, sf_dir)
    mom = newest_modules(spark, root, "US_EQ", ["momentum"])["momentum"]
    return rounded(sn.latest_rows(mom).select("ticker", "date", "mom_1m", "mom_12m", "rank_universe"))


@query("j04_cap_filter", statement(f"""SELECT ticker, as_of, {r(*SNAPSHOT_COLUMNS['returns'], 'last_price')} FROM snap
  WHERE ticker IN (SELECT ticker FROM weekly WHERE cap_category = 'MID')""", "snap"))
def _cap(spark, sf_dir):
    prices, root = _modules(spark, sf_dir)
    return rounded(sn.snapshot(newest_modules(spark, root, "US_EQ", ["returns"]), prices, "mid"))


def _preset_sql(name: str) -> str:
    tests = []
    for c, how, bound, absent in sn.PRESETS[name]:
        tests.append(f"coalesce({c}, false)" if how == "true" else f"coalesce({c}, {absent}) {how} {bound}")
    return f"SELECT '{name}' AS preset, ticker FROM snap WHERE {' AND '.join(tests)}"


@query("f09_screener_preset", statement(" UNION ALL ".join(_preset_sql(p) for p in sn.PRESETS), "snap"))
def _presets(spark, sf_dir):
    # One pass over the snapshot: every ticker carries the list of presets it meets.
    snap = _snapshot(spark, sf_dir)
    met = F.filter(F.array(*[
        F.when(sn.preset_test(p), F.lit(p)) for p in sn.PRESETS
    ]), lambda p: p.isNotNull())
    return snap.select(F.explode(met).alias("preset"), "ticker")


_BOUNDS = {"ret_21d_min": -99.0, "mom_12m_min": -95.0, "rsi_min": 40.0, "rsi_max": 70.0,
           "vol_max": 100000.0, "beta_max": 50.0}


def _manual_sql() -> str:
    tests = [f"coalesce({c}, {absent}) * {scale} {how} {_BOUNDS.get(arg, default)}"
             for arg, c, scale, how, default, absent in sn.MANUAL]
    return f"SELECT ticker, {r('ret_21d', 'rsi_14', 'vol_252d')} FROM snap WHERE {' AND '.join(tests)}"


@query("f10_screener_manual", statement(_manual_sql(), "snap"))
def _manual(spark, sf_dir):
    df = sn.screen_manual(_snapshot(spark, sf_dir), **_BOUNDS)
    return rounded(df.select("ticker", "ret_21d", "rsi_14", "vol_252d"))


def _shown_sql(columns) -> str:
    return ", ".join(f'round({c} * {scale} + 1e-9, {d}) + 0.0 AS "{h}"' if d else f'{c} AS "{h}"' for c, h, scale, d in columns)


def _nudged(df):
    return df.select(*[
        (F.col(f.name) + 0.0 if f.dataType.typeName() == "double" else F.col(f.name)).alias(f.name) for f in df.schema
    ])


def _edge(df):
    """The same shift off the rounding edge that the SQL side applies."""
    scale = {c: s for c, _, s, d in [*sn.DISPLAY, *sn.COMPARE] if d}
    return df.select(*[(F.col(c) + 1e-9 / scale[c] if c in scale else F.col(c)).alias(c) for c in df.columns])


@query("f11_screener_display", statement(f"SELECT {_shown_sql(sn.DISPLAY)} FROM snap", "snap"))
def _display(spark, sf_dir):
    return _nudged(sn.screener_display(_edge(_snapshot(spark, sf_dir))))


@query("t02_screener_sort", statement(
    f"""SELECT ticker AS "Ticker", round(rsi_14 + 1e-9, 3) + 0.0 AS "RSI", CAST(row_number() OVER
    (ORDER BY round(rsi_14 + 1e-9, 3) NULLS LAST, ticker) AS BIGINT) AS place FROM snap""", "snap"))
def _sort(spark, sf_dir):
    from tidemark.operators.ordering import numbered

    shown = sn.screener_display(_edge(_snapshot(spark, sf_dir)), sort_by="RSI", ascending=True).select("Ticker", "RSI")
    missing = F.col("RSI").isNull()
    placed = numbered(shown.withColumn("_last", missing), ["_last", "RSI", "Ticker"], "place")
    return placed.select("Ticker", (F.col("RSI") + 0.0).alias("RSI"), (F.col("place") + 1).alias("place"))


@query("f12_compare_table", statement(
    f'SELECT ticker AS "Ticker", {_shown_sql(sn.COMPARE)} FROM snap WHERE ticker IN {_IN}', "snap"))
def _compare(spark, sf_dir):
    return _nudged(sn.compare_table(_edge(_snapshot(spark, sf_dir)), _CHOSEN))


_SCORED = [*sn.HIGH_IS_GOOD, *sn.LOW_IS_GOOD]


@query("f13_compare_score", statement("SELECT ticker, " + ", ".join(
    f"round(coalesce(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9), 0) + 1e-9, 6) + 0.0 AS {c}"
    for c in _SCORED) + f" FROM snap WHERE ticker IN {_IN}", "snap"))
def _scores(spark, sf_dir):
    return rounded(sn.compare_scores(_snapshot(spark, sf_dir), _CHOSEN))


@query("f14_radar_score", statement("SELECT ticker, " + ", ".join(
    f"round(greatest(0, least(1, (coalesce({c}, {absent}) + {off}) / {span})) + 1e-9, 6) + 0.0 AS {axis}"
    for axis, c, absent, off, span in sn.RADAR) + f""", round(greatest(0, least(1, 1 - abs(coalesce(rsi_14, 50) - 50) / 50))
    + 1e-9, 6) + 0.0 AS rsi_norm FROM snap WHERE ticker IN {_IN}""", "snap"))
def _radar(spark, sf_dir):
    return rounded(sn.radar_scores(_snapshot(spark, sf_dir), _CHOSEN))
