"""Metrics against slow definitions on generated series with gaps, ties and zeros."""

import datetime as dt
import math
import random
import statistics as st

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators import analytics as an
from tidemark.operators import backtest as bt
from tidemark.operators import features as ft
from tidemark.operators.ordering import exact_quantiles, ranks_within, rolling_mean_over_all

DAY = dt.date(2020, 1, 1)


def make(spark, n=700, tickers=("A", "B"), seed=1, gap=0.1):
    rnd = random.Random(seed)
    rows = []
    for t in tickers:
        p = 100.0
        for i in range(n):
            if rnd.random() < gap:
                continue
            p *= math.exp(rnd.gauss(0, 0.02))
            close = 50.0 if rnd.random() < 0.02 else p
            rows.append((t, DAY + dt.timedelta(days=i), p, p * 1.01, p * 0.99, close, close, float(rnd.randint(1, 9)),
                         "LARGE"))
    schema = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double, cap_category string"
    return spark.createDataFrame(rows, schema), rows


def by_ticker(df, *columns):
    out = {}
    for r in df.orderBy("ticker", "date").collect():
        out.setdefault(r["ticker"], []).append(tuple(r[c] for c in columns))
    return out


def closes(rows, ticker):
    return [r[5] for r in rows if r[0] == ticker]


def same(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def returns_of(px):
    return [None] + [b / a - 1 for a, b in zip(px, px[1:])]


def test_drawdown_and_dispersion(spark):
    df, rows = make(spark)
    got = by_ticker(an.risk(df, "M"), "max_dd_252d", "vol_252d", "vol_63d", "sortino_252d")
    for t in "AB":
        px = closes(rows, t)
        rets = returns_of(px)
        for i, (dd, vol, vol63, sortino) in enumerate(got[t]):
            want = None
            if i >= 252:
                peak, want = 0.0, 0.0
                for p in px[i - 252:i + 1]:
                    peak = max(peak, p)
                    want = min(want, p / peak - 1)
            assert same(dd, want)
            assert same(vol, st.stdev(rets[i - 251:i + 1]) * math.sqrt(252) if i >= 252 else None)
            assert same(vol63, st.stdev(rets[i - 62:i + 1]) * math.sqrt(252) if i >= 63 else None)
            want = None
            if i >= 252:
                frame = rets[i - 251:i + 1]
                neg = [r for r in frame if r < 0]
                want = st.mean(frame) / st.stdev(neg) * math.sqrt(252)
            assert same(sortino, want)


def test_beta_uses_pairs_before_the_row(spark):
    df, rows = make(spark)
    got = by_ticker(an.risk(df, "M", bench_ticker="B"), "date", "beta_252d", "alpha_252d")
    dates = {t: [r[1] for r in rows if r[0] == t] for t in "AB"}
    bench = dict(zip(dates["B"], returns_of(closes(rows, "B"))))
    rets = dict(zip(dates["A"], returns_of(closes(rows, "A"))))
    pairs = [(d, rets[d], bench[d]) for d in dates["A"] if rets[d] is not None and bench.get(d) is not None]
    want = {}
    for i in range(252, len(pairs)):
        r, b = [p[1] for p in pairs[i - 252:i]], [p[2] for p in pairs[i - 252:i]]
        beta = st.covariance(r, b) / st.variance(b)
        want[pairs[i][0]] = (beta, (st.mean(r) - beta * st.mean(b)) * 252)
    assert want
    for d, beta, alpha in got["A"]:
        w = want.get(d, (None, None))
        assert same(beta, w[0], 1e-8) and same(alpha, w[1], 1e-8)


def ema(xs, alpha):
    out, y = [], None
    for x in xs:
        y = x if y is None else (1 - alpha) * y + alpha * x
        out.append(y)
    return out


@pytest.mark.parametrize("n", [30, 3000])
def test_exponential_indicators(spark, n):
    df, rows = make(spark, n=n, tickers=("A",), gap=0.0)
    got = by_ticker(an.technical(df, "M"), "rsi_14", "macd_line", "macd_signal", "atr_14", "obv")["A"]
    px = closes(rows, "A")
    delta = [b - a for a, b in zip(px, px[1:])]
    up, dn = ema([max(d, 0) for d in delta], 1 / 14), ema([max(-d, 0) for d in delta], 1 / 14)
    line = [a - b for a, b in zip(ema(px, 2 / 13), ema(px, 2 / 27))]
    signal = ema(line, 0.2)
    bars = [r for r in rows]
    tr = [bars[0][3] - bars[0][4]] + [
        max(b[3] - b[4], abs(b[3] - a[5]), abs(b[4] - a[5])) for a, b in zip(bars, bars[1:])]
    atr = ema(tr, 1 / 14)
    flow = 0.0
    for i, (rsi, ml, ms, at, obv) in enumerate(got):
        want = 100 - 100 / (1 + up[i - 1] / dn[i - 1]) if i >= 14 else None
        assert same(rsi, want) and same(ml, line[i]) and same(ms, signal[i])
        assert same(at, atr[i] / px[i] if i >= 13 else None)
        if i:
            flow += (px[i] > px[i - 1]) * rows[i][7] - (px[i] < px[i - 1]) * rows[i][7]
        assert same(obv, flow)


def test_rising_series_has_no_rsi(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.0 + i, 1.0 + i, 1.0, "LARGE") for i in range(40)]
    df = spark.createDataFrame(rows, make(spark, 5)[0].schema)
    assert {r[0] for r in by_ticker(an.technical(df, "M"), "rsi_14")["A"]} == {None}


def test_calendar_lag_differs_from_row_lag(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    rows = [("A", d, float(10 + i), 1.0) for i, d in enumerate(days)]
    rows += [("B", days[0], 10.0, 1.0), ("B", days[2], 20.0, 1.0), ("B", days[3], 40.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    cal = win.with_calendar_index(df).select("ticker", "date", win.calendar_change(F.col("close"), 1, "ticker").alias("c"))
    assert [r[0] for r in by_ticker(cal, "c")["B"]] == [None, None, 1.0]
    row = df.select("ticker", "date", win.change(F.col("close"), 1, win.series()).alias("c"))
    assert [r[0] for r in by_ticker(row, "c")["B"]] == [None, 1.0, 1.0]


def test_zero_base_and_constant_series(spark):
    rows = [("A", DAY + dt.timedelta(days=i), v) for i, v in enumerate([0.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    assert [r[0] for r in by_ticker(an.returns(df, "M"), "ret_1d")["A"]] == [None, None, 0.0]
    flat = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), 0.1) for i in range(150)], df.schema)
    for n in (21, 63):
        z = win.with_zscores(flat, n, {"close": "z"})
        assert z.where("z IS NOT NULL").count() == 0


def test_short_tickers_are_left_out(spark):
    df, _ = make(spark, n=15)
    assert an.risk(df, "M").count() == 0
    assert an.momentum(df, "M").count() == 0
    assert an.technical(df, "M").count() == 0


def test_ranks_with_ties_and_nulls(spark):
    values = [0.5, 0.5, None, -1.0, 0.0, 0.0, 3e9, None, -1e-12]
    df = spark.createDataFrame([(str(i), DAY, v) for i, v in enumerate(values)], "ticker string, date date, mom double")
    got = {r["ticker"]: r["rank_universe"] for r in an.rank_universe(df, "mom").collect()}
    assert [got[str(i)] for i in range(9)] == [2, 2, 8, 7, 4, 4, 1, 8, 6]
    pct = {r["ticker"]: r["p"] for r in an.percentile_ranks(df, {"mom": "p"}).collect()}
    assert pct["2"] is None and same(pct["0"], 5.5 / 7 * 100) and same(pct["3"], 1 / 7 * 100)
    assert ranks_within(df, ["date"], "mom", True).count() == 5


def test_rolling_mean_crosses_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 3), rnd.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, d int, v double").repartition(7)
    got = {r["id"]: r["m"] for r in rolling_mean_over_all(df, "v", ["d", "id"], 7, "m", block=16).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert len(got) == 1000
    for i, r in enumerate(ordered):
        assert same(got[r[0]], st.mean(x[2] for x in ordered[max(0, i - 6):i + 1]))


def test_quantiles_of_groups_of_any_size(spark):
    rnd = random.Random(5)
    inf = float("inf")
    rows = [("hot", 7.0)] * 400 + [("hot", rnd.lognormvariate(0, 3)) for _ in range(600)] + [("cold", float(i)) for i in range(9)]
    rows += [("far", v) for v in (-inf, 1.0, 2.0, inf, inf)] + [("huge", v) for v in (-1.7e308, 0.0, 1.7e308)] + [("one", 3.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.953, "e": 1.0}
    for accuracy in (100, 100_000):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy).collect()}
        assert set(got) == {"hot", "cold", "far", "huge", "one", None}
        for g in got:
            values = sorted(v for k, v in rows if k == g)
            for name, p in probs.items():
                pos = p * (len(values) - 1)
                lo, hi = values[math.floor(pos)], values[math.ceil(pos)]
                want = lo if lo == hi or pos == math.floor(pos) else lo + (hi - lo) * (pos - math.floor(pos))
                assert same(got[g][name], want), (g, name, got[g][name], want)
    assert exact_quantiles(df.where("false"), ["g"], "v", probs).count() == 0


def test_ranks_hold_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("d", v) for v in (-inf, -1.0, 0.0, 0.0, 1e-300, 5.0, inf)], "date string, v double")
    got = {r["v"]: (r["below"], r["ties"], r["total"]) for r in ranks_within(df, ["date"], "v", False).collect()}
    assert got == {-inf: (0, 1, 7), -1.0: (1, 1, 7), 0.0: (2, 2, 7), 1e-300: (4, 1, 7), 5.0: (5, 1, 7), inf: (6, 1, 7)}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.97])
def test_exponential_means_over_gaps(spark, share):
    rnd = random.Random(8)
    values = [None if rnd.random() < share else rnd.uniform(1, 100) for _ in range(900)]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "ticker string, date int, x double")
    got = win.with_ema(df, {"x": [("fast", "x", 2 / 13), ("slow", "x", 2 / 27)]}).orderBy("date").collect()
    for name, alpha in (("fast", 2 / 13), ("slow", 2 / 27)):
        want = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False).mean()
        for r, w in zip(got, want):
            assert (r[name] is None) == math.isnan(w) and (r[name] is None or abs(r[name] - w) < 1e-12 * max(1, abs(w)))


def test_regime_percentile(spark):
    rnd = random.Random(2)
    values = [None if rnd.random() < 0.1 else float(rnd.randint(0, 30)) for _ in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["p"] for r in df.select("i", ft.percentile_of_last(F.col("v"), 252, "i").alias("p")).orderBy("i").collect()]
    for i, v in enumerate(values):
        frame = [x for x in values[max(0, i - 251):i + 1] if x is not None]
        want = None
        if v is not None and len(frame) >= 126:
            want = (sum(x < v for x in frame) + (sum(x == v for x in frame) + 1) / 2) / len(frame)
        assert same(got[i], want)


@pytest.mark.parametrize("rebalance", ["Annual", "None"])
def test_portfolio_path_equals_the_daily_loop(spark, rebalance):
    df, rows = make(spark, n=800, tickers=("A", "B", "C"), gap=0.2)
    weights = {"A": 0.5, "B": 0.3, "C": 0.2}
    hold = spark.createDataFrame([("F", t, w * 2) for t, w in weights.items()] + [("F", "X", 1.0)],
                                 "fund string, ticker string, weight double")
    path = bt.portfolio_path(bt.held_returns(bt.held_prices(df, hold)), bt.renormalised(hold, df), rebalance, 0.01)
    got = [(r["date"], r["equity"]) for r in path.orderBy("date").collect()]
    days = sorted({r[1] for r in rows})
    filled = {}
    for t in weights:
        own, last = {r[1]: r[5] for r in rows if r[0] == t}, None
        filled[t] = []
        for d in days:
            last = own.get(d, last)
            filled[t].append(last)
    steps = [(days[i], {t: filled[t][i] / filled[t][i - 1] - 1 for t in weights}) for i in range(1, len(days))
             if all(filled[t][i - 1] is not None for t in weights)]
    w, value = dict(weights), 1.0
    for i, (d, r) in enumerate(steps):
        if i:
            before = steps[i - 1]
            w = {t: w[t] * (1 + before[1][t]) for t in w}
            total = sum(w.values())
            w = {t: x / total for t, x in w.items()}
            if rebalance == "Annual" and before[0].year != d.year:
                w = dict(weights)
        value *= (1 - 0.01 / 252) * (1 + sum(w[t] * r[t] for t in w))
        assert got[i][0] == d and same(got[i][1], value)
    assert len(got) == len(steps)


def test_partitioning_does_not_change_results(spark):
    df, _ = make(spark, n=300)
    a = by_ticker(an.momentum(df.repartition(1), "M"), "mom_1m", "rank_universe")
    b = by_ticker(an.momentum(df.repartition(13).orderBy(F.rand(1)), "M"), "mom_1m", "rank_universe")
    assert a == b
