"""Portfolio and benchmark equity, and what is measured on them.

Prices are long (ticker, date, close); holdings are (fund, ticker, weight). An equity curve has one row per fund and
calendar date, which bounds every window and every gathered group below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators.analytics import mean_per_bar

TRADING_DAYS = 252


def held_prices(prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """Closes of the held tickers on the dates where any of them traded, gaps filled forward.

    Every bar is repeated up to the day before the ticker's next bar, so no date-by-ticker grid is built.
    """
    wanted = holdings.select("ticker").distinct()
    bars = mean_per_bar(prices.where(F.col("close").isNotNull()).join(wanted, "ticker", "left_semi"), "close")
    days = bars.select("date").distinct().select(
        "date", F.row_number().over(Window.orderBy("date")).alias("di"), F.count(F.lit(1)).over(
            Window.partitionBy()).alias("_days"),
    )
    until = F.coalesce(F.lead("di").over(win.series(order="di")), F.col("_days") + 1) - 1
    spans = bars.join(F.broadcast(days), "date").withColumn("_until", until.cast("int"))
    filled = spans.select("ticker", "close", F.explode(F.sequence("di", "_until")).alias("di"))
    return filled.join(F.broadcast(days.select("di", "date")), "di").select("ticker", "date", "close")


def held_returns(filled: DataFrame) -> DataFrame:
    return filled.select("ticker", "date", win.change(F.col("close"), 1, win.series()).alias("ret"))


def renormalised(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Positive weights of tickers that have prices, scaled to sum to one per fund."""
    present = prices.where(F.col("close").isNotNull()).select("ticker").distinct()
    kept = holdings.where("weight > 0").join(present, "ticker", "left_semi")
    total = F.sum("weight").over(Window.partitionBy("fund"))
    return kept.select("fund", "ticker", (F.col("weight") / total).alias("weight"))


def common_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(fund, date, ticker, weight, ret) on the dates where every holding of the fund has a return."""
    held = rets.join(weights, "ticker").withColumn(
        "_with", F.count("ret").over(Window.partitionBy("fund", "date"))
    )
    sizes = weights.groupBy("fund").agg(F.count(F.lit(1)).alias("_holdings"))
    return held.join(sizes, "fund").where("_with = _holdings").drop("_with", "_holdings")


def portfolio_path(rets: DataFrame, weights: DataFrame, rebalance: str = "Annual", fee: float = 0.0) -> DataFrame:
    """(fund, date, equity): weights drift with the returns, return to target at each new year if annual, and the
    yearly fee is taken daily.

    Between two resets the day-by-day product telescopes to the weighted sum of each holding's own growth, so the
    path needs a running product per holding and a chain over the few segment ends.
    """
    seg = F.year("date") if rebalance.lower() == "annual" else F.lit(0)
    held = common_returns(rets, weights).withColumn("seg", seg)
    grown = held.withColumn(
        "growth", F.product(1 + F.col("ret")).over(win.running("fund", "ticker", "seg"))
    )
    daily = grown.groupBy("fund", "seg", "date").agg(F.sum(F.col("weight") * F.col("growth")).alias("_sum"))
    nth = F.row_number().over(win.series("fund", "seg"))
    daily = daily.withColumn("_value", F.col("_sum") * F.pow(F.lit(1 - fee / TRADING_DAYS), nth))
    ends = daily.groupBy("fund", "seg").agg(F.max_by("_value", "date").alias("_end"))
    earlier = Window.partitionBy("fund").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("fund", "seg", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)).alias("_start"))
    return daily.join(starts, ["fund", "seg"]).select("fund", "date", (F.col("_value") * F.col("_start")).alias("equity"))


def bench_equity(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(fund, date, equity) of a daily rebalanced mix; a single ticker is a mix with one weight."""
    daily = common_returns(rets, weights).groupBy("fund", "date").agg(
        F.sum((1 + F.col("ret")) * F.col("weight")).alias("_step")
    )
    return daily.select("fund", "date", F.product("_step").over(win.running("fund")).alias("equity"))


def from_one(equity: DataFrame) -> DataFrame:
    """Scale every curve to start at one."""
    return equity.withColumn("equity", F.col("equity") / F.first("equity").over(win.series("fund")))


def bench_on_fund_dates(bench: DataFrame, equity: DataFrame) -> DataFrame:
    """(fund, date, bench): one benchmark curve on each fund's dates, filled forward, starting at one.

    Of several benchmark values on a date the largest counts, so the curve has one row per date.
    """
    level = bench.groupBy("date").agg(F.max("equity").alias("bench"))
    joined = equity.select("fund", "date").join(F.broadcast(level), "date", "left")
    filled = joined.select("fund", "date", F.last("bench", ignorenulls=True).over(win.running("fund")).alias("bench"))
    known = filled.where(F.col("bench").isNotNull())
    return known.withColumn("bench", F.col("bench") / F.first("bench").over(win.series("fund")))


def drawdown_series(equity: DataFrame) -> DataFrame:
    peak = F.max("equity").over(win.running("fund"))
    return equity.withColumn("drawdown", F.try_divide(F.col("equity") - peak, peak))


def max_drawdown(equity: DataFrame) -> DataFrame:
    return drawdown_series(equity).groupBy("fund").agg(F.min("drawdown").alias("max_drawdown"))


def rolling_12m(equity: DataFrame) -> DataFrame:
    roll = win.change(F.col("equity"), TRADING_DAYS, win.series("fund")) * 100
    return equity.withColumn("roll", roll).where(F.col("roll").isNotNull())


def _daily(equity: DataFrame) -> DataFrame:
    return equity.withColumn("ret", win.change(F.col("equity"), 1, win.series("fund")))


def _years() -> Column:
    return F.datediff(F.max("date"), F.min("date")) / 365.25


def _cagr() -> Column:
    growth = F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date"))
    return F.when(_years() > 0, F.pow(growth, F.try_divide(F.lit(1.0), _years())) - 1)


def perf_kpis(equity: DataFrame, start_amount: float, rf: float = 0.0) -> DataFrame:
    """Final value, total return, CAGR, volatility and Sharpe per fund; null below two days."""
    last, first = F.max_by("equity", "date"), F.min_by("equity", "date")
    std, mean = F.stddev_samp("ret"), F.avg("ret")
    agg = _daily(equity).groupBy("fund").agg(
        (last * start_amount).alias("final_value"), (F.try_divide(last, first) - 1).alias("total_return"),
        _cagr().alias("cagr"), (std * math.sqrt(TRADING_DAYS)).alias("vol"),
        F.when(std > 0, F.try_divide(mean - rf / TRADING_DAYS, std) * math.sqrt(TRADING_DAYS)).alias("sharpe"),
        F.count(F.lit(1)).alias("_days"),
    )
    return agg.where("_days >= 2").drop("_days")


def sortino(equity: DataFrame, rf: float = 0.0) -> DataFrame:
    floor = rf / TRADING_DAYS
    low = F.when(F.col("ret") < floor, F.col("ret"))
    spread = F.stddev_samp(low) * math.sqrt(TRADING_DAYS)
    value = F.when((F.count(low) >= 2) & (spread > 0), F.try_divide((F.avg("ret") - floor) * TRADING_DAYS, spread))
    return _daily(equity).groupBy("fund").agg(value.alias("sortino"))


def calmar(equity: DataFrame) -> DataFrame:
    agg = drawdown_series(equity).groupBy("fund").agg(_cagr().alias("_cagr"), F.abs(F.min("drawdown")).alias("_fall"))
    return agg.select("fund", F.when(F.col("_fall") > 0, F.try_divide("_cagr", "_fall")).alias("calmar"))


def beta_alpha(equity: DataFrame, bench: DataFrame, rf: float = 0.0) -> DataFrame:
    """Beta and Jensen alpha of daily returns; null below twenty aligned days."""
    b = bench.withColumn("b", win.change(F.col("bench"), 1, win.series("fund"))).select("fund", "date", "b")
    pairs = _daily(equity).join(b, ["fund", "date"]).where(F.col("ret").isNotNull() & F.col("b").isNotNull())
    floor = rf / TRADING_DAYS
    agg = pairs.groupBy("fund").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("ret", "b"), F.var_samp("b")).alias("_beta"),
        F.avg("ret").alias("mr"), F.avg("b").alias("mb"),
    )
    enough = F.col("n") >= 20
    alpha = (F.col("mr") - floor - F.col("_beta") * (F.col("mb") - floor)) * TRADING_DAYS
    return agg.select("fund", F.when(enough, F.col("_beta")).alias("beta"), F.when(enough, alpha).alias("alpha"))


def period_returns(equity: DataFrame, period: str, value: str = "equity") -> DataFrame:
    """Change of the last value from one calendar month or year to the next one; none across an empty period."""
    month = period == "month"
    label = F.last_day("date") if month else F.year("date")
    ends = equity.groupBy("fund", label.alias("period")).agg(F.max_by(value, "date").alias("_v"))
    o = win.series("fund", order="period")
    before = F.lag("period").over(o)
    next_to = F.last_day(F.add_months("period", -1)) == before if month else before == F.col("period") - 1
    return ends.select("fund", "period", F.when(next_to, win.change(F.col("_v"), 1, o)).alias("ret")).where(
        F.col("ret").isNotNull()
    )


def positive_months(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("fund").agg(F.avg((F.col("ret") > 0).cast("double")).alias("positive_share"))


def var_cvar(monthly: DataFrame) -> DataFrame:
    """5th percentile of the monthly returns and mean of those at or below it; a few hundred months per fund."""
    var = monthly.groupBy("fund").agg(F.percentile("ret", 0.05).alias("var95"))
    joined = monthly.join(var, "fund")
    return joined.groupBy("fund").agg(
        F.max("var95").alias("var95"),
        F.coalesce(F.avg(F.when(F.col("ret") <= F.col("var95"), F.col("ret"))), F.max("var95")).alias("cvar95"),
    )


def fund_bench_pairs(monthly: DataFrame, bench_monthly: DataFrame) -> DataFrame:
    return monthly.withColumnRenamed("ret", "fund_ret").join(
        bench_monthly.withColumnRenamed("ret", "bench_ret"), ["fund", "period"]
    )


def capture_ratios(pairs: DataFrame) -> DataFrame:
    def side(test: Column, name: str) -> Column:
        f = F.avg(F.when(test, F.col("fund_ret")))
        return F.try_divide(f, F.avg(F.when(test, F.col("bench_ret")))).alias(name)

    return pairs.groupBy("fund").agg(
        side(F.col("bench_ret") > 0, "up_capture"), side(F.col("bench_ret") < 0, "down_capture")
    )
