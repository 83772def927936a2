"""Queries over portfolios, benchmarks and investors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import advisory as ad
from tidemark.operators import backtest as bt
from tidemark.operators import upsert as up
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import block, r, statement
from tidemark.sources import tables as src

HOLDINGS = [
    ("FA", "ECONOMY", 0.5), ("FA", "LARGE", 0.3), ("FA", "MEDIUM", 0.15), ("FA", "NOSUCH", 0.2),
    ("FB", "MEDIUM", 0.4), ("FB", "PROMO", 0.5), ("FB", "SMALL", 0.02),
    ("FC", "ECONOMY", 0.2), ("FC", "LARGE", 0.2), ("FC", "MEDIUM", 0.2), ("FC", "PROMO", 0.2), ("FC", "SMALL", 0.3),
]
BENCHES = [("single", "STANDARD", 1.0), ("mix", "STANDARD", 0.6), ("mix", "ECONOMY", 0.4)]
FEE, RF, START = 0.002, 0.02, 10000.0
_SCHEMA = "fund string, ticker string, weight double"


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"('{f}', '{t}', {w}::DOUBLE)" for f, t, w in rows) + ") v(fund, ticker, weight)"


def _blocks(p: str, rows) -> None:
    """Holdings, filled prices and common returns of one set of holdings."""
    block(f"{p}_hold", [], f"SELECT * FROM {_values(rows)}")
    block(f"{p}_days", ["calm", f"{p}_hold"], f"""SELECT DISTINCT date FROM calm
      WHERE ticker IN (SELECT ticker FROM {p}_hold)""")
    block(f"{p}_fill", [f"{p}_days"], f"""SELECT ticker, date, close FROM (SELECT t.ticker, d.date,
      last_value(close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date) AS close FROM {p}_days d
      CROSS JOIN (SELECT DISTINCT ticker FROM {p}_hold) t LEFT JOIN calm b ON b.ticker = t.ticker AND b.date = d.date)
      WHERE close IS NOT NULL""")
    block(f"{p}_wt", [f"{p}_hold", "calm"], f"""SELECT fund, ticker, weight / sum(weight) OVER (PARTITION BY fund) AS weight
      FROM {p}_hold WHERE weight > 0 AND ticker IN (SELECT ticker FROM calm)""")
    block(f"{p}_common", [f"{p}_fill", f"{p}_wt"], f"""SELECT * FROM (SELECT fund, ticker, date, weight, ret,
      count(ret) OVER (PARTITION BY fund, date) AS c FROM {p}_wt JOIN (SELECT ticker, date,
      close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM {p}_fill) USING (ticker))
      JOIN (SELECT fund, count(*) AS k FROM {p}_wt GROUP BY fund) USING (fund) WHERE c = k""")


_blocks("fh", HOLDINGS)
_blocks("bh", BENCHES)


def _path_sql(p: str, seg: str, fee: float) -> str:
    return f"""SELECT fund, date, v * coalesce(s, 1) AS equity FROM (SELECT fund, seg, date, v, s FROM (
      SELECT fund, seg, date, t * pow(1 - {fee} / 252.0, row_number() OVER (PARTITION BY fund, seg ORDER BY date)) AS v
      FROM (SELECT fund, seg, date, sum(weight * g) AS t FROM (SELECT *, product(1 + ret) OVER
      (PARTITION BY fund, ticker, seg ORDER BY date) AS g FROM (SELECT *, {seg} AS seg FROM {p}_common)) GROUP BY ALL))
      JOIN (SELECT fund, seg, product(e) OVER (PARTITION BY fund ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1
      PRECEDING) AS s FROM (SELECT fund, seg, arg_max(v, date) AS e FROM (SELECT fund, seg, date,
      t * pow(1 - {fee} / 252.0, row_number() OVER (PARTITION BY fund, seg ORDER BY date)) AS v FROM (SELECT fund, seg, date,
      sum(weight * g) AS t FROM (SELECT *, product(1 + ret) OVER (PARTITION BY fund, ticker, seg ORDER BY date) AS g
      FROM (SELECT *, {seg} AS seg FROM {p}_common)) GROUP BY ALL)) GROUP BY 1, 2)) USING (fund, seg))"""


block("path", ["fh_common"], _path_sql("fh", "year(date)", FEE))
block("path_held", ["fh_common"], _path_sql("fh", "0", 0.0))
block("eq", ["path"], "SELECT fund, date, equity / first_value(equity) OVER (PARTITION BY fund ORDER BY date) AS equity FROM path")
block("beq", ["bh_common"], """SELECT fund, date, product(step) OVER (PARTITION BY fund ORDER BY date) AS equity FROM (
  SELECT fund, date, sum((1 + ret) * weight) AS step FROM bh_common GROUP BY 1, 2)""")
block("beq_on", ["eq", "beq"], """SELECT fund, date, bench / first_value(bench) OVER (PARTITION BY fund ORDER BY date) AS bench
  FROM (SELECT e.fund, e.date, last_value(b.equity IGNORE NULLS) OVER (PARTITION BY e.fund ORDER BY e.date) AS bench
  FROM eq e LEFT JOIN (SELECT * FROM beq WHERE fund = 'mix') b USING (date)) WHERE bench IS NOT NULL""")


def _holdings(spark, rows=HOLDINGS):
    return spark.createDataFrame(rows, _SCHEMA)


def _path(spark, sf_dir, rebalance="Annual", fee=FEE):
    prices, hold = src.stored(src.calm_bars(spark, sf_dir)), _holdings(spark)
    filled = bt.held_prices(prices, hold)
    return bt.portfolio_path(bt.held_returns(filled), bt.renormalised(hold, prices), rebalance, fee)


def _equity(spark, sf_dir):
    return bt.from_one(_path(spark, sf_dir))


def _benches(spark, sf_dir):
    prices, hold = src.stored(src.calm_bars(spark, sf_dir)), _holdings(spark, BENCHES)
    return bt.bench_equity(bt.held_returns(bt.held_prices(prices, hold)), bt.renormalised(hold, prices))


def _bench_on(spark, sf_dir, equity):
    return bt.bench_on_fund_dates(_benches(spark, sf_dir).where("fund = 'mix'"), equity)


@query("w44_price_ffill", statement(f"SELECT ticker, date, {r('close')} FROM fh_fill", "fh_fill"))
def _ffill(spark, sf_dir):
    return rounded(bt.held_prices(src.calm_bars(spark, sf_dir), _holdings(spark)))


@query("j10_weighted_holdings", statement(f"SELECT fund, ticker, {r('weight')} FROM fh_wt", "fh_wt"))
def _weights(spark, sf_dir):
    return rounded(bt.renormalised(_holdings(spark), src.calm_bars(spark, sf_dir)))


@query("j09_common_dates", statement(f"SELECT fund, ticker, date, {r('ret', 'weight')} FROM fh_common", "fh_common"))
def _common(spark, sf_dir):
    prices, hold = src.stored(src.calm_bars(spark, sf_dir)), _holdings(spark)
    rets = bt.held_returns(bt.held_prices(prices, hold))
    return rounded(bt.common_returns(rets, bt.renormalised(hold, prices)).select("fund", "ticker", "date", "ret", "weight"))


@query("w39_portfolio_path", statement(f"SELECT fund, date, {r('equity')} FROM path", "path"))
def _portfolio(spark, sf_dir):
    return rounded(_path(spark, sf_dir))


@query("w39_portfolio_path_held", statement(f"SELECT fund, date, {r('equity')} FROM path_held", "path_held"))
def _portfolio_held(spark, sf_dir):
    return rounded(_path(spark, sf_dir, "None", 0.0))


@query("w40_bench_equity", statement(f"SELECT fund, date, {r('equity')} FROM beq", "beq"))
def _bench_equity(spark, sf_dir):
    return rounded(_benches(spark, sf_dir))


@query("w41_drawdown_series", statement(f"""SELECT fund, date, {r('drawdown')} FROM (SELECT fund, date, equity /
  max(equity) OVER (PARTITION BY fund ORDER BY date) - 1 AS drawdown FROM eq)""", "eq"))
def _drawdown(spark, sf_dir):
    return rounded(bt.drawdown_series(_equity(spark, sf_dir)).select("fund", "date", "drawdown"))


@query("a33_max_drawdown", statement(f"""SELECT fund, {r('max_drawdown')} FROM (SELECT fund, min(d) AS max_drawdown FROM (
  SELECT fund, equity / max(equity) OVER (PARTITION BY fund ORDER BY date) - 1 AS d FROM eq) GROUP BY fund)""", "eq"))
def _max_dd(spark, sf_dir):
    return rounded(bt.max_drawdown(_equity(spark, sf_dir)))


@query("w42_rolling_12m", statement("""SELECT fund, date, round(roll + 1e-9, 4) + 0.0 AS roll FROM (SELECT fund, date, (equity /
  nullif(lag(equity, 252) OVER (PARTITION BY fund ORDER BY date), 0) - 1) * 100 AS roll FROM eq) WHERE roll IS NOT NULL""", "eq"))
def _roll(spark, sf_dir):
    return rounded(bt.rolling_12m(_equity(spark, sf_dir)).select("fund", "date", "roll"), roll=4)


def _period_sql(src_block: str, value: str, label: str, gap: str) -> str:
    return f"""SELECT fund, period, ret FROM (SELECT fund, period, CASE WHEN lag(period) OVER w = {gap} THEN
      v / nullif(lag(v) OVER w, 0) - 1 END AS ret FROM (SELECT fund, {label} AS period, arg_max({value}, date) AS v
      FROM {src_block} GROUP BY 1, 2) WINDOW w AS (PARTITION BY fund ORDER BY period)) WHERE ret IS NOT NULL"""


_PREV_MONTH = "last_day(CAST(date_trunc('month', period) AS DATE) - 1)"
block("monthly_ret", ["eq"], _period_sql("eq", "equity", "last_day(date)", _PREV_MONTH))
block("yearly_ret", ["eq"], _period_sql("eq", "equity", "year(date)", "period - 1"))
block("bench_month", ["beq_on"], _period_sql("beq_on", "bench", "last_day(date)", _PREV_MONTH))


def _monthly(spark, sf_dir):
    return bt.period_returns(_equity(spark, sf_dir), "month")


@query("a28_monthly_returns", statement(f"SELECT fund, period, {r('ret')} FROM monthly_ret", "monthly_ret"))
def _monthly_returns(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir))


@query("a28_yearly_returns", statement(f"SELECT fund, CAST(period AS BIGINT) AS period, {r('ret')} FROM yearly_ret", "yearly_ret"))
def _yearly_returns(spark, sf_dir):
    df = bt.period_returns(_equity(spark, sf_dir), "year")
    return rounded(df.withColumn("period", F.col("period").cast("bigint")))


@query("a29_positive_months", statement(f"""SELECT fund, {r('positive_share')} FROM (SELECT fund,
  avg(CAST(ret > 0 AS INT)) AS positive_share FROM monthly_ret GROUP BY fund)""", "monthly_ret"))
def _positive(spark, sf_dir):
    return rounded(bt.positive_months(_monthly(spark, sf_dir)))


@query("a30_var_cvar", statement(f"""SELECT fund, {r('var95', 'cvar95')} FROM (SELECT fund, max(v) AS var95,
  coalesce(avg(ret) FILTER (ret <= v), max(v)) AS cvar95 FROM monthly_ret JOIN (SELECT fund, quantile_cont(ret, 0.05) AS v
  FROM monthly_ret GROUP BY fund) USING (fund) GROUP BY fund)""", "monthly_ret"))
def _var(spark, sf_dir):
    return rounded(bt.var_cvar(_monthly(spark, sf_dir)))


@query("j12_fund_bench_pair", statement(f"""SELECT fund, period, {r('fund_ret', 'bench_ret')} FROM (SELECT m.fund, period,
  m.ret AS fund_ret, b.ret AS bench_ret FROM monthly_ret m JOIN bench_month b USING (fund, period))""",
    "monthly_ret", "bench_month"))
def _pairs(spark, sf_dir):
    eq = src.stored(_equity(spark, sf_dir), "equity")
    bench = bt.period_returns(_bench_on(spark, sf_dir, eq), "month", "bench")
    return rounded(bt.fund_bench_pairs(bt.period_returns(eq, "month"), bench))


@query("a31_capture_ratios", statement(f"""SELECT fund, {r('up_capture', 'down_capture')} FROM (SELECT m.fund,
  avg(m.ret) FILTER (b.ret > 0) / nullif(avg(b.ret) FILTER (b.ret > 0), 0) AS up_capture,
  avg(m.ret) FILTER (b.ret < 0) / nullif(avg(b.ret) FILTER (b.ret < 0), 0) AS down_capture
  FROM monthly_ret m JOIN bench_month b USING (fund, period) GROUP BY m.fund)""", "monthly_ret", "bench_month"))
def _capture(spark, sf_dir):
    eq = src.stored(_equity(spark, sf_dir), "equity")
    bench = bt.period_returns(_bench_on(spark, sf_dir, eq), "month", "bench")
    return rounded(bt.capture_ratios(bt.fund_bench_pairs(bt.period_returns(eq, "month"), bench)))


block("eqret", ["eq"], "SELECT *, equity / lag(equity) OVER (PARTITION BY fund ORDER BY date) - 1 AS ret FROM eq")
_YEARS = "(max(date) - min(date)) / 365.25::DOUBLE"
_CAGR = f"pow(arg_max(equity, date) / arg_min(equity, date), 1 / ({_YEARS})) - 1"


@query("a32_perf_kpis", statement(f"""SELECT fund, round(final_value + 1e-9, 4) AS final_value,
  {r('total_return', 'cagr', 'vol', 'sharpe')} FROM (SELECT fund, arg_max(equity, date) * {START} AS final_value,
  arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, {_CAGR} AS cagr, stddev_samp(ret) * sqrt(252) AS vol,
  (avg(ret) - {RF} / 252) / stddev_samp(ret) * sqrt(252) AS sharpe FROM eqret GROUP BY fund)""", "eqret"))
def _kpis(spark, sf_dir):
    return rounded(bt.perf_kpis(_equity(spark, sf_dir), START, RF), final_value=4)


@query("a34_beta_alpha", statement(f"""SELECT fund, {r('beta', 'alpha')} FROM (SELECT fund, beta, (mr - {RF} / 252 - beta *
  (mb - {RF} / 252)) * 252 AS alpha FROM (SELECT fund, covar_samp(ret, b) / nullif(var_samp(b), 0) AS beta, avg(ret) AS mr,
  avg(b) AS mb FROM eqret JOIN (SELECT fund, date, bench / lag(bench) OVER (PARTITION BY fund ORDER BY date) - 1 AS b
  FROM beq_on) USING (fund, date) WHERE ret IS NOT NULL AND b IS NOT NULL GROUP BY fund HAVING count(*) >= 20))""",
    "eqret", "beq_on"))
def _beta(spark, sf_dir):
    eq = src.stored(_equity(spark, sf_dir), "equity")
    return rounded(bt.beta_alpha(eq, _bench_on(spark, sf_dir, eq), RF))


@query("a35_sortino", statement(f"""SELECT fund, {r('sortino')} FROM (SELECT fund, (avg(ret) - {RF} / 252) * 252 /
  (stddev_samp(ret) FILTER (ret < {RF} / 252) * sqrt(252)) AS sortino FROM eqret GROUP BY fund)""", "eqret"))
def _sortino(spark, sf_dir):
    return rounded(bt.sortino(_equity(spark, sf_dir), RF))


@query("a36_calmar", statement(f"""SELECT fund, {r('calmar')} FROM (SELECT fund, ({_CAGR}) / abs(min(d)) AS calmar FROM (
  SELECT *, equity / max(equity) OVER (PARTITION BY fund ORDER BY date) - 1 AS d FROM eq) GROUP BY fund)""", "eq"))
def _calmar(spark, sf_dir):
    return rounded(bt.calmar(_equity(spark, sf_dir)))


@query("u03_missing_holdings", statement(
    "SELECT fund, ticker, weight FROM fh_hold WHERE ticker NOT IN (SELECT ticker FROM calm)", "fh_hold", "calm"))
def _missing(spark, sf_dir):
    return up.missing_holdings(_holdings(spark), src.calm_bars(spark, sf_dir))


@query("u04_present_holdings", statement(
    "SELECT fund, ticker, weight FROM fh_hold WHERE ticker IN (SELECT ticker FROM calm)", "fh_hold", "calm"))
def _present(spark, sf_dir):
    return up.present_holdings(_holdings(spark), src.calm_bars(spark, sf_dir))


# -- outcome paths and investors ------------------------------------------------------------------------------------------

block("paths", ["weekly"], """SELECT ticker AS sim_id, row_number() OVER (PARTITION BY ticker ORDER BY date) AS step,
  100 * close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS value FROM weekly""")


def _paths(spark, sf_dir):
    from tidemark.functions.windows import series

    o = series()
    return src.weekly_bars(spark, sf_dir).select(
        F.col("ticker").alias("sim_id"), F.row_number().over(o).cast("bigint").alias("step"),
        (100 * F.col("close") / F.first("close").over(o)).alias("value"))


@query("a39_path_bands", statement("SELECT step, " + ", ".join(
    f"round(quantile_cont(value, {p / 100}) + 1e-9, 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM paths GROUP BY step", "paths"))
def _bands(spark, sf_dir):
    return rounded(ad.path_bands(_paths(spark, sf_dir)))


@query("a39_path_outcomes", statement(f"""SELECT count(*) AS paths, round(avg(CAST(f >= 120 AS INT)) + 1e-9, 6) AS goal_share,
  round(avg(CAST(f >= 200 AS INT)) + 1e-9, 6) AS double_share FROM (SELECT arg_max(value, step) AS f FROM paths GROUP BY sim_id)""",
    "paths"))
def _outcomes(spark, sf_dir):
    return rounded(ad.path_outcomes(_paths(spark, sf_dir), 120.0, 100.0))


@query("a39_final_histogram", statement("""SELECT CAST(least(floor((f - lo) / ((hi - lo) / 60)), 59) AS INT) AS bin,
  count(*) AS n FROM (SELECT f, min(f) OVER () AS lo, max(f) OVER () AS hi FROM (SELECT arg_max(value, step) AS f FROM paths
  GROUP BY sim_id)) GROUP BY 1""", "paths"))
def _final_histogram(spark, sf_dir):
    from tidemark.operators.charts import histogram

    return histogram(ad.path_finals(_paths(spark, sf_dir)), "final", 60).select("bin", "n")


block("points", ["investors"], """SELECT *, CAST(greatest(1, least(5, round_even(points, 0))) AS INT) AS risk_profile FROM (
  SELECT *, 3.0::DOUBLE + (loss_tolerance_pct - 20) * 0.055::DOUBLE + (investment_horizon - 12) * 0.045::DOUBLE
  - (age - 40) * 0.025::DOUBLE + investment_experience * 0.35::DOUBLE - dependents * 0.18::DOUBLE
  + ((annual_income - min(annual_income) OVER ()) / (max(annual_income) OVER () - min(annual_income) OVER () + 1) - 0.5) * 0.8::DOUBLE
  + CASE marital_status WHEN 'single' THEN 0.15::DOUBLE WHEN 'widowed' THEN -0.2::DOUBLE ELSE 0 END
  + CASE employment_type WHEN 'retired' THEN -0.3::DOUBLE WHEN 'variable' THEN -0.1::DOUBLE ELSE 0 END AS points FROM investors)""")


@query("a42_risk_points", statement(f"SELECT c_custkey, {r('points')}, risk_profile FROM points", "points"))
def _points(spark, sf_dir):
    return rounded(ad.risk_points(src.investors(spark, sf_dir)).select("c_custkey", "points", "risk_profile"))


def _labelled(spark, sf_dir):
    return ad.spread(src.stored(ad.risk_points(src.investors(spark, sf_dir)).drop("points"), "labelled"))


@query("a43_risk_classifier")
def _classifier(spark, sf_dir):
    scored = ad.cross_fitted(_labelled(spark, sf_dir), "c_custkey")
    return scored.select("c_custkey", "risk_profile", "label", "confidence", *[f"p_{k}" for k in ad.RISK_LABELS])


@query("a43_risk_validation")
def _classifier_validation(spark, sf_dir):
    """Cross-validated accuracy, and the importance of each feature to a forest of all customers."""
    labelled = _labelled(spark, sf_dir)
    accuracy, forest = ad.cross_validated(labelled)
    rows = [("accuracy", "cross-validated", accuracy), *[("importance", *pair) for pair in ad.feature_importance(forest)]]
    return spark.createDataFrame(rows, "measure string, name string, value double")


@query("a43_risk_quality", """SELECT count(*) AS scored, count(*) AS sums_to_one, count(*) AS likeliest_is_label, true AS accurate
  FROM customer""")
def _classifier_quality(spark, sf_dir):
    """Checks over all customers, each scored by a forest that has not seen it: it has to beat naming the commonest profile."""
    labelled = _labelled(spark, sf_dir)
    shares = labelled.groupBy("risk_profile").agg(F.count(F.lit(1)).alias("n"))
    commonest = shares.agg(F.try_divide(F.max("n"), F.sum("n"))).first()[0] or 0.0
    scored = ad.cross_fitted(labelled, "c_custkey")
    truth = labelled.select("c_custkey", F.col("risk_profile").alias("truth"))
    shares = [F.col(f"p_{k}") for k in ad.RISK_LABELS]
    best = F.element_at(F.array(*shares), F.array_position(F.array(*[F.lit(k) for k in ad.RISK_LABELS]), F.col("risk_profile")).cast("int"))
    return scored.join(truth, "c_custkey").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.abs(sum(shares[1:], shares[0]) - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(best == F.greatest(*shares)).alias("likeliest_is_label"),
        (F.avg((F.col("risk_profile") == F.col("truth")).cast("double")) > F.lit(commonest)).alias("accurate"))


@query("a44_allocation_rollup", f"""SELECT fund, CASE WHEN w < 0.03 THEN 'Others' ELSE ticker END AS holding,
  round(sum(w) + 1e-9, 6) AS weight FROM (SELECT p_type AS fund, p_brand AS ticker, sum(l_extendedprice) / sum(sum(l_extendedprice))
  OVER (PARTITION BY p_type) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1, 2""")
def _rollup(spark, sf_dir):
    part = src.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("fund"), F.col("p_brand").alias("ticker"))
    sold = src.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "fund", "ticker").agg(F.sum("l_extendedprice").alias("v"))
    total = sold.groupBy("fund").agg(F.sum("v").alias("t"))
    weights = sold.join(total, "fund").select("fund", "ticker", (F.col("v") / F.col("t")).alias("weight"))
    return rounded(ad.allocation_rollup(weights))


_FUND_VALUES = "(VALUES " + ", ".join(f"({i}, '{f[0]}', {f[1]}, {f[2]})" for i, f in enumerate(ad.FUNDS)) + ") f(place, fund, lo, hi)"


@query("j11_recommend_funds", statement(f"""SELECT * FROM (WITH asked AS (SELECT c_custkey, points AS score FROM points),
  fit AS (SELECT c_custkey, score, fund FROM asked JOIN {_FUND_VALUES} ON score BETWEEN lo AND hi)
  SELECT c_custkey, round(score + 1e-9, 6) + 0.0 AS score, fund FROM (SELECT * FROM fit UNION ALL SELECT c_custkey, score,
  arg_min(fund, ROW(least(abs(lo - score), abs(hi - score)), place)) FROM asked CROSS JOIN {_FUND_VALUES}
  WHERE c_custkey NOT IN (SELECT c_custkey FROM fit) GROUP BY 1, 2))""", "points"))
def _recommend(spark, sf_dir):
    asked = ad.risk_points(src.investors(spark, sf_dir)).select("c_custkey", F.col("points").alias("score"))
    return rounded(ad.recommend_funds(asked, "score").select("c_custkey", "score", "fund"))
