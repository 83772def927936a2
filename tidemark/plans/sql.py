"""SQL building blocks for the side-by-side checks.

A block is a named common table expression with the names it needs; ``statement`` collects them in order.
"""

from __future__ import annotations

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: list[str], body: str) -> str:
    BLOCKS[name] = (needs, body)
    return name


def statement(select: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in BLOCKS[name][0]:
            add(other)
        order.append(name)

    for name in needs:
        add(name)
    if not order:
        return select
    recursive = any(f"FROM {n}" in BLOCKS[n][1] or f"JOIN {n} " in BLOCKS[n][1] for n in order)
    parts = []
    for n in order:
        self_ref = f"FROM {n}" in BLOCKS[n][1] or f"JOIN {n} " in BLOCKS[n][1]
        parts.append(f"{n} AS {'' if self_ref else 'MATERIALIZED '}({BLOCKS[n][1]})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def r(*columns: str, digits: int = 6) -> str:
    """Select list of rounded doubles; the tiny shift keeps exact ties (prices over 32) off the rounding edge."""
    return ", ".join(f"round({c} + 1e-9, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def _bars(ticker: str, date: str, tier: str) -> str:
    return f"""
SELECT ticker, date, open, high, low, close, close AS adj_close, volume, {tier} AS cap_category FROM (
  SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(qty) AS volume
  FROM (SELECT {ticker} AS ticker, {date} AS date, l_extendedprice / l_quantity AS px, l_quantity AS qty,
               ROW(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY ticker, date)"""


_BRAND_TIER = """CASE WHEN CAST(substr(ticker, 7) AS INT) <= 9 THEN 'LARGE'
  WHEN CAST(substr(ticker, 7) AS INT) <= 17 THEN 'MID' ELSE 'SMALL' END"""
_DAY = "CAST(l_shipdate AS DATE)"
# Friday on or after the day: isodow is 1 for Monday .. 7 for Sunday.
FRIDAY = "CAST({0} + CAST((12 - isodow({0})) % 7 AS INT) AS DATE)"
block("bars", [], _bars("p_brand", _DAY, _BRAND_TIER))
block("weekly", [], _bars("p_brand", FRIDAY.format(_DAY), _BRAND_TIER))
block("dense", [], _bars("p_type", _DAY, """CASE WHEN ticker IN ('ECONOMY', 'LARGE') THEN 'LARGE'
  WHEN ticker IN ('MEDIUM', 'PROMO') THEN 'MID' ELSE 'SMALL' END"""))
block("calm", ["dense"], "SELECT * REPLACE (100 + sqrt(close) / 30 AS close) FROM dense")
block("macro", [], """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date,
  avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""")
block("monthly", [], """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date,
  avg(o_totalprice) AS value FROM orders GROUP BY 1""")
block("investors", [], """SELECT c_custkey, 22 + c_custkey % 54 AS age, 20000 + 50 * abs(c_acctbal) AS annual_income,
  c_custkey % 6 AS dependents, 1 + c_custkey % 35 AS investment_horizon, 2 + c_custkey % 54 AS loss_tolerance_pct,
  c_custkey % 4 AS investment_experience,
  CASE c_custkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'married' WHEN 2 THEN 'divorced' ELSE 'widowed' END AS marital_status,
  CASE c_custkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'variable' ELSE 'retired' END AS employment_type
  FROM customer""")


def rolled(agg: str, x: str, n: int, need: int | None = None, part: str = "ticker", order: str = "date") -> str:
    frame = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n if need is None else need} THEN {agg}({x}) {frame} END"


def lagged(x: str, k: int, part: str = "ticker", order: str = "date") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def changed(x: str, k: int, part: str = "ticker", order: str = "date") -> str:
    return f"({x} / nullif({lagged(x, k, part, order)}, 0) - 1)"


def modules(src: str, bench: str | None = None) -> dict[str, str]:
    """Blocks of the five metric modules over the bars block ``src``; gives their names.

    ``bench`` is a benchmark ticker; without it the LARGE tier is the benchmark.
    """
    p = f"{src}_{'t' if bench else 'm'}"
    name = {m: f"{p}_{m}" for m in ("returns", "risk", "momentum", "zscore", "technical")}
    if name["returns"] in BLOCKS:
        return name
    cols = ", ".join(f"{changed('close', k)} AS ret_{k}d" for k in (1, 5, 21, 63, 126, 252))
    block(name["returns"], [src], f"""SELECT ticker, date, {cols},
      ln(close / nullif({lagged('close', 1)}, 0)) AS log_ret_1d, count(*) OVER (PARTITION BY ticker) AS n_bars
      FROM {src} QUALIFY n_bars >= 2""")
    # risk
    block(f"{p}_ret", [src], f"SELECT ticker, date, close, {changed('close', 1)} AS ret FROM {src}")
    if bench:
        block(f"{p}_bret", [f"{p}_ret"], f"SELECT date, ret AS b FROM {p}_ret WHERE ticker = '{bench}'")
    else:
        block(f"{p}_lcal", [src], f"""SELECT date, row_number() OVER (ORDER BY date) AS di FROM
          (SELECT DISTINCT date FROM {src} WHERE cap_category = 'LARGE')""")
        block(f"{p}_bret", [src, f"{p}_lcal"], f"""SELECT a.date, avg(a.close / nullif(b.close, 0) - 1) AS b FROM
          (SELECT * FROM {src} JOIN {p}_lcal USING (date) WHERE cap_category = 'LARGE') a LEFT JOIN
          (SELECT * FROM {src} JOIN {p}_lcal USING (date) WHERE cap_category = 'LARGE') b
          ON a.ticker = b.ticker AND a.di = b.di + 1 GROUP BY a.date""")
    block(f"{p}_num", [src], f"""SELECT ticker, date, close,
      row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM {src}""")
    block(f"{p}_dd", [f"{p}_num"], f"""SELECT ticker, date, min(v) AS max_dd_252d FROM (
      SELECT a.ticker, a.date, b.close / max(b.close) OVER (PARTITION BY a.ticker, a.n ORDER BY b.n) - 1 AS v
      FROM {p}_num a JOIN {p}_num b ON a.ticker = b.ticker AND b.n BETWEEN a.n - 252 AND a.n WHERE a.n > 252)
      GROUP BY ticker, date""")
    fr = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    block(f"{p}_beta", [f"{p}_ret", f"{p}_bret"], f"""SELECT ticker, date, beta AS beta_252d,
      (mr - beta * mb) * 252 AS alpha_252d FROM (SELECT ticker, date, mr, mb, CASE WHEN n = 252 AND vb >= 1e-12
      THEN cv / vb END AS beta FROM (SELECT ticker, date, avg(ret) {fr} AS mr, avg(b) {fr} AS mb,
      count(*) {fr} AS n, var_samp(b) {fr} AS vb, covar_samp(ret, b) {fr} AS cv
      FROM {p}_ret JOIN {p}_bret USING (date) WHERE ret IS NOT NULL AND b IS NOT NULL))""")
    s = {n: rolled("stddev_samp", "ret", n) for n in (21, 63, 252)}
    m = {n: rolled("avg", "ret", n) for n in (21, 63, 252)}
    f252 = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    block(name["risk"], [f"{p}_ret", f"{p}_dd", f"{p}_beta"], f"""SELECT x.* EXCLUDE (nret), max_dd_252d, beta_252d, alpha_252d
      FROM (SELECT ticker, date, {s[21]} * sqrt(252) AS vol_21d, {s[63]} * sqrt(252) AS vol_63d,
      {s[252]} * sqrt(252) AS vol_252d, {m[63]} / nullif({s[63]}, 0) * sqrt(252) AS sharpe_63d,
      {m[252]} / nullif({s[252]}, 0) * sqrt(252) AS sharpe_252d,
      {m[252]} / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END) {f252}, 0) * sqrt(252) AS sortino_252d,
      {m[21]} - 1.645 * {s[21]} AS var_95_21d, {m[21]} - 2.063 * {s[21]} AS cvar_95_21d,
      count(ret) OVER (PARTITION BY ticker) AS nret FROM {p}_ret) x
      LEFT JOIN {p}_dd USING (ticker, date) LEFT JOIN {p}_beta USING (ticker, date) WHERE nret >= 22""")
    # momentum
    member = f"ticker = '{bench}'" if bench else "cap_category = 'LARGE'"
    block(f"{p}_bpx", [src], f"""SELECT date, px, px / nullif(lag(px, 252) OVER (ORDER BY date), 0) - 1 AS chg FROM (
      SELECT d.date, last_value(v IGNORE NULLS) OVER (ORDER BY d.date) AS px FROM (SELECT DISTINCT date FROM {src}) d
      LEFT JOIN (SELECT date, avg(close) AS v FROM {src} WHERE {member} GROUP BY date) b USING (date))""")
    block(name["momentum"], [src, f"{p}_bpx"], f"""SELECT *,
      CAST(rank() OVER (PARTITION BY date ORDER BY mom_12m DESC NULLS LAST) AS INT) AS rank_universe FROM (
      SELECT ticker, date, mom_1m, mom_3m, mom_6m, mom_12m, mom_12m_skip1m, roc_20d, roc_60d, hi_52w_pct, lo_52w_pct,
      (1 + mom_12m) / nullif(1 + nullif(chg, 0), 0) AS rs_vs_bench FROM (SELECT ticker, date,
      {changed('close', 21)} AS mom_1m, {changed('close', 63)} AS mom_3m, {changed('close', 126)} AS mom_6m,
      {changed('close', 252)} AS mom_12m,
      {lagged('close', 21)} / nullif({lagged('close', 252)}, 0) - 1 AS mom_12m_skip1m,
      {changed('close', 20)} * 100 AS roc_20d, {changed('close', 60)} * 100 AS roc_60d,
      (close / nullif({rolled('max', 'close', 252)}, 0) - 1) * 100 AS hi_52w_pct,
      (close / nullif({rolled('min', 'close', 252)}, 0) - 1) * 100 AS lo_52w_pct,
      count(*) OVER (PARTITION BY ticker) AS bars FROM {src}) LEFT JOIN {p}_bpx USING (date) WHERE bars >= 22)""")
    # zscore
    block(f"{p}_cal", [src], f"""SELECT ticker, b.date, close, volume, di FROM {src} b JOIN (
      SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM {src})) USING (date)""")

    def z(x: str, n: int) -> str:
        return f"({x} - {rolled('avg', x, n)}) / nullif({rolled('stddev_samp', x, n)}, 0)"

    def back(n: int) -> str:
        return f"OVER (PARTITION BY ticker ORDER BY di RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    block(f"{p}_sig", [f"{p}_cal"], f"""SELECT a.ticker, a.date, a.close / nullif(p1.close, 0) - 1 AS cs_ret,
      a.close / nullif(CASE WHEN c20 = 20 THEN m20 END, 0) - 1 AS cs_gap,
      a.volume / nullif(CASE WHEN c21 = 21 THEN v21 END, 0) AS cs_volume,
      a.close / nullif(p63.close, 0) - 1 AS cs_mom
      FROM (SELECT *, count(close) {back(20)} AS c20, avg(close) {back(20)} AS m20,
            count(volume) {back(21)} AS c21, avg(volume) {back(21)} AS v21 FROM {p}_cal) a
      LEFT JOIN {p}_cal p1 ON p1.ticker = a.ticker AND p1.di = a.di - 1
      LEFT JOIN {p}_cal p63 ON p63.ticker = a.ticker AND p63.di = a.di - 63""")

    def cs(x: str) -> str:
        return f"({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"

    def pct(x: str) -> str:
        return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + "
                f"(count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) * 100 END")

    block(name["zscore"], [src, f"{p}_ret", f"{p}_sig"], f"""SELECT * FROM (
      SELECT ticker, date, {z('close', 21)} AS z_price_21d, {z('close', 63)} AS z_price_63d,
      {z('volume', 21)} AS z_volume_21d, {z('ret', 21)} AS z_ret_21d
      FROM {src} JOIN (SELECT ticker, date, ret FROM {p}_ret) USING (ticker, date)) LEFT JOIN (
      SELECT ticker, date, {cs('cs_ret')} AS z_cs_ret_1d, {cs('cs_gap')} AS z_cs_price_vs_ma20,
      {cs('cs_volume')} AS z_cs_volume, {pct('cs_ret')} AS pct_ret_1d, {pct('cs_mom')} AS pct_mom_3m
      FROM {p}_sig) USING (ticker, date)""")
    # technical
    ema = ema_blocks(p, src, "close")
    up, mid, low = _bands("close")
    block(name["technical"], [src, ema], f"""SELECT ticker, date, CASE WHEN n > 14 THEN rsi END AS rsi_14,
      bb_upper, bb_mid, bb_lower, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct_b,
      nullif(bb_upper - bb_lower, 0) / nullif(bb_mid, 0) AS bb_width, macd_line, macd_signal, macd_hist,
      bb_mid AS ma_20, ma_50, ma_200, (close / nullif(ma_50, 0) - 1) * 100 AS pct_vs_ma50,
      (close / nullif(ma_200, 0) - 1) * 100 AS pct_vs_ma200, coalesce(ma_50 > ma_200, false) AS golden_cross,
      CASE WHEN n >= 14 THEN atr END AS atr_14, obv FROM (SELECT ticker, date, close,
      {up} AS bb_upper, {mid} AS bb_mid, {low} AS bb_lower, {rolled('avg', 'close', 50)} AS ma_50,
      {rolled('avg', 'close', 200)} AS ma_200, sum(flow) OVER (PARTITION BY ticker ORDER BY date) AS obv, bars
      FROM (SELECT *, coalesce(sign(close - {lagged('close', 1)}), 0) * coalesce(volume, 0) AS flow,
      count(close) OVER (PARTITION BY ticker) AS bars FROM {src})) JOIN {ema} USING (ticker, date) WHERE bars >= 21""")
    return name


def _bands(x: str) -> tuple[str, str, str]:
    mid, std = rolled("avg", x, 20), rolled("stddev_samp", x, 20)
    return f"{mid} + 2 * {std}", mid, f"{mid} - 2 * {std}"


def ema_blocks(p: str, src: str, price: str) -> str:
    """Step through every series row by row: n, rsi, macd_line, macd_signal, macd_hist, atr (unguarded)."""
    pc = lagged(price, 1)
    block(f"{p}_estep", [src], f"""SELECT ticker, date, {price} AS c,
      row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, greatest({price} - {pc}, 0) AS g,
      greatest({pc} - {price}, 0) AS l, greatest(high - low, abs(high - {pc}), abs(low - {pc})) AS tr FROM {src}""")
    block(f"{p}_ewalk", [f"{p}_estep"], f"""SELECT ticker, date, n, c, CAST(NULL AS DOUBLE) AS ag,
      CAST(NULL AS DOUBLE) AS al, tr AS atr, c AS e12, c AS e26, CAST(0 AS DOUBLE) AS sig FROM {p}_estep WHERE n = 1
      UNION ALL SELECT s.ticker, s.date, s.n, s.c,
      CASE WHEN w.ag IS NULL THEN s.g ELSE w.ag * (1 - 1 / 14.0::DOUBLE) + s.g * (1 / 14.0::DOUBLE) END,
      CASE WHEN w.al IS NULL THEN s.l ELSE w.al * (1 - 1 / 14.0::DOUBLE) + s.l * (1 / 14.0::DOUBLE) END,
      w.atr * (1 - 1 / 14.0::DOUBLE) + s.tr * (1 / 14.0::DOUBLE),
      w.e12 * (1 - 2 / 13.0::DOUBLE) + s.c * (2 / 13.0::DOUBLE), w.e26 * (1 - 2 / 27.0::DOUBLE) + s.c * (2 / 27.0::DOUBLE),
      w.sig * (1 - 0.2::DOUBLE) + (w.e12 * (1 - 2 / 13.0::DOUBLE) + s.c * (2 / 13.0::DOUBLE)
        - w.e26 * (1 - 2 / 27.0::DOUBLE) - s.c * (2 / 27.0::DOUBLE)) * 0.2::DOUBLE
      FROM {p}_ewalk w JOIN {p}_estep s ON s.ticker = w.ticker AND s.n = w.n + 1""")
    return block(f"{p}_ema", [f"{p}_ewalk"], f"""SELECT ticker, date, n,
      100 - 100 / (1 + ag / nullif(al, 0)) AS rsi, e12 - e26 AS macd_line, sig AS macd_signal,
      e12 - e26 - sig AS macd_hist, atr / nullif(c, 0) AS atr FROM {p}_ewalk""")
