"""Queries that go beyond a profile: continuity, relationships, anomalies, contributions, explanation, parsing, outliers, chunks."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import anomalies as ano
from tidemark.operators import continuity as con
from tidemark.operators import contribution as ctr
from tidemark.operators import explain as exp
from tidemark.operators import outliers as out
from tidemark.operators import parsing as par
from tidemark.operators import relations as rel
from tidemark.operators.chunks import chunk_texts
from tidemark.operators.upsert import union_all
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import block, r, statement
from tidemark.sources import tables as src

AS_OF = dt.date(2001, 11, 5)

# -- date continuity -----------------------------------------------------------------------------------------------------


def _continuity_blocks(p: str, rows: str, key: str, date: str, calendar: str, *needs: str) -> None:
    block(f"{p}_own", list(needs), f"SELECT DISTINCT {key} AS {key}, CAST({date} AS DATE) AS date FROM {rows} WHERE {key} IS NOT NULL AND {date} IS NOT NULL")
    block(f"{p}_cal", [f"{p}_own"], f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM ({calendar})")
    block(f"{p}_steps", [f"{p}_own", f"{p}_cal"], f"""SELECT *, coalesce(di - lag(di) OVER w - 1, 0) AS gap, lag(date) OVER w AS before
      FROM {p}_own JOIN {p}_cal USING (date) WINDOW w AS (PARTITION BY {key} ORDER BY di)""")
    block(f"{p}_runs", [f"{p}_steps"], f"""SELECT {key}, run, count(*) AS length, min(date) AS first, max(date) AS last, max(di) AS di, max(gap) AS gap,
      arg_min(CASE WHEN gap > 0 THEN before END, di) AS before FROM (SELECT *, sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY {key} ORDER BY di) AS run FROM {p}_steps) GROUP BY ALL""")


def _continuity_sql(p: str, key: str) -> str:
    return statement(f"""SELECT {key}, CAST(sum(length) AS BIGINT) AS dates, min(first) AS first_date, max(last) AS last_date, count(*) AS runs,
      CAST(sum(gap) AS BIGINT) AS missing, round(sum(length) / (sum(length) + sum(gap)), 6) AS coverage, max(length) AS longest_run,
      max(gap) AS longest_gap, arg_max(before, (gap, -epoch(first))) FILTER (gap > 0) AS gap_after,
      arg_max(first, (gap, -epoch(first))) FILTER (gap > 0) AS gap_until,
      greatest((SELECT max(di) FROM {p}_cal WHERE date <= DATE '{AS_OF}') - max(di), 0) AS behind,
      greatest((SELECT max(di) FROM {p}_cal WHERE date <= DATE '{AS_OF}') - max(di), 0) > 5 AS stale
      FROM {p}_runs GROUP BY {key}""", f"{p}_runs")


_continuity_blocks("barc", "bars", "ticker", "date", "SELECT DISTINCT date FROM barc_own", "bars")
_continuity_blocks("serc", "orders", "o_orderpriority", "o_orderdate", """SELECT date FROM (SELECT CAST(unnest(generate_series(
  date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY)) AS DATE) AS date FROM serc_own) WHERE isodow(date) < 6""")


def _bar_presence(spark, sf_dir):
    return con.presence(src.bars(spark, sf_dir), "ticker")


@query("n01_date_continuity", _continuity_sql("barc", "ticker"))
def _bar_continuity(spark, sf_dir):
    found = src.stored(_bar_presence(spark, sf_dir), "presence")
    return con.continuity(found, con.shared_calendar(found), AS_OF)


@query("n01_series_continuity", _continuity_sql("serc", "o_orderpriority"))
def _series_continuity(spark, sf_dir):
    """Presence of the years is found apart and merged, as new files would be."""
    orders = src.table(spark, sf_dir, "orders")
    old = con.presence(orders.where(F.year("o_orderdate") < 1998), "o_orderpriority", "o_orderdate")
    new = con.presence(orders.where(F.year("o_orderdate") >= 1998), "o_orderpriority", "o_orderdate")
    found = src.stored(con.merge_presence(old, new), "presence")
    return con.continuity(found, con.weekday_calendar(found), AS_OF)


@query("n01_date_gaps", statement("SELECT ticker, before AS after, date AS before, gap AS missing FROM barc_steps WHERE gap > 0", "barc_steps"))
def _bar_gaps(spark, sf_dir):
    found = src.stored(_bar_presence(spark, sf_dir), "presence")
    return con.gaps(found, con.shared_calendar(found))


@query("n01_missing_by_month", statement("""SELECT s.ticker, CAST(date_trunc('month', c.date) AS DATE) AS month, CAST(count(*) AS INT) AS expected,
  CAST(count(o.date) AS INT) AS present, CAST(count(*) - count(o.date) AS INT) AS missing
  FROM (SELECT ticker, min(date) AS lo, max(date) AS hi FROM barc_own GROUP BY ticker) s JOIN barc_cal c ON c.date BETWEEN s.lo AND s.hi
  LEFT JOIN barc_own o ON o.ticker = s.ticker AND o.date = c.date GROUP BY 1, 2""", "barc_own", "barc_cal"))
def _bar_months(spark, sf_dir):
    found = src.stored(_bar_presence(spark, sf_dir), "presence")
    return con.missing_by_month(found, con.shared_calendar(found))


# -- relationships -------------------------------------------------------------------------------------------------------

# Comparable columns of the given tables: n whole numbers, s texts.
COMPARED = {
    "region": "r_regionkey:n r_name:s", "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_mktsegment:s", "supplier": "s_suppkey:n s_name:s s_nationkey:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n", "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_returnflag:s l_linestatus:s",
    "events": "event_id:n user_id:n event_type:s props:s", "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n label:n", "pages": "page_id:n url:s html:s", "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n", "conversations": "conv_id:n turn:n role:s text:s",
}
_COMPARED = [(t, *c.split(":")) for t, spec in COMPARED.items() for c in spec.split()]


def _relations_sql() -> str:
    values = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, '{k}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n "
                                f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, c, k in _COMPARED)
    return f"""WITH v AS MATERIALIZED ({values}),
    sizes AS (SELECT tbl, col, kind, count(*) AS "values", CAST(sum(n) AS BIGINT) AS "rows", max(n) AS most FROM v GROUP BY ALL),
    held AS (SELECT a.tbl, a.col, b.tbl AS ref_tbl, b.col AS ref_col, count(*) AS contained FROM v a JOIN v b ON a.value = b.value AND a.kind = b.kind
      AND a.tbl <> b.tbl SEMI JOIN sizes k ON k.tbl = b.tbl AND k.col = b.col AND k.most = 1 GROUP BY ALL)
    SELECT h.tbl, h.col, ref_tbl, ref_col, s."values", contained, round(contained / s."values" + 1e-9, 6) + 0.0 AS containment,
      round(contained / k."values" + 1e-9, 6) + 0.0 AS coverage, s."rows", k."values" AS ref_values
    FROM held h JOIN sizes s ON s.tbl = h.tbl AND s.col = h.col JOIN sizes k ON k.tbl = ref_tbl AND k.col = ref_col
    WHERE contained / s."values" >= 0.95"""


@query("n02_relationships", _relations_sql())
def _relationships(spark, sf_dir):
    return rounded(rel.relationships({t: src.table(spark, sf_dir, t) for t in COMPARED}, threshold=0.95))


# -- anomaly timeline ------------------------------------------------------------------------------------------------------

# Order totals per day and priority, with two shifts and two single days planted.
_PLANTED = """CASE WHEN o_orderpriority = '2-HIGH' AND CAST(o_orderdate AS DATE) >= DATE '1998-06-01' THEN 150000
  WHEN o_orderpriority = '5-LOW' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-12-31' THEN 200000
  WHEN o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) IN (DATE '1997-07-04', DATE '1999-12-31') THEN 9000000 ELSE 0 END"""
block("points", [], f"""SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) + max({_PLANTED}) AS value
  FROM orders GROUP BY 1, 2""")
block("left0", ["points"], """SELECT *, units - CAST(floor(median(units) OVER (PARTITION BY series, season)) AS BIGINT) AS "left",
  median(units) OVER (PARTITION BY series, season) * 0.01 AS expected
  FROM (SELECT *, isodow(day) - 1 AS season, CAST(round(value / 0.01) AS BIGINT) AS units FROM points)""")
block("lefts", ["left0"], 'SELECT *, median(abs("left")) OVER (PARTITION BY series) AS scale FROM left0')


def _points(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    points = src.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), day.alias("at")).agg(
        (F.avg("o_totalprice") + F.max(F.expr(_PLANTED))).alias("value"))
    return ano.baseline(points, F.weekday("at"))


@query("n03_seasonal_outliers", statement(f"""SELECT series, day AS "at", {r('value', 'expected')}, round("left" / (1.4826::DOUBLE * scale) + 1e-9, 6) + 0.0 AS score
  FROM lefts WHERE abs("left" / (1.4826::DOUBLE * scale)) > 3""", "lefts"))
def _outliers(spark, sf_dir):
    return rounded(ano.outliers(_points(spark, sf_dir), sigmas=3.0))


def _shift_blocks(depth: int, sigmas: float, least: int) -> list[str]:
    block("seg1", ["lefts"], 'SELECT series, day, "left" AS x, scale, 0 AS part FROM lefts WHERE scale > 0')
    for k in range(1, depth + 1):
        block(f"cut{k}", [f"seg{k}"], f"""SELECT series, part, arg_max(day, (strength, -epoch(day))) AS day, max(strength) AS strength,
          arg_max(s1 / n1, (strength, -epoch(day))) AS before, arg_max((s - s1) / (n - n1), (strength, -epoch(day))) AS after, any_value(n) AS points, {k} AS level
          FROM (SELECT *, sqrt(greatest(CAST(s1 AS DOUBLE) * s1 / n1 + CAST(s - s1 AS DOUBLE) * (s - s1) / (n - n1) - CAST(s AS DOUBLE) * s / n, 0.0)) / (1.4826::DOUBLE * scale) AS strength
            FROM (SELECT *, CAST(coalesce(sum(x) OVER w, 0) AS BIGINT) AS s1, count(*) OVER w AS n1, CAST(sum(x) OVER (PARTITION BY series, part) AS BIGINT) AS s,
                count(*) OVER (PARTITION BY series, part) AS n FROM seg{k} WINDOW w AS (PARTITION BY series, part ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            WHERE n1 >= {least} AND n - n1 >= {least}) WHERE strength > {sigmas} GROUP BY series, part""")
        block(f"seg{k + 1}", [f"seg{k}", f"cut{k}"], f"""SELECT s.series, s.day, x, scale, s.part * 2 + CASE WHEN s.day >= c.day THEN 1 ELSE 0 END AS part
          FROM seg{k} s JOIN cut{k} c ON s.series = c.series AND s.part = c.part""")
    return [f"cut{k}" for k in range(1, depth + 1)]


_CUTS = _shift_blocks(4, 8.0, 20)


@query("n03_level_shifts", statement(" UNION ALL ".join(
    f"SELECT series, day AS \"at\", CAST(level AS INT) AS level, {r('before', 'after', 'strength', digits=4)}, points FROM {c}" for c in _CUTS), *_CUTS))
def _shifts(spark, sf_dir):
    return rounded(ano.level_shifts(_points(spark, sf_dir), sigmas=8.0, least=20, depth=4), 4)


# -- contribution ----------------------------------------------------------------------------------------------------------

DIMS = ["o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name"]
block("moved", [], """SELECT o_orderpriority, o_orderstatus, c_mktsegment, n_name, CAST(round(o_totalprice * 100) AS BIGINT) AS v,
  CASE year(o_orderdate) WHEN 1998 THEN 0 WHEN 1999 THEN 1 END AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")


def _lattice_sql(levels: int) -> str:
    sets = [some for n in range(levels + 1) for some in combinations(DIMS, n)]
    columns = ", ".join(f"CAST(NULL AS VARCHAR) AS {d}" for d in DIMS)
    one = lambda some: (
        f"SELECT CAST({len(some)} AS INT) AS level, '{','.join(some)}' AS dims, " + (", ".join(d if d in some else f"CAST(NULL AS VARCHAR) AS {d}" for d in DIMS) or columns)
        + ", count(*) FILTER (p = 0) AS n0, count(*) FILTER (p = 1) AS n1, CAST(coalesce(sum(v) FILTER (p = 0), 0) AS BIGINT) AS v0, "
        + "CAST(coalesce(sum(v) FILTER (p = 1), 0) AS BIGINT) AS v1 FROM moved WHERE p IS NOT NULL" + (f" GROUP BY {', '.join(some)}" if some else ""))
    return " UNION ALL ".join(map(one, sets))


block("lattice2", ["moved"], _lattice_sql(2))
block("lattice3", ["moved"], _lattice_sql(3))
_SPLIT = """SELECT *, change - volume AS rate FROM (SELECT *, v1 - v0 AS change,
  CASE WHEN n0 > 0 AND n1 > 0 THEN (n1 - n0) * (v0 / n0 + v1 / n1) / 2 ELSE CAST(v1 - v0 AS DOUBLE) END AS volume FROM {0})"""
_CELL = f"level, dims, {', '.join(DIMS)}, n0, n1, v0, v1, change, {r('volume', 'rate', digits=4)}"


def _moved(spark, sf_dir):
    nation = src.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = src.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = src.table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    period = F.when(F.year("o_orderdate") == 1998, 0).when(F.year("o_orderdate") == 1999, 1)
    return src.stored(ctr.cells(rows, DIMS, F.round(F.col("o_totalprice") * 100).cast("bigint"), period), "cells")


def _shown(df):
    return rounded(df.drop("up", "down"), 4)


@query("n04_contribution_levels", statement(f"SELECT {_CELL} FROM ({_SPLIT.format('lattice2')})", "lattice2"))
def _levels(spark, sf_dir):
    return _shown(ctr.lattice(_moved(spark, sf_dir), DIMS, 2))


@query("n04_top_contributions", statement(f"SELECT {_CELL} FROM ({_SPLIT.format('lattice3')}) WHERE level > 0 ORDER BY abs(change) DESC, level, dims, "
                                          + ", ".join(f"{d} NULLS FIRST" for d in DIMS) + " LIMIT 40", "lattice3"))
def _top(spark, sf_dir):
    return _shown(ctr.top_contributions(_moved(spark, sf_dir), DIMS, 3, 40))


# -- target explanation ------------------------------------------------------------------------------------------------------

def _explain_blocks(p: str, table: str, target: str, numbers: list[str], others: list[str], *needs: str, bins: int = 10) -> str:
    """Blocks for the contingency tables of one table; gives the select. ``others`` are taken as they are."""
    names = [c for c in [*numbers, *others] if c != target]
    cuts = ", ".join(f"quantile_cont({c}, {i / bins}) AS {c}_{i}" for c in numbers for i in range(1, bins))
    block(f"{p}_cuts", list(needs), f"SELECT {cuts or '1 AS one'} FROM {table}")
    bins_of = lambda c: "coalesce(CAST(CASE WHEN {0} IS NOT NULL THEN {1} END AS VARCHAR), '')".format(
        c, " + ".join(f"CASE WHEN {c} > {c}_{i} THEN 1 ELSE 0 END" for i in range(1, bins)))
    value = lambda c: bins_of(c) if c in numbers else f"coalesce(CAST({c} AS VARCHAR), '')"
    block(f"{p}_bins", [f"{p}_cuts"], f"SELECT {', '.join(f'{value(c)} AS {c}' for c in [target, *names])} FROM {table}, {p}_cuts")
    block(f"{p}_pairs", [f"{p}_bins"], " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS x, {target} AS y, count(*) AS n FROM {p}_bins GROUP BY ALL" for c in names))
    sizes = lambda src_, by: f"(SELECT col, sum(n * ln(n)) AS s, count(*) AS k FROM (SELECT col, CAST(sum(n) AS DOUBLE) AS n FROM {src_} GROUP BY col, {by}) GROUP BY col)"
    block(f"{p}_one", [f"{p}_pairs"], f"""SELECT col, (xy.s - x.s - y.s) / t + ln(t) AS information,
      (xy.s - x.s - y.s) / t + ln(t) + (x.k + y.k - xy.k - 1) / (2 * t) AS corrected,
      ln(t) - y.s / t + (y.k - 1) / (2 * t) AS entropy
      FROM {sizes(f'{p}_pairs', 'x')} x JOIN {sizes(f'{p}_pairs', 'y')} y USING (col) JOIN {sizes(f'{p}_pairs', 'x, y')} xy USING (col)
      JOIN (SELECT col, CAST(sum(n) AS DOUBLE) AS t FROM {p}_pairs GROUP BY col) USING (col)""")
    block(f"{p}_best", [f"{p}_one"], f"SELECT col AS given FROM {p}_one ORDER BY round(corrected, 12) DESC, col LIMIT 1")
    triples = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS x, {g} AS z, {target} AS y, count(*) AS n FROM {p}_bins, {p}_best WHERE given = '{g}' GROUP BY ALL"
        for c in names for g in names if c != g)
    block(f"{p}_triples", [f"{p}_bins", f"{p}_best"], triples)
    block(f"{p}_both", [f"{p}_triples"], f"""SELECT col, (zxy.s + z.s - zx.s - zy.s + (zx.k + zy.k - zxy.k - z.k) / 2) / t AS beside
      FROM {sizes(f'{p}_triples', 'z, x')} zx JOIN {sizes(f'{p}_triples', 'z, y')} zy USING (col) JOIN {sizes(f'{p}_triples', 'z, x, y')} zxy USING (col)
      JOIN {sizes(f'{p}_triples', 'z')} z USING (col) JOIN (SELECT col, CAST(sum(n) AS DOUBLE) AS t FROM {p}_triples GROUP BY col) USING (col)""")
    return statement(f"""SELECT col AS "column", {r('information', 'corrected')}, round(corrected / entropy + 1e-9, 6) + 0.0 AS share, given,
      {r('beside')}, CAST(row_number() OVER (ORDER BY round(corrected, 12) DESC, col) AS INT) AS place
      FROM {p}_one LEFT JOIN {p}_both USING (col), {p}_best""", f"{p}_one", f"{p}_both", f"{p}_best")


block("orders_q", [], "SELECT *, CAST(quarter(o_orderdate) AS VARCHAR) AS quarter FROM orders")
_ORDER_TARGET = ["o_custkey", "o_totalprice", "o_orderpriority", "quarter"]


@query("n05_explain_orders", _explain_blocks("exo", "orders_q", "o_orderstatus", ["o_custkey", "o_totalprice"], ["o_orderpriority", "quarter"], "orders_q"))
def _explain_orders(spark, sf_dir):
    rows = src.table(spark, sf_dir, "orders").withColumn("quarter", F.quarter("o_orderdate").cast("string"))
    return rounded(exp.explain_target(rows, "o_orderstatus", _ORDER_TARGET))


@query("n05_explain_customer", _explain_blocks("exc", "customer", "c_acctbal", ["c_acctbal", "c_nationkey", "c_custkey"], ["c_mktsegment"]))
def _explain_customer(spark, sf_dir):
    """A numeric target is binned like the columns."""
    return rounded(exp.explain_target(src.table(spark, sf_dir, "customer"), "c_acctbal", ["c_acctbal", "c_nationkey", "c_custkey", "c_mktsegment"]))


# -- parse success -----------------------------------------------------------------------------------------------------------

# Text columns as they come in uploads: prices in three spellings, dates in two, with values that cannot be read.
_TYPED = {
    "price": """CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {t}))
      ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {t}) END""",
    "key": "CASE WHEN o_orderkey % 5 = 0 THEN concat('K', CAST(o_orderkey AS {t})) ELSE CAST(o_orderkey AS {t}) END",
    "day": """CASE WHEN o_orderkey % 101 = 0 THEN '31/02/1999' WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN concat(' ', {iso}, ' ')
      ELSE {dmy} END""",
    "iso": "CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 51 = 0 THEN NULL ELSE {iso} END",
    "status": "o_orderstatus",
}
_SQL_DAY = {"t": "VARCHAR", "iso": "strftime(o_orderdate, '%Y-%m-%d')", "dmy": "strftime(o_orderdate, '%d/%m/%Y')"}
_SPARK_DAY = {"t": "STRING", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "dmy": "date_format(o_orderdate, 'dd/MM/yyyy')"}
_STRPTIME = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "dd/MM/yyyy": "%d/%m/%Y", "MM/dd/yyyy": "%m/%d/%Y", "dd.MM.yyyy": "%d.%m.%Y",
             "yyyyMMdd": "%Y%m%d", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S"}


def _parse_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, trim(CAST({e.format(**_SQL_DAY)} AS VARCHAR)) AS v FROM orders" for c, e in _TYPED.items())
    rows += " UNION ALL SELECT 'text', trim(text) FROM documents UNION ALL SELECT 'name', trim(c_name) FROM customer"
    fits = [f"CASE WHEN length(v) <= {par.LONG} AND regexp_matches(v, '{p}') THEN 1 ELSE 0 END" for p in par.NUMBERS.values()]
    fits += [f"CASE WHEN regexp_matches(v, '{p}') AND try_strptime(v, '{_STRPTIME[f]}') IS NOT NULL THEN 1 ELSE 0 END" for f, p in par.DATES.items()]
    per = ", ".join(f"sum({t}) AS p{i}, min(CASE WHEN {t} = 0 THEN v END) AS f{i}" for i, t in enumerate(fits))
    each = " UNION ALL ".join(f"SELECT col, n, '{f}' AS format, {i} AS width, p{i} AS parsed, f{i} AS failing FROM per" for i, f in enumerate(par.FORMATS))
    return f"""WITH v AS ({rows}), per AS (SELECT col, count(*) AS n, {per} FROM v WHERE v <> '' GROUP BY col), each AS ({each}),
    best AS (SELECT *, parsed / n AS share, CASE WHEN parsed / n < 0.5 THEN 'text' WHEN width < {len(par.NUMBERS)} THEN 'number' ELSE 'date' END AS kind
      FROM each QUALIFY row_number() OVER (PARTITION BY col ORDER BY parsed DESC, width) = 1)
    SELECT col AS "column", kind, CASE WHEN kind <> 'text' THEN format END AS format, n AS "values",
      CAST(CASE WHEN kind <> 'text' THEN parsed ELSE 0 END AS BIGINT) AS parsed, round(CASE WHEN kind <> 'text' THEN share ELSE 0 END + 1e-9, 6) + 0.0 AS share,
      CASE WHEN kind <> 'text' THEN failing END AS failing,
      CASE WHEN share >= 0.8 THEN NULL WHEN kind = 'number' THEN 'high' WHEN kind = 'date' THEN 'medium' END AS alert FROM best"""


@query("n06_parse_success", _parse_sql())
def _parse(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").selectExpr(*[f"{e.format(**_SPARK_DAY)} AS {c}" for c, e in _TYPED.items()])
    parts = [par.parse_success(orders, list(_TYPED)), par.parse_success(src.table(spark, sf_dir, "documents"), ["text"]),
             par.parse_success(src.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), ["name"])]
    return rounded(union_all(*parts))


# -- robust outliers -----------------------------------------------------------------------------------------------------------

_MEASURED = {"orders": ["o_totalprice", "o_custkey"], "customer": ["c_acctbal", "c_nationkey"], "part": ["p_size", "p_retailprice"],
             "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["value", "user_id"], "documents": ["n_chars"],
             "labels": ["quality", "toxic"], "supplier": ["s_acctbal"]}


def _outlier_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {t} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
                              for t, cs in _MEASURED.items() for c in cs)
    bound = lambda lo, hi, step: f"CASE WHEN {step} > 0 THEN {lo} - {step} END, CASE WHEN {step} > 0 THEN {hi} + {step} END"
    out = lambda rule: f"count(*) FILTER (v < {rule}_low OR v > {rule}_high)"
    named = ["p25", "median", "p75", "mad", "mean", "std", "iqr_low", "iqr_high", "z_low", "z_high", "mad_low", "mad_high"]
    boxes = {"iqr": bound("p25", "p75", "(1.5 * (p75 - p25))"), "z": bound("mean", "mean", "(3 * std)"), "mad": bound("median", "median", "(3.5 * mad / 0.6745::DOUBLE)")}
    limits = ", ".join(f"{low} AS {rule}_low, {high} AS {rule}_high" for rule, (low, high) in ((rule, b.split(", ", 1)) for rule, b in boxes.items()))
    return f"""WITH v AS MATERIALIZED ({long}),
    m AS (SELECT tbl, col, count(*) AS "rows", quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, avg(v) AS mean, stddev_samp(v) AS std FROM v GROUP BY ALL),
    d AS (SELECT tbl, col, quantile_cont(abs(v - median), 0.5) AS mad FROM v JOIN m USING (tbl, col) GROUP BY ALL),
    b AS (SELECT *, {limits} FROM m JOIN d USING (tbl, col)),
    c AS (SELECT tbl, col, {', '.join(f'{out(x)} AS {x}_rows' for x in boxes)} FROM v JOIN b USING (tbl, col) GROUP BY ALL),
    s AS (SELECT *, {', '.join(f'{x}_rows / "rows" AS {x}_share' for x in boxes)} FROM b JOIN c USING (tbl, col))
    SELECT tbl, col AS "column", "rows", {r(*named, digits=4)}, {', '.join(f'{x}_rows' for x in boxes)}, {r(*[f'{x}_share' for x in boxes])},
      CASE WHEN CAST(iqr_share > 0.05 AS INT) + CAST(z_share > 0.05 AS INT) + CAST(mad_share > 0.05 AS INT) >= 2 THEN 'medium'
           WHEN iqr_share > 0 OR z_share > 0 OR mad_share > 0 THEN 'info' END AS level FROM s"""


@query("n07_robust_outliers", _outlier_sql())
def _robust(spark, sf_dir):
    shares = {f"{x}_share": 6 for x in ("iqr", "z", "mad")}
    parts = [out.outlier_summary(src.table(spark, sf_dir, t), cs).withColumn("tbl", F.lit(t)) for t, cs in _MEASURED.items()]
    return rounded(union_all(*parts), 4, **shares)


# -- chunks of texts -------------------------------------------------------------------------------------------------------------

_WORD = "[^ \\t\\n\\r]+"
# The greedy cut step by step: one recursion per part of a text, over all texts at once.
_CHUNK_SQL = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')),
  cut AS (SELECT row, doc_id, string_split(regexp_replace(text, '([.!?][ \\t\\n\\r]+|\\n[ \\t\\n\\r]*)', '\\1' || chr(31), 'g'), chr(31)) AS s FROM docs),
  sent AS (SELECT row, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM cut),
  fine AS (SELECT row, doc_id, i, unnest(CASE WHEN len(regexp_extract_all(s, '{_WORD}')) <= 180 THEN [s]
      ELSE regexp_extract_all(s, '[ \\t\\n\\r]*(?:{_WORD}[ \\t\\n\\r]*){{1,180}}') END) AS t,
    unnest(range(1, 1 + len(CASE WHEN len(regexp_extract_all(s, '{_WORD}')) <= 180 THEN [s]
      ELSE regexp_extract_all(s, '[ \\t\\n\\r]*(?:{_WORD}[ \\t\\n\\r]*){{1,180}}') END))) AS j FROM sent WHERE s <> ''),
  part AS MATERIALIZED (SELECT row, doc_id, row_number() OVER (PARTITION BY row ORDER BY i, j) AS n, t, len(regexp_extract_all(t, '{_WORD}')) AS w,
    length(t) AS c, coalesce(sum(length(t)) OVER (PARTITION BY row ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM fine),
  walk AS (SELECT row, n, w AS held, 0 AS k FROM part WHERE n = 1
    UNION ALL SELECT p.row, p.n, CASE WHEN held > 0 AND p.w > 0 AND held + p.w > 180 THEN p.w ELSE held + p.w END,
      CASE WHEN held > 0 AND p.w > 0 AND held + p.w > 180 THEN k + 1 ELSE k END FROM walk JOIN part p ON p.row = walk.row AND p.n = walk.n + 1),
  own AS MATERIALIZED (SELECT part.*, k, coalesce(sum(w) OVER (PARTITION BY row, k ORDER BY n DESC), 0) AS behind FROM part JOIN walk USING (row, n)),
  body AS (SELECT row, doc_id, k, min(pos) AS pos, sum(c) AS c, sum(w) AS w, string_agg(t, '' ORDER BY n) AS t FROM own GROUP BY ALL),
  lead AS (SELECT row, k + 1 AS k, sum(c) AS c, sum(w) AS w, string_agg(t, '' ORDER BY n) AS t FROM own WHERE behind <= 20 GROUP BY ALL)
  SELECT doc_id, CAST(b.k AS INT) AS chunk, CAST(max(b.k) OVER (PARTITION BY b.row) + 1 AS INT) AS chunks, CAST(pos - coalesce(l.c, 0) AS INT) AS start,
    CAST(pos + b.c AS INT) AS stop, CAST(coalesce(l.c, 0) AS INT) AS repeated, CAST(b.w + coalesce(l.w, 0) AS INT) AS words,
    sha256(coalesce(l.t, '') || b.t) AS text_sha256
  FROM body b LEFT JOIN lead l ON l.row = b.row AND l.k = b.k"""


@query("n08_text_chunks", _CHUNK_SQL)
def _chunks(spark, sf_dir):
    found = chunk_texts(src.table(spark, sf_dir, "documents"), budget=200, overlap=20)
    return found.withColumn("text_sha256", F.sha2("text", 256)).drop("text")
