"""Queries over profiles, quality, charts and ad-hoc SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tidemark.operators import adhoc, charts
from tidemark.operators import profile as pf
from tidemark.operators import quality as ql
from tidemark.operators.upsert import union_all
from tidemark.plans.registry import query, rounded
from tidemark.plans.sql import block, r, statement
from tidemark.schemas import PRICE_COLUMNS
from tidemark.session import new_path
from tidemark.sources import raw
from tidemark.sources import tables as src
from tidemark.streaming.ingest import run_ingest

# Columns of the profiled tables: n numeric, d datetime, s string.
TABLES = {
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
    "events": "event_id:n ts:d user_id:n event_type:s value:n props:s",
}
COLUMNS = {t: [tuple(c.split(":")) for c in spec.split()] for t, spec in TABLES.items()}
PROFILED = list(TABLES)
_NULLED = {"customer": ("c_acctbal", "c_acctbal < 0"), "orders": ("o_orderpriority", "o_orderkey % 4 = 0")}


def _table(spark, sf_dir, name):
    """A given table, with some values emptied where the table itself has none missing."""
    df = src.table(spark, sf_dir, name)
    if name in _NULLED:
        column, test = _NULLED[name]
        df = df.withColumn(column, F.when(~F.expr(test), F.col(column)))
    return df


for _t in PROFILED:
    if _t in _NULLED:
        _c, _test = _NULLED[_t]
        block(f"in_{_t}", [], f"SELECT * REPLACE (CASE WHEN NOT ({_test}) THEN {_c} END AS {_c}) FROM {_t}")
    else:
        block(f"in_{_t}", [], f"SELECT * FROM {_t}")


def _column_sql(t: str, c: str, kind: str) -> str:
    """Counts, inferred type and labels of one column."""
    if kind == "s":
        inferred = (f"CASE WHEN count({c}) = 0 THEN 'mixed' WHEN count(try_cast({c} AS TIMESTAMP)) = count({c}) THEN 'datetime' "
                    f"WHEN avg(length({c})) > 80 THEN 'text' ELSE 'categorical' END")
    else:
        inferred = f"CASE WHEN count({c}) = 0 THEN 'mixed' ELSE '{'numeric' if kind == 'n' else 'datetime'}' END"
    label = pf.name_label(c)
    sem = (f"CASE WHEN count(DISTINCT {c}) / count(*) > 0.9 THEN 'id' ELSE '' END" if label == "" and kind == "s" else f"'{label}'")
    return (f"SELECT '{t}' AS tbl, '{c}' AS column_name, {inferred} AS inferred_type, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS null_pct, count(DISTINCT {c}) AS distinct_count, "
            f"round(count(DISTINCT {c}) / count(*)::DOUBLE, 4) AS unique_pct, {sem} AS semantic_label FROM in_{t}")


block("prof0", [f"in_{t}" for t in PROFILED], " UNION ALL ".join(
    _column_sql(t, c, k) for t in PROFILED for c, k in COLUMNS[t]))
block("prof", ["prof0"], "SELECT *, semantic_label IN ('email', 'phone', 'id') OR " + " OR ".join(
    f"contains(lower(column_name), '{p}')" for p in pf.PII_PARTS) + " AS is_pii FROM prof0")


def _over(tables, one):
    """Union of ``one(table)``; the first passes over the tables are independent jobs, so they are submitted together."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return union_all(*pool.map(lambda t: one(t).withColumn("tbl", F.lit(t)), tables))


def _each(spark, sf_dir, fn, tables=PROFILED):
    def one(t):
        df = _table(spark, sf_dir, t)
        return fn(df, pf.column_facts(df))

    return _over(tables, one)


def _profiles(spark, sf_dir):
    return _each(spark, sf_dir, lambda df, facts: pf.column_profile(df, facts, quantiles=False))


# -- profile -------------------------------------------------------------------------------------------------------------

_HEADINGS = ["C Key", "c-name", "C  Name", "!!", "Segment%"]


@query("f17_normalize_columns", """SELECT c_custkey AS c_key, c_name AS c_name, c_nationkey AS c_name_2,
  round(c_acctbal + 1e-9, 6) AS col, c_mktsegment AS segment FROM customer""")
def _normalize(spark, sf_dir):
    return rounded(pf.normalize_columns(src.table(spark, sf_dir, "customer").toDF(*_HEADINGS)))


@query("a13_infer_column_type", statement("SELECT tbl, column_name, inferred_type FROM prof", "prof"))
def _types(spark, sf_dir):
    return _each(spark, sf_dir, lambda df, facts: pf.fact_table(df, facts).select("column_name", "inferred_type"))


@query("a09_profile_nulls", statement(
    f"SELECT tbl, column_name, null_count, {r('null_pct')}, distinct_count, {r('unique_pct')} FROM prof", "prof"))
def _nulls(spark, sf_dir):
    return rounded(_each(spark, sf_dir, lambda df, facts: pf.null_profile(df, facts).drop("first_value", "last_value")))


@query("f18_semantic_label", statement("SELECT tbl, column_name, semantic_label FROM prof", "prof"))
def _labels(spark, sf_dir):
    return _profiles(spark, sf_dir).select("tbl", "column_name", "semantic_label")


@query("f19_is_pii", statement("SELECT tbl, column_name, is_pii FROM prof", "prof"))
def _pii(spark, sf_dir):
    return _profiles(spark, sf_dir).select("tbl", "column_name", "is_pii")


@query("f22_missingness", statement(
    f"SELECT tbl, column_name, {r('missing_pct')} FROM (SELECT *, round(null_pct * 100, 2) AS missing_pct FROM prof) WHERE null_pct > 0",
    "prof"))
def _missing(spark, sf_dir):
    return rounded(_each(spark, sf_dir, lambda df, facts: pf.missingness(pf.column_profile(df, facts, quantiles=False))))


@query("a25_type_counts", statement("SELECT tbl, inferred_type, count(*) AS columns FROM prof GROUP BY 1, 2", "prof"))
def _type_counts(spark, sf_dir):
    return _each(spark, sf_dir, lambda df, facts: pf.type_counts(pf.fact_table(df, facts)))


_NUMERIC = [(t, c) for t in ("customer", "orders", "part", "labels", "events") for c, k in COLUMNS[t] if k == "n"]
_STATS = ["min_number", "max_number", "mean_value", "std_value", "skewness", "kurtosis", "median", "p25", "p75", "p95"]
block("numeric_stats", [f"in_{t}" for t in PROFILED], " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, '{c}' AS column_name, min({c})::DOUBLE AS min_number, max({c})::DOUBLE AS max_number, avg({c}) AS mean_value,
    stddev_samp({c}) AS std_value, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, quantile_cont({c}::DOUBLE, 0.5) AS median,
    quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.75) AS p75, quantile_cont({c}::DOUBLE, 0.95) AS p95
    FROM in_{t}""" for t, c in _NUMERIC))


@query("a06_profile_numeric", statement(
    f"SELECT tbl, column_name, {r(*_STATS, digits=4)} FROM numeric_stats", "numeric_stats"))
def _numeric(spark, sf_dir):
    df = _each(spark, sf_dir, pf.column_profile, ["customer", "orders", "part", "labels", "events"])
    return rounded(df.where("inferred_type = 'numeric'").select("tbl", "column_name", *_STATS), 4)


_CATEGORICAL = [(t, c) for t in ("customer", "orders", "part", "events") for c, k in COLUMNS[t] if k == "s"]
block("top_vals", [f"in_{t}" for t in PROFILED], " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, '{c}' AS column_name, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place
    FROM in_{t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place <= 10""" for t, c in _CATEGORICAL))


@query("a07_profile_categorical", statement("""SELECT tbl, column_name, value, n, CAST(place AS INT) AS place FROM top_vals""", "top_vals"))
def _categorical(spark, sf_dir):
    return _each(spark, sf_dir, pf.top_values, ["customer", "orders", "part", "events"])


@query("a07_categorical_ends", " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value FROM {t}"
    for t, c in _CATEGORICAL if t != "orders"))
def _categorical_ends(spark, sf_dir):
    df = _each(spark, sf_dir, lambda d, f: pf.column_profile(d, f, quantiles=False).where("inferred_type = 'categorical'"),
               ["customer", "part", "events"])
    return df.select("tbl", "column_name", "min_value", "max_value")


@query("a07_top_values_json", statement("""SELECT tbl, column_name, '{' || string_agg(CAST(to_json(value) AS VARCHAR) || ':' || n, ',' ORDER BY place) || '}' AS top_values
  FROM top_vals WHERE place <= 10 GROUP BY tbl, column_name""", "top_vals"))
def _top_json(spark, sf_dir):
    return _each(spark, sf_dir, lambda d, f: pf.top_values_json(d, f, 10), ["customer", "orders", "part", "events"])


@query("t03_top_k_per_group", statement("SELECT tbl, column_name, value, n FROM top_vals WHERE place <= 3", "top_vals"))
def _top3(spark, sf_dir):
    df = _each(spark, sf_dir, lambda d, f: pf.top_values(d, f, 3), ["customer", "orders", "part", "events"])
    return df.select("tbl", "column_name", "value", "n")


_DATED = [("orders", "o_orderdate"), ("events", "ts")]


@query("a08_profile_datetime", " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, '{c}' AS column_name, CAST(CAST(min({c}) AS DATE) AS VARCHAR) AS min_value,
    CAST(CAST(max({c}) AS DATE) AS VARCHAR) AS max_value, CAST(floor(date_diff('second', min({c}), max({c})) / 86400) AS BIGINT)
    AS date_range_days FROM {t}""" for t, c in _DATED)
    + """ UNION ALL SELECT 'days', 'day', CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR), CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR),
    CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) FROM orders""")
def _datetime(spark, sf_dir):
    wanted = ["tbl", "column_name", "min_value", "max_value", "date_range_days"]
    dated = _each(spark, sf_dir, lambda d, f: pf.fact_table(d, f).where("inferred_type = 'datetime'"), ["orders", "events"])
    days = src.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"))
    text = pf.fact_table(days, pf.column_facts(days)).where("inferred_type = 'datetime'").withColumn("tbl", F.lit("days"))
    return dated.select(*wanted).unionByName(text.select(*wanted))


_WHOLE = ["customer", "orders", "lineitem", "part", "supplier", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("a10_duplicate_rows", " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows,
    round(round(sum(n - 1) / sum(n)::DOUBLE, 4) + 1e-9, 6) AS duplicate_pct FROM (SELECT count(*) AS n FROM {t} AS t GROUP BY t)"""
    for t in _WHOLE))
def _duplicates(spark, sf_dir):
    return rounded(union_all(*[pf.duplicate_rows(src.table(spark, sf_dir, t)).withColumn("tbl", F.lit(t)) for t in _WHOLE]))


_PARTS = {"lineitem": ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"], "documents": ["text", "lang"],
          "conversations": ["role", "text"]}


@query("a10_duplicate_parts", " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows,
    round(round(sum(n - 1) / sum(n)::DOUBLE, 4) + 1e-9, 6) AS duplicate_pct FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(c)})"""
    for t, c in _PARTS.items()))
def _duplicate_parts(spark, sf_dir):
    return rounded(union_all(*[
        pf.duplicate_rows(src.table(spark, sf_dir, t).select(*c)).withColumn("tbl", F.lit(t)) for t, c in _PARTS.items()]))


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a11_top_correlations", "SELECT col1, col2, abs_corr FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(round(abs(corr({a}, {b})), 3) + 1e-9, 6) AS abs_corr FROM lineitem"
    for i, a in enumerate(_LI) for b in _LI[i + 1:]) + ") ORDER BY abs_corr DESC, col1, col2 LIMIT 20")
def _top_corr(spark, sf_dir):
    df = src.table(spark, sf_dir, "lineitem")
    return rounded(pf.top_correlations(df, pf.column_facts(df)))


@query("a22_chart_heatmap", " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, 1.0::DOUBLE AS corr" if a == b else
    f"SELECT '{a}', '{b}', round(round(corr({a}, {b}), 2) + 1e-9, 6) + 0.0 FROM lineitem" for a in _LI for b in _LI))
def _heatmap(spark, sf_dir):
    return rounded(pf.correlation_heatmap(src.table(spark, sf_dir, "lineitem"), _LI))


def _list_sql(t: str, test: str) -> str:
    order = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _) in enumerate(COLUMNS[t])) + " END"
    return f"coalesce((SELECT string_agg(column_name, ',' ORDER BY {order}) FROM prof WHERE tbl = '{t}' AND {test}), '')"


@query("a12_profile_dataset", statement(" UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, (SELECT count(*) FROM in_{t}) AS row_count, {len(COLUMNS[t])}::BIGINT AS column_count,
    {_list_sql(t, "inferred_type = 'numeric'")} AS numeric_columns, {_list_sql(t, "inferred_type = 'datetime'")} AS date_columns,
    {_list_sql(t, "inferred_type = 'categorical'")} AS categorical_columns, {_list_sql(t, "is_pii")} AS pii_columns"""
    for t in PROFILED), "prof"))
def _dataset(spark, sf_dir):
    df = _each(spark, sf_dir, pf.dataset_profile)
    lists = ["numeric_columns", "date_columns", "categorical_columns", "pii_columns"]
    return df.select("tbl", "row_count", "column_count", *[F.array_join(c, ",").alias(c) for c in lists])


# -- quality --------------------------------------------------------------------------------------------------------------------

_Q = ["customer", "orders", "labels"]


def _quality(spark, sf_dir, t):
    df = _table(spark, sf_dir, t)
    facts = pf.column_facts(df)
    columns = pf.column_profile(df, facts, quantiles=False)
    return ql.quality_issues(columns, pf.duplicate_rows(df), pf.correlations(df, facts))


def _pairs_sql(t: str) -> str:
    names = [c for c, k in COLUMNS[t] if k == "n"]
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{a},{b}' AS columns, round(abs(corr({a}, {b})), 3) AS v FROM in_{t}"
                              for i, a in enumerate(names) for b in names[i + 1:])


block("q_corr", [f"in_{t}" for t in _Q], " UNION ALL ".join(_pairs_sql(t) for t in _Q))
block("q_dup", [f"in_{t}" for t in _Q], " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, round(sum(n - 1) / sum(n)::DOUBLE, 4) AS d FROM (SELECT count(*) AS n FROM in_{t} "
    f"GROUP BY {', '.join(c for c, _ in COLUMNS[t])})" for t in _Q))
block("q_skew", [f"in_{t}" for t in _Q], " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS columns, abs(skewness({c})) AS v FROM in_{t}" for t in _Q for c, k in COLUMNS[t] if k == "n"))
block("q_issues", ["prof", "q_corr", "q_dup", "q_skew"], f"""SELECT tbl, CASE WHEN null_pct > 0.5 THEN 'high_null_rate'
  WHEN null_pct > 0.2 THEN 'moderate_null_rate' ELSE 'low_null_rate' END AS rule, CASE WHEN null_pct > 0.5 THEN 'high'
  WHEN null_pct > 0.2 THEN 'warning' ELSE 'info' END AS severity, column_name AS columns FROM prof WHERE null_pct > 0 AND tbl IN {tuple(_Q)}
  UNION ALL SELECT tbl, CASE WHEN d > 0.2 THEN 'high_duplicate_rows' ELSE 'moderate_duplicate_rows' END,
  CASE WHEN d > 0.2 THEN 'high' ELSE 'warning' END, '' FROM q_dup WHERE d > 0.05
  UNION ALL SELECT tbl, 'id_like_column', 'info', column_name FROM prof WHERE unique_pct > 0.95 AND inferred_type IN ('categorical', 'text')
  AND tbl IN {tuple(_Q)}
  UNION ALL SELECT tbl, 'extreme_skewness', 'warning', columns FROM q_skew WHERE v > 10
  UNION ALL SELECT tbl, 'high_correlation', 'info', columns FROM q_corr WHERE v > 0.95
  UNION ALL SELECT tbl, 'pii_detected', 'warning', column_name FROM prof WHERE is_pii AND tbl IN {tuple(_Q)}
  UNION ALL SELECT tbl, 'constant_column', 'info', column_name FROM prof WHERE distinct_count = 1 AND tbl IN {tuple(_Q)}""")


@query("a14_quality_rules", statement("SELECT tbl, rule, severity, columns FROM q_issues", "q_issues"))
def _rules(spark, sf_dir):
    return _over(_Q, lambda t: _quality(spark, sf_dir, t)).select("tbl", "rule", "severity", F.array_join("columns", ",").alias("columns"))


block("q_score", ["q_issues"], " UNION ALL ".join(f"""SELECT '{t}' AS tbl, high, warning, info, greatest(0, 100 - 20 * high - 5 * warning)
  AS score FROM (SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info FROM q_issues WHERE tbl = '{t}')""" for t in _Q))


@query("a15_quality_score", statement("SELECT * FROM q_score", "q_score"))
def _score(spark, sf_dir):
    return _over(_Q, lambda t: ql.quality_score(_quality(spark, sf_dir, t)))


@query("a16_quality_subscores", statement("""SELECT tbl, greatest(0, 100 - 15 * high - 5 * warning) AS completeness,
  greatest(0, 100 - CAST(floor(d * 200) AS BIGINT)) AS uniqueness, greatest(0, 100 - 8 * warning) AS consistency, score AS validity
  FROM q_score JOIN q_dup USING (tbl)""", "q_score", "q_dup"))
def _subscores(spark, sf_dir):
    return _over(_Q, lambda t: ql.quality_subscores(
        ql.quality_score(_quality(spark, sf_dir, t)), pf.duplicate_rows(_table(spark, sf_dir, t))))


@query("f20_mask_profile", statement("""SELECT tbl, column_name, is_pii, CASE WHEN NOT is_pii THEN min_value END AS min_value FROM prof
  LEFT JOIN (SELECT tbl, column_name, min_value FROM (""" + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS column_name, " + (f"CAST(CAST(min({c}) AS DATE) AS VARCHAR)" if k == "d" else f"min({c})")
    + f" AS min_value FROM in_{t}" for t in ("customer", "orders", "part") for c, k in COLUMNS[t] if k != "n") +
    ")) USING (tbl, column_name) WHERE tbl IN ('customer', 'orders', 'part')", "prof"))
def _mask(spark, sf_dir):
    df = _each(spark, sf_dir, lambda d, f: pf.mask_profile(pf.column_profile(d, f, quantiles=False)), ["customer", "orders", "part"])
    return df.select("tbl", "column_name", "is_pii", "min_value")


@query("a27_suggested_kpis", """SELECT 'Avg ' || column_name AS name, column_name, round(v + 1e-9, 6) AS mean_value FROM (
  SELECT 'o_orderkey' AS column_name, avg(o_orderkey) AS v FROM orders UNION ALL SELECT 'o_custkey', avg(o_custkey) FROM orders
  UNION ALL SELECT 'o_totalprice', avg(o_totalprice) FROM orders)""")
def _suggested(spark, sf_dir):
    df = src.table(spark, sf_dir, "orders")
    return rounded(pf.suggested_kpis(df, pf.column_facts(df), first=3))


# -- charts --------------------------------------------------------------------------------------------------------------------------

@query("a17_chart_value_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def _value_counts(spark, sf_dir):
    return charts.value_counts(src.table(spark, sf_dir, "part"), "p_brand")


@query("a18_chart_group_agg", "SELECT p_brand AS value, round(avg(p_retailprice) + 1e-9, 6) AS metric FROM part GROUP BY 1 ORDER BY 1 LIMIT 15")
def _group_agg(spark, sf_dir):
    return rounded(charts.group_agg(src.table(spark, sf_dir, "part"), "p_brand", "p_retailprice", first=15))


@query("a18_chart_group_median", "SELECT o_orderpriority AS value, round(median(o_totalprice) + 1e-9, 6) AS metric FROM orders GROUP BY 1")
def _group_median(spark, sf_dir):
    return rounded(charts.group_agg(src.table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "median"))


@query("a19_chart_histogram", f"""SELECT bin, {r('low', 'high')}, n FROM (SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high,
  count(*) AS n FROM (SELECT lo, (hi - lo) / 40 AS w, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin FROM (
  SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events)) GROUP BY ALL)""")
def _histogram(spark, sf_dir):
    return rounded(charts.histogram(src.table(spark, sf_dir, "events"), "value"))


@query("a20_chart_box", """SELECT event_type AS value, round(quantile_cont(value, 0.25) + 1e-9, 6) AS q1,
  round(quantile_cont(value, 0.5) + 1e-9, 6) AS median, round(quantile_cont(value, 0.75) + 1e-9, 6) AS q3,
  round(min(value) + 1e-9, 6) AS low, round(max(value) + 1e-9, 6) AS high, count(value) AS n FROM events GROUP BY event_type""")
def _box(spark, sf_dir):
    return rounded(charts.box(src.table(spark, sf_dir, "events"), "event_type", "value"))


@query("a21_chart_pie", """SELECT value, n, round(n / sum(n) OVER () + 1e-9, 6) AS share FROM (SELECT p_brand AS value, count(*) AS n
  FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10)""")
def _pie(spark, sf_dir):
    return rounded(charts.pie(src.table(spark, sf_dir, "part"), "p_brand"))


@query("a23_chart_line", "SELECT ts AS date, round(value + 1e-9, 6) AS y FROM events WHERE value IS NOT NULL")
def _line(spark, sf_dir):
    return rounded(charts.line(src.table(spark, sf_dir, "events"), "ts", "value"))


@query("w43_chart_rolling", """SELECT ts AS date, event_id, round(value + 1e-9, 6) AS y, round(avg(value) OVER (ORDER BY ts, event_id
  ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS roll_7 FROM events""")
def _rolling(spark, sf_dir):
    return rounded(charts.rolling_line(src.table(spark, sf_dir, "events"), "ts", "value", 7, ["event_id"]))


@query("a24_chart_scatter", """SELECT o_custkey, round(o_totalprice + 1e-9, 6) AS o_totalprice, o_orderkey FROM orders
  ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000""")
def _scatter(spark, sf_dir):
    return rounded(charts.scatter(src.table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"]))


@query("a26_auto_views")
def _auto_views(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    facts = pf.column_facts(df)
    pairs = [(p["col1"], p["col2"]) for p in pf.top_correlations(df, facts).limit(2).collect()]
    has_nulls = any(c["non_null"] < facts.rows for c in facts.columns.values())
    parts = []
    for spec in charts.view_specs(facts, pairs, has_nulls):
        data = charts.view_data(df, spec, ["o_orderkey"])
        rows = spark.range(1).select(F.lit(None).cast("bigint").alias("rows")) if data is None else data.agg(
            F.count(F.lit(1)).alias("rows"))
        parts.append(rows.select(F.lit(spec["priority"]).alias("priority"), F.lit(spec["chart"]).alias("chart"),
                                 F.lit(spec["title"]).alias("title"), "rows"))
    return union_all(*parts)


# -- ad-hoc SQL and limits --------------------------------------------------------------------------------------------------------------

@query("f21_safe_sql", """SELECT p_type, round(avg(p_retailprice) + 1e-9, 6) AS mean_price, count(*) AS n FROM part GROUP BY p_type""")
def _safe_sql(spark, sf_dir):
    return rounded(adhoc.answer(src.table(spark, sf_dir, "part"),
                                 "select p_type, avg(p_retailprice) AS mean_price, count(*) AS n from dataset group by p_type"))


@query("t04_injected_limit", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey, o_orderstatus LIMIT 5000")
def _limit(spark, sf_dir):
    return adhoc.answer(src.table(spark, sf_dir, "orders"),
                         "SELECT o_orderkey, o_orderstatus FROM data ORDER BY o_orderkey, o_orderstatus")


@query("t05_preview", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def _preview(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


# -- incremental ingest -------------------------------------------------------------------------------------------------------------------

@query("x01_incremental_ingest", statement(f"""SELECT date AS trade_date, upper(ticker) AS symbol, 'equities' AS asset_class,
  {r('open', 'high', 'low')}, round(CASE WHEN year(date) >= 2001 THEN close + 1 ELSE close END + 1e-9, 6) AS close,
  {r('adj_close', 'volume')}, cap_category AS cap_tier FROM bars""", "bars"))
def _ingest(spark, sf_dir):
    raw_path, curated, checkpoint = (new_path(spark, n) for n in ("raw", "curated", "stream"))
    bars = src.bars(spark, sf_dir)
    raw.bar_payloads(bars, "equities").write.json(raw_path, compression="gzip")
    run_ingest(spark, raw_path, curated, checkpoint)
    # A later delivery corrects the closes of the last year; a third run finds nothing new.
    fixed = bars.where(F.year("date") >= 2001).withColumn("close", F.col("close") + 1)
    raw.bar_payloads(fixed, "equities").write.mode("append").json(raw_path, compression="gzip")
    run_ingest(spark, raw_path, curated, checkpoint)
    run_ingest(spark, raw_path, curated, checkpoint)
    return rounded(spark.read.parquet(curated).select("trade_date", "symbol", "asset_class", *PRICE_COLUMNS, "cap_tier"))
