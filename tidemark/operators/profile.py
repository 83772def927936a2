"""Dataset profile: column names, types, statistics, duplicates and correlations.

Pass one is an aggregation over all columns. Distinct values are counted per (column, value) with map-side
combine; quantiles come from ``ordering.exact_quantiles``. Only facts whose number is set by the schema reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.market import pairwise_corr, symmetric
from tidemark.operators.ordering import exact_quantiles

# Semantic labels and the words that stand for them, tried in this order.
SEMANTIC_WORDS = {
    "id": "id|_id|uuid|key",
    "email": "email",
    "phone": "phone|mobile|tel",
    "date": "date|time|timestamp|at|_on|day|month|year",
    "amount": "amount|revenue|sales|price|cost|value|total",
    "country": "country|nation|region|state|city|location",
    "name": "name|title|label|description",
    "category": "category|type|class|segment|group|status",
    "quantity": "count|quantity|qty|num|number",
}
# Labels and name parts that mark personal data.
PII_LABELS = ["email", "phone", "id"]
PII_PARTS = ["ssn", "passport", "nric", "dob", "birth", "address", "zip", "postal"]

QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}


# -- names -------------------------------------------------------------------------------------------------------------

def normalized_names(names: list[str]) -> list[str]:
    """Lower case, other characters to underscores, repeated names numbered from _2."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        base = re.sub("[^a-z0-9]+", "_", raw.strip().lower()).strip("_") or "col"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def name_label(name: str, by_token: bool = False) -> str:
    """Label from the column name. ``_`` counts as a letter at a word boundary, so ``order_date`` has no label unless
    ``by_token`` splits the name at underscores first."""
    text = name.replace("_", " ") if by_token else name
    for label, words in SEMANTIC_WORDS.items():
        if re.search(rf"\b({words})\b", text, re.IGNORECASE):
            return label
    return ""


def is_pii(label: Column, name: Column) -> Column:
    hit = label.isin(*PII_LABELS)
    for part in PII_PARTS:
        hit = hit | F.lower(name).contains(part)
    return hit


# -- types ---------------------------------------------------------------------------------------------------------------

def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _sql_value(field: T.StructField) -> str:
    """The value as double, text, or itself for dates and booleans; NaN is missing."""
    c, kind = f"`{field.name}`", _kind(field.dataType)
    if kind == "numeric":
        return f"CAST({c} AS DOUBLE)" if isinstance(field.dataType, (T.IntegralType, T.DecimalType)) else (
            f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS DOUBLE) END")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return f"CASE WHEN {c} IS NOT NULL THEN to_json(struct({c})) END"
    return f"CAST({c} AS STRING)" if kind == "string" else c


def _sql_dates(c: str, i: int) -> list[str]:
    return [f"CAST(CAST(min({c}) AS DATE) AS STRING) AS lo{i}", f"CAST(CAST(max({c}) AS DATE) AS STRING) AS hi{i}",
            f"timestampdiff(DAY, min({c}), max({c})) AS span{i}"]


def _number(name: str) -> Column:
    x = _col(name).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class Facts:
    """One row of aggregates, read back once: rows of the table and what is known of each column."""

    rows: int
    columns: dict[str, dict]

    def of_type(self, kind: str) -> list[str]:
        return [n for n, c in self.columns.items() if c["inferred_type"] == kind]


def column_facts(df: DataFrame) -> Facts:
    """Counts, extremes, moments and inferred types, from two aggregations without any large group.

    A string column is a datetime when all its values parse, text when its mean length passes 80, else categorical
    (few distinct short values are categorical as well, so the distinct ratio never changes the answer).
    """
    fields = list(enumerate(df.schema.fields))
    numeric = [(i, f) for i, f in fields if _kind(f.dataType) == "numeric"]
    aggs = ["count(1) AS rows"]
    for i, f in fields:
        kind, c = _kind(f.dataType), _sql_value(f)
        if kind == "datetime":
            aggs += [f"count({c}) AS n{i}", *_sql_dates(c, i)]
        elif kind == "string":
            stamp = f"try_cast({c} AS TIMESTAMP_NTZ)"
            aggs += [f"count({c}) AS n{i}", f"avg(length({c})) AS len{i}", f"count({stamp}) AS ts{i}", *_sql_dates(stamp, i)]
        elif kind == "boolean":
            aggs.append(f"count({c}) AS n{i}")
    row = df.selectExpr(*aggs).first().asDict()
    moments = {}
    if numeric:
        # One row per value and a handful of aggregates compile to tight code; hundreds of aggregates per row do not.
        values = ", ".join(f"named_struct('k', {i}, 'v', {_sql_value(f)})" for i, f in numeric)
        per_column = df.selectExpr(f"inline(array({values}))").where("v IS NOT NULL").groupBy("k").agg(*[
            F.expr(f"{fn}(v) AS {fn}") for fn in ("count", "min", "max", "avg", "stddev_samp", "skewness", "kurtosis")])
        moments = {r["k"]: r.asDict() for r in per_column.collect()}
    out = {}
    for i, f in fields:
        kind = _kind(f.dataType)
        m = moments.get(i, {})
        n = m.get("count", 0) if kind == "numeric" else row[f"n{i}"]
        c = {"string": kind == "string", "non_null": n}
        if n == 0:
            c["inferred_type"] = "mixed"
        elif kind != "string":
            c["inferred_type"] = kind
        elif row[f"ts{i}"] == n:
            c["inferred_type"] = "datetime"
        else:
            c["inferred_type"] = "text" if row[f"len{i}"] > 80 else "categorical"
        if c["inferred_type"] == "numeric":
            c |= {"min_number": m["min"], "max_number": m["max"], "mean_value": m["avg"], "std_value": m["stddev_samp"],
                  **sample_shape(n, m["skewness"], m["kurtosis"])}
        elif c["inferred_type"] == "datetime":
            c |= {"min_value": row[f"lo{i}"], "max_value": row[f"hi{i}"], "date_range_days": row[f"span{i}"]}
        out[f.name] = c
    return Facts(row["rows"], out)


def sample_shape(n: int, g1: float | None, g2: float | None) -> dict:
    """Bias-corrected skewness and excess kurtosis from the population moments."""
    skew = g1 * (n * (n - 1)) ** 0.5 / (n - 2) if g1 is not None and n > 2 else None
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if g2 is not None and n > 3 else None
    return {"skewness": skew, "kurtosis": kurt}


# -- distinct values ---------------------------------------------------------------------------------------------------------

def value_counts(df: DataFrame, facts: Facts, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n) over all non-null values. Long texts are counted by digest, marked with #."""
    entries = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        v = f"CAST({_sql_value(f)} AS STRING)"
        if facts.columns[f.name]["inferred_type"] not in ("categorical", "numeric", "boolean"):
            v = f"CASE WHEN length({v}) <= 64 THEN {v} ELSE concat('#', sha2({v}, 256)) END"
        entries.append(f"named_struct('column_name', '{f.name}', 'value', {v})")
    if not entries:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    long = df.selectExpr(f"inline(array({', '.join(entries)}))").where("value IS NOT NULL")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, facts: Facts, k: int = 10) -> DataFrame:
    """(column_name, value, n, place): commonest values of the categorical columns; equal counts go by value."""
    columns = facts.of_type("categorical")
    counts = value_counts(df, facts, columns)
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def top_values_json(df: DataFrame, facts: Facts, k: int = 10) -> DataFrame:
    """(column_name, top_values): the commonest values of each categorical column with their counts, as one JSON object."""
    ranked = F.sort_array(F.collect_list(F.struct("place", "value", "n")))  # k entries a column
    pairs = F.map_from_entries(F.transform(ranked, lambda e: F.struct(e["value"], e["n"])))
    return top_values(df, facts, k).groupBy("column_name").agg(F.to_json(pairs).alias("top_values"))


def null_profile(df: DataFrame, facts: Facts) -> DataFrame:
    """(column_name, null_count, null_pct, distinct_count, unique_pct, first_value, last_value)."""
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(n, facts.rows - c["non_null"]) for n, c in facts.columns.items()], "column_name string, null_count bigint")
    distinct = value_counts(df, facts).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c), F.lit(float(facts.rows))), 4), F.lit(0.0))
    return (
        known.join(distinct, "column_name", "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
        .withColumns({"null_pct": share("null_count"), "unique_pct": share("distinct_count")})
    )


def numeric_quantiles(df: DataFrame, facts: Facts) -> DataFrame:
    names = facts.of_type("numeric")
    entries = F.array(*[F.struct(F.lit(n).alias("column_name"), _number(n).alias("value")) for n in names])
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    return exact_quantiles(long, ["column_name"], "value", QUANTILES)


# -- the profile ----------------------------------------------------------------------------------------------------------------

_FACT_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("inferred_type", T.StringType()),
    T.StructField("is_string", T.BooleanType()), T.StructField("name_label", T.StringType()),
    T.StructField("min_value", T.StringType()), T.StructField("max_value", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ("min_number", "max_number", "mean_value", "std_value", "skewness", "kurtosis")],
    T.StructField("date_range_days", T.LongType()), T.StructField("position", T.IntegerType()),
])


def fact_table(df: DataFrame, facts: Facts, by_token: bool = False) -> DataFrame:
    rows = []
    for i, (name, c) in enumerate(facts.columns.items()):
        rows.append((name, c["inferred_type"], c["string"], name_label(name, by_token), c.get("min_value"), c.get("max_value"),
                     *[c.get(k) for k in ("min_number", "max_number", "mean_value", "std_value", "skewness", "kurtosis")],
                     c.get("date_range_days"), i))
    return df.sparkSession.createDataFrame(rows, _FACT_SCHEMA)


def with_labels(columns: DataFrame) -> DataFrame:
    """Semantic label: from the name, else ``id`` for a string column that is more than 90% distinct."""
    label = F.when((F.col("name_label") == "") & F.col("is_string") & (F.col("unique_share") > 0.9), "id").otherwise(
        F.col("name_label"))
    labelled = columns.withColumn("semantic_label", label)
    return labelled.withColumn("is_pii", is_pii(F.col("semantic_label"), F.col("column_name")))


def column_profile(df: DataFrame, facts: Facts | None = None, quantiles: bool = True, by_token: bool = False) -> DataFrame:
    """One row per column of the table."""
    facts = facts or column_facts(df)
    columns = fact_table(df, facts, by_token).join(null_profile(df, facts), "column_name")
    columns = columns.withColumn("unique_share", F.col("distinct_count") / F.lit(float(max(facts.rows, 1))))
    named = F.col("inferred_type") == "categorical"
    columns = with_labels(columns).withColumns({
        "min_value": F.when(named, F.col("first_value")).otherwise(F.col("min_value")),
        "max_value": F.when(named, F.col("last_value")).otherwise(F.col("max_value")),
    }).drop("unique_share", "name_label", "is_string", "first_value", "last_value")
    if quantiles and facts.of_type("numeric"):
        return columns.join(numeric_quantiles(df, facts), "column_name", "left")
    return columns.withColumns({q: F.lit(None).cast("double") for q in QUANTILES})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(row_count, duplicate_rows, duplicate_pct): rows equal to an earlier row, found by a digest of the row."""
    digest = F.sha2(F.to_json(F.struct(*[_col(c) for c in df.columns])), 256)
    per_row = df.groupBy(digest.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
    extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")
    return per_row.agg(total.alias("row_count"), extra.alias("duplicate_rows")).withColumn(
        "duplicate_pct", F.coalesce(F.round(F.try_divide(F.col("duplicate_rows"), F.col("row_count")), 4), F.lit(0.0)))


def correlations(df: DataFrame, facts: Facts) -> DataFrame:
    """(col1, col2, abs_corr) of all pairs of numeric columns that have one."""
    pairs = pairwise_corr(df, facts.of_type("numeric")).where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return pairs.select("col1", "col2", F.round(F.abs("corr"), 3).alias("abs_corr"))


def top_correlations(df: DataFrame, facts: Facts, k: int = 20) -> DataFrame:
    """The k strongest pairs, for display."""
    return correlations(df, facts).orderBy(F.col("abs_corr").desc(), "col1", "col2").limit(k)


def correlation_heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    return symmetric(pairwise_corr(df, columns), columns).withColumn("corr", F.round("corr", 2))


def dataset_profile(df: DataFrame, facts: Facts) -> DataFrame:
    """One row: sizes, duplicates and the column lists."""
    columns = column_profile(df, facts, quantiles=False)

    def names(test: Column, out: str) -> Column:
        picked = F.sort_array(F.collect_list(F.when(test, F.struct("position", "column_name"))))
        return F.transform(picked, lambda s: s["column_name"]).alias(out)

    kind = F.col("inferred_type")
    lists = columns.agg(
        F.count(F.lit(1)).alias("column_count"), names(kind == "numeric", "numeric_columns"),
        names(kind == "datetime", "date_columns"), names(kind == "categorical", "categorical_columns"),
        names(F.col("is_pii"), "pii_columns"),
    )
    return duplicate_rows(df).withColumn("_k", F.lit(1)).join(
        F.broadcast(lists.withColumn("_k", F.lit(1))), "_k").drop("_k")


def missingness(columns: DataFrame) -> DataFrame:
    return columns.where("null_pct > 0").select("column_name", F.round(F.col("null_pct") * 100, 2).alias("missing_pct")).orderBy(
        "missing_pct", "column_name")


def type_counts(columns: DataFrame) -> DataFrame:
    return columns.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("columns"))


def mask_profile(columns: DataFrame) -> DataFrame:
    """Value statistics of personal columns are removed before a profile is shared."""
    values = ["min_value", "max_value", "min_number", "max_number", "mean_value", "std_value", "skewness", "kurtosis",
              "date_range_days", *QUANTILES]
    return columns.withColumns({c: F.when(~F.col("is_pii"), F.col(c)) for c in values if c in columns.columns})


def suggested_kpis(df: DataFrame, facts: Facts, first: int | None = None) -> DataFrame:
    """Means of the numeric columns, or of the ``first`` of them."""
    names = facts.of_type("numeric")[:first]
    means = df.agg(*[F.avg(_number(n)).alias(n) for n in names])
    return means.unpivot([], names, "column_name", "mean_value").withColumn("name", F.concat(F.lit("Avg "), "column_name"))
