"""Quality rules over a column profile, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upsert import union_all


def _issues(df: DataFrame, rule: Column, severity: Column, columns: Column, message: Column) -> DataFrame:
    return df.select(rule.alias("rule"), severity.alias("severity"), columns.alias("columns"), message.alias("message"))


def quality_issues(columns: DataFrame, dataset: DataFrame, correlations: DataFrame) -> DataFrame:
    """(rule, severity, columns, message), one row per finding. All inputs are profile tables of schema size.

    Rule names and bounds are fixed values.
    """
    name, lit = F.col("column_name"), F.lit
    own = F.array("column_name")
    pct, dup, corr = F.col("null_pct"), F.col("duplicate_pct"), F.col("abs_corr")
    no_columns = F.array().cast("array<string>")
    level = F.when(pct > 0.5, "high").when(pct > 0.2, "warning").otherwise("info")
    nulls = _issues(
        columns.where(pct > 0),
        F.when(pct > 0.5, "high_null_rate").when(pct > 0.2, "moderate_null_rate").otherwise("low_null_rate"),
        level, own, F.format_string("%.1f%% of the rows have no value in '%s'.", pct * 100, name))
    duplicates = _issues(
        dataset.where(dup > 0.05), F.when(dup > 0.2, "high_duplicate_rows").otherwise("moderate_duplicate_rows"),
        F.when(dup > 0.2, "high").otherwise("warning"), no_columns,
        F.format_string("Repeats of an earlier row: %.1f%% of the table.", dup * 100))
    ids = _issues(
        columns.where((F.col("unique_pct") > 0.95) & F.col("inferred_type").isin("categorical", "text")),
        lit("id_like_column"), lit("info"), own,
        F.format_string("Nearly every row has its own value in '%s', as in a key.", name))
    skew = F.abs("skewness")
    skewed = _issues(
        columns.where((F.col("inferred_type") == "numeric") & (skew > 10)), lit("extreme_skewness"), lit("warning"), own,
        F.format_string("Skewness %.1f in '%s': a logarithm may suit it better.", skew, name))
    paired = _issues(
        correlations.where(corr > 0.95), lit("high_correlation"), lit("info"), F.array("col1", "col2"),
        F.format_string("|r| is %.2f between '%s' and '%s'; they may say the same.", corr, F.col("col1"), F.col("col2")))
    personal = _issues(
        columns.where("is_pii"), lit("pii_detected"), lit("warning"), own,
        F.format_string("Personal data suspected in '%s', of kind '%s'.", name, F.col("semantic_label")))
    constant = _issues(
        columns.where("distinct_count = 1"), lit("constant_column"), lit("info"), own,
        F.format_string("All values of '%s' are the same.", name))
    return union_all(nulls, duplicates, ids, skewed, paired, personal, constant)


def quality_score(issues: DataFrame) -> DataFrame:
    def of(severity: str) -> Column:
        return F.count(F.when(F.col("severity") == severity, 1))

    counts = issues.agg(of("high").alias("high"), of("warning").alias("warning"), of("info").alias("info"))
    points = 100 - 20 * F.col("high") - 5 * F.col("warning")
    return counts.withColumn("score", F.greatest(F.lit(0).cast("bigint"), points))


def quality_subscores(score: DataFrame, dataset: DataFrame) -> DataFrame:
    """Completeness, uniqueness, consistency and validity, each 0 to 100."""
    one = lambda df: df.withColumn("_k", F.lit(1))
    both = one(score).join(F.broadcast(one(dataset)), "_k")
    zero = F.lit(0).cast("bigint")
    lost = F.floor(F.col("duplicate_pct") * 200)
    return both.select(
        F.greatest(zero, 100 - 15 * F.col("high") - 5 * F.col("warning")).alias("completeness"),
        F.greatest(zero, 100 - lost).alias("uniqueness"),
        F.greatest(zero, 100 - 8 * F.col("warning")).alias("consistency"), F.col("score").alias("validity"),
    )
