"""Investor risk scoring, fund recommendation, allocation views and outcome bands."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import exact_quantiles
from tidemark.session import pin

if TYPE_CHECKING:
    from pyspark.ml import Model

# Funds as (id, lowest and highest fitting risk score, expected return), in order of preference.
FUNDS = [
    ("F1", 1, 2, "4-6% annualised"),
    ("F2", 2, 3, "8-12% annualised"),
    ("F3", 3, 4, "12-17% annualised"),
    ("F5", 4, 4, "17-26% annualised"),
    ("F4", 5, 5, "25-35%+ annualised"),
]
# Names of the risk scores.
RISK_LABELS = {1: "Very Conservative", 2: "Conservative", 3: "Moderate", 4: "Aggressive", 5: "Very Aggressive"}


def risk_points(investors: DataFrame) -> DataFrame:
    """Risk score 1 to 5 from the investor's attributes.

    Income counts by its place between the smallest and largest income; that one row is broadcast.
    """
    ends = investors.agg(F.min("annual_income").alias("_lo"), F.max("annual_income").alias("_hi"))
    df = investors.withColumn("_k", F.lit(1)).join(F.broadcast(ends.withColumn("_k", F.lit(1))), "_k").drop("_k")
    income = (F.col("annual_income") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
    points = (
        F.lit(3.0)
        + (F.col("loss_tolerance_pct") - 20) * 0.055
        + (F.col("investment_horizon") - 12) * 0.045
        - (F.col("age") - 40) * 0.025
        + F.col("investment_experience") * 0.35
        - F.col("dependents") * 0.18
        + (income - 0.5) * 0.8
        + F.when(F.col("marital_status") == "single", 0.15).when(F.col("marital_status") == "widowed", -0.2).otherwise(0.0)
        + F.when(F.col("employment_type") == "retired", -0.3).when(F.col("employment_type") == "variable", -0.1).otherwise(0.0)
    )
    score = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(points)))
    return df.withColumn("points", points).withColumn("risk_profile", score.cast("int")).drop("_lo", "_hi")


def _label(score: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RISK_LABELS.items() for x in pair])[score]


FITS = 2  # forests fitted at once; each keeps its own rows in memory
ROWS_A_PART = 20_000  # of a table that forests learn from

NUMERIC_FEATURES = ["age", "annual_income", "dependents", "investment_horizon", "loss_tolerance_pct", "investment_experience"]
TEXT_FEATURES = ["marital_status", "employment_type"]


def spread(labelled: DataFrame) -> DataFrame:
    """The same rows in partitions of about ``ROWS_A_PART``, in a fixed order, as a forest goes over them once a level.

    A table in one file is one partition otherwise, and one task does all the work. What fits one partition stays as it is.
    """
    parts = -(-labelled.count() // ROWS_A_PART)
    return labelled if parts < 2 else pin(labelled.repartition(parts).sortWithinPartitions(*labelled.columns))


def risk_classifier(trees: int = 200, depth: int = 5, seed: int = 42):
    """Untrained pipeline: index the text attributes, assemble, random forest (Spark's boosted trees are binary)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    coded = [f"{c}_code" for c in TEXT_FEATURES]
    return Pipeline(stages=[
        StringIndexer(inputCols=TEXT_FEATURES, outputCols=coded, stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=[*NUMERIC_FEATURES, *coded], outputCol="features"),
        RandomForestClassifier(labelCol="risk_profile", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed),
    ])


def cross_validated(labelled: DataFrame, folds: int = 5, **params) -> tuple[float, Model]:
    """Mean accuracy over the folds, and the forest of all rows, which the validator fits at its end anyway."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    judge = MulticlassClassificationEvaluator(labelCol="risk_profile", metricName="accuracy")
    cv = CrossValidator(estimator=risk_classifier(**params), estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=judge, numFolds=folds, seed=42, parallelism=FITS)
    fitted = cv.fit(labelled)
    return float(fitted.avgMetrics[0]), fitted.bestModel


def cross_validated_accuracy(labelled: DataFrame, folds: int = 5, **params) -> float:
    return cross_validated(labelled, folds, **params)[0]


def feature_importance(model) -> list[tuple[str, float]]:
    names = [*NUMERIC_FEATURES, *TEXT_FEATURES]
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda p: -p[1])


def predict_risk(model, investors: DataFrame) -> DataFrame:
    """Score, its name, confidence and the probability of each class."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    scored = model.transform(investors)
    risk = F.col("prediction").cast("int")
    return scored.select(
        *[c for c in investors.columns if c != "risk_profile"], risk.alias("risk_profile"), _label(risk).alias("label"),
        F.array_max(p).alias("confidence"), *[p[k].alias(f"p_{k}") for k in RISK_LABELS],
    )


def cross_fitted(labelled: DataFrame, key: str, folds: int = 5, **params) -> DataFrame:
    """Every row as ``predict_risk`` gives it, scored by a forest that learned from the other folds (key modulo folds)."""
    fold = F.coalesce(F.pmod(F.col(key), F.lit(folds)), F.lit(0))
    with ThreadPoolExecutor(max_workers=FITS) as pool:  # forests are independent; one fills the gaps of another
        models = list(pool.map(lambda k: risk_classifier(**params).fit(labelled.where(fold != k)), range(folds)))
    return reduce(DataFrame.unionAll, [predict_risk(m, labelled.where(fold == k)) for k, m in enumerate(models)])


def recommend_funds(df: DataFrame, score: str, funds: list[tuple] = FUNDS) -> DataFrame:
    """One row per fitting fund; a score outside every range gets the fund with the nearest range end.

    The fund list is a short constant carried in each row, so there is no range join.
    """
    s = F.col(score)
    listed = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(f[0]).alias("fund"), F.lit(f[1]).alias("lo"), F.lit(f[2]).alias("hi"),
                 F.lit(f[3]).alias("expected_return"))
        for i, f in enumerate(funds)
    ])
    fitting = F.filter(listed, lambda f: (f["lo"] <= s) & (s <= f["hi"]))
    ranked = F.transform(listed, lambda f: F.struct(
        F.least(F.abs(f["lo"] - s), F.abs(f["hi"] - s)).alias("d"), f["place"].alias("place"), f.alias("f")))
    nearest = F.array(F.array_min(ranked)["f"])
    chosen = F.when(F.size(fitting) > 0, fitting).otherwise(nearest)
    return df.withColumn("_f", F.explode(chosen)).select(
        *df.columns, F.col("_f.fund").alias("fund"), F.col("_f.expected_return").alias("expected_return"),
    )


def allocation_rollup(holdings: DataFrame, least: float = 0.03) -> DataFrame:
    """Weights below the limit are folded into one entry per fund."""
    name = F.when(F.col("weight") < least, "Others").otherwise(F.col("ticker"))
    return holdings.groupBy("fund", name.alias("holding")).agg(F.sum("weight").alias("weight"))


def path_bands(paths: DataFrame) -> DataFrame:
    """5/25/50/75/95 percentiles of all paths (sim_id, step, value) at each step."""
    return exact_quantiles(paths, ["step"], "value", {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})


def path_finals(paths: DataFrame) -> DataFrame:
    return paths.groupBy("sim_id").agg(F.max_by("value", "step").alias("final"), F.min_by("value", "step").alias("first"))


def path_outcomes(paths: DataFrame, goal: float, start: float) -> DataFrame:
    """Share of paths that end at or above the goal, and at or above twice the start."""
    return path_finals(paths).agg(
        F.count(F.lit(1)).alias("paths"), F.avg((F.col("final") >= goal).cast("double")).alias("goal_share"),
        F.avg((F.col("final") >= 2 * start).cast("double")).alias("double_share"),
    )
