"""The risk classifier scores every customer, out of sample."""

from tidemark.operators import advisory as ad
from tidemark.plans import backtest_queries, catalog
from tidemark.sources import tables as src

SF = "/root/testdata/sf0.001"


def test_every_customer_gets_an_out_of_sample_row(spark):
    got = {r["c_custkey"]: r for r in catalog.QUERIES["a43_risk_classifier"](spark, SF).collect()}
    assert set(got) == {r[0] for r in src.table(spark, SF, "customer").select("c_custkey").collect()}
    labelled = ad.risk_points(src.investors(spark, SF)).drop("points")
    model = ad.risk_classifier().fit(labelled.where("c_custkey % 5 <> 3"))
    alone = ad.predict_risk(model, labelled.where("c_custkey % 5 = 3")).collect()
    assert alone and all(got[r["c_custkey"]]["confidence"] == r["confidence"] for r in alone)


def test_validation_gives_accuracy_and_importance(spark):
    rows = catalog.QUERIES["a43_risk_validation"](spark, SF).collect()
    accuracy = [r["value"] for r in rows if r["measure"] == "accuracy"]
    assert len(accuracy) == 1 and 0.4 < accuracy[0] <= 1
    weights = {r["name"]: r["value"] for r in rows if r["measure"] == "importance"}
    assert set(weights) == {*ad.NUMERIC_FEATURES, *ad.TEXT_FEATURES} and abs(sum(weights.values()) - 1) < 1e-9


def test_forests_learn_from_rows_spread_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ad, "ROWS_A_PART", 20)
    labelled = backtest_queries._labelled(spark, SF)
    whole = ad.risk_points(src.investors(spark, SF)).drop("points")
    assert labelled.rdd.getNumPartitions() == -(-whole.count() // 20) > 1  # one file was one task before
    assert sorted(map(tuple, labelled.collect())) == sorted(map(tuple, whole.collect()))
    assert [r.c_custkey for r in labelled.collect()] == [r.c_custkey for r in backtest_queries._labelled(spark, SF).collect()]


def test_validation_takes_the_forest_of_all_rows_from_the_validator(spark):
    labelled = backtest_queries._labelled(spark, SF)
    accuracy, forest = ad.cross_validated(labelled, trees=5)
    assert accuracy == ad.cross_validated_accuracy(labelled, trees=5)
    assert ad.feature_importance(forest) == ad.feature_importance(ad.risk_classifier(trees=5).fit(labelled))
