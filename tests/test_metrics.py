import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from clickloom.operators import metrics


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y int")


def auc_of(spark, pairs):
    return metrics.auc(scored(spark, pairs), "y", "p").first()["auc"]


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], 0.75),
        ([(0.5, 0), (0.5, 1)], 0.5),
        ([(0.1, 1), (0.9, 1)], None),
    ],
)
def test_auc_golden(spark, pairs, want):
    assert auc_of(spark, pairs) == want


def test_auc_rejects_other_labels(spark):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        auc_of(spark, [(0.1, 0), (0.2, 2)])


def test_auc_equals_the_evaluator(spark):
    rng = random.Random(1)
    pairs = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(800)]
    df = scored(spark, pairs)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert auc_of(spark, pairs) == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_auc_under_score_maps(spark):
    rng = random.Random(2)
    pairs = [(rng.random(), rng.randrange(2)) for _ in range(300)]
    base = auc_of(spark, pairs)
    assert auc_of(spark, [(p**3, y) for p, y in pairs]) == pytest.approx(base)
    assert auc_of(spark, [(-p, y) for p, y in pairs]) == pytest.approx(1 - base)


def test_accuracy_at_threshold_counts_ties_as_right(spark):
    df = scored(spark, [(0.5, 1), (0.5, 0), (0.6, 0), (0.4, 0)])
    cut = spark.createDataFrame([(0.5,)], "t double")
    assert metrics.accuracy_at(df, "y", "p", cut).first()["accuracy"] == 0.75
    assert metrics.report(df, "y", "p", threshold=cut).first()["accuracy"] == 0.75


def test_report_agrees_with_the_single_metrics(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.randrange(2), rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int, c int")
    got = metrics.report(df, "y", "p", prediction="c").first()
    assert got["rows"] == 400
    assert got["auc"] == pytest.approx(metrics.auc(df, "y", "p").first()["auc"])
    assert got["logloss"] == pytest.approx(metrics.mean_log_loss(df, "y", "p").first()["logloss"])
    assert got["accuracy"] == pytest.approx(metrics.error_rate(df, "y", "c").first()["accuracy"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "p double, y int, c int")
    assert metrics.auc(df, "y", "p").first() == (None, 0, 0)
    assert metrics.error_rate(df, "y", "c").first()["error_rate"] is None
    assert metrics.report(df, "y", "p", prediction="c").first() == (None, None, None, 0)


def test_class_at_base_rate(spark):
    df = scored(spark, [(0.5, 1), (0.49, 0)])
    cut = metrics.base_rate(df, "y")
    got = metrics.predicted_class(df, "p", cut).orderBy(F.desc("p")).collect()
    assert [r["class"] for r in got] == [1, -1]


def test_running_progress(spark):
    df = spark.createDataFrame([(i, i % 2, 0.5) for i in range(10)], "i int, y int, p double")
    got = metrics.running_progress(df, "y", ["i"], score="p", report_every=4).orderBy("seq").collect()
    assert [(r["seq"], r["running_base_rate"]) for r in got] == [(4, 0.5), (8, 0.5)]
    assert got[1]["cumulative_loss"] == pytest.approx(8 * 0.6931471805599453)


def test_missing_predictions_are_errors(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, 0.5, 1)], "y int, p double, c int")
    assert metrics.error_rate(df, "y", "c").first()["errors"] == 1
    assert metrics.report(df, "y", "p", prediction="c").first()["accuracy"] == 0.5
