import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import scoring
from pairloom.operators import history, metrics


def logits(spark, rows):
    return metrics.score_logits(spark.createDataFrame(rows, "label int, z array<float>"), "label", "z")


def test_loss_of_even_logits(spark):
    assert metrics.evaluate(logits(spark, [(1, [0.0, 0.0])]), "label").first()["loss"] == pytest.approx(math.log(2))


def test_loss_of_large_logits(spark):
    row = metrics.evaluate(logits(spark, [(1, [1000.0, 0.0]), (0, [5.0, 0.0])]), "label").first()
    assert row["loss"] == pytest.approx(1000.0)


def test_only_padding_is_null(spark):
    row = metrics.evaluate(logits(spark, [(0, [1.0, 0.0])]), "label").first()
    assert tuple(row) == (None, None, None)


def test_plain_accuracy_counts_hits_on_padding(spark):
    row = metrics.evaluate(logits(spark, [(1, [0.0, 1.0]), (0, [1.0, 0.0])]), "label").first()
    assert (row["accuracy"], row["accuracy_strict"]) == (2.0, 1.0)


def test_argmax_takes_the_first(spark):
    assert logits(spark, [(1, [0.0, 3.0, 3.0])]).first()["predicted"] == 1


def test_rates(spark):
    def rate(step, **options):
        return spark.range(1).select(scoring.learning_rate(F.lit(step), **options).alias("r")).first()["r"]

    assert rate(0) == 0.0 and round(rate(4000), 6) == 0.001086
    assert rate(4000) == pytest.approx(212**-0.5 * 4000**-0.5) and rate(8000) < rate(4000) > rate(3999)
    assert rate(17, fixed=True) == 2.5e-5


def runs(spark, **losses):
    rows = [(run, i, 1.0, float(v), 0.5, i / 10) for run, vs in losses.items() for i, v in enumerate(vs, 1)]
    return spark.createDataFrame(
        rows,
        "run_id string, epoch int, loss double, val_loss double, masked_accuracy double, val_masked_accuracy double",
    )


def test_early_stop_and_what_follows(spark, rows):
    df = runs(spark, stops=[3, 2, 2, 2, 2, 2, 2, 1], runs=[5, 4, 4.5, 3], one=[1])
    assert rows(history.early_stop(df)) == [("one", 1, None), ("runs", 4, None), ("stops", 2, 7)]
    assert rows(history.best_epochs(df)) == [
        ("one", 1, 1.0), ("runs", 1, 5.0), ("runs", 2, 4.0), ("runs", 4, 3.0), ("stops", 1, 3.0), ("stops", 2, 2.0)
    ]
    summary = {r["run_id"]: r for r in history.run_summary(df, steps=1000).collect()}
    assert (summary["stops"]["last_epoch"], summary["stops"]["val_loss"]) == (7, 2.0)
    assert summary["runs"]["stopped_epoch"] is None and summary["runs"]["final_rate"] == 0.001086


def test_tiers(spark, rows):
    df = runs(spark, a=[9, 0.19], b=[0.2], c=[0.5], d=[0.1, 0.49])
    tiers = {r["run_id"]: r["tier"] for r in history.performance_tier(df).collect()}
    assert tiers == {"a": "excellent", "b": "good", "c": "needs training", "d": "good"}


def test_series(spark, rows):
    assert rows(history.loss_series(runs(spark, a=[2.0]))) == [
        ("a", 1, "Training Loss", 1.0), ("a", 1, "Validation Loss", 2.0)
    ]


def test_an_epoch_without_validation_loss_does_not_improve(spark, rows):
    df = runs(spark, a=[9, 3, 4]).withColumn("val_loss", F.when(F.col("epoch") > 1, F.col("val_loss")))
    assert rows(history.best_epochs(df)) == [("a", 2, 3.0)]
