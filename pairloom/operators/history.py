"""Run histories: ``history(run_id, epoch, loss, val_loss, masked_accuracy, val_masked_accuracy)``.

Windows run per run over its epochs; a history has one row per epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.scoring import learning_rate
from pairloom.settings import PATIENCE, TIER_FAIR, TIER_GOOD


def by_epoch():
    return W.partitionBy("run_id").orderBy("epoch")


def _improving(history: DataFrame) -> DataFrame:
    before = F.min("val_loss").over(by_epoch().rowsBetween(W.unboundedPreceding, -1))
    better = F.col("val_loss").isNotNull() & (before.isNull() | (F.col("val_loss") < before))
    return history.withColumn("improved", better)


def early_stop(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Per run the first epoch that is ``patience`` epochs behind the best one, or NULL, and the best epoch up to it."""
    best = F.max(F.when(F.col("improved"), F.col("epoch"))).over(by_epoch())
    waited = _improving(history).withColumn("best", best)
    stop = F.min(F.when(F.col("epoch") - F.col("best") >= patience, F.col("epoch")))
    return (
        waited.withColumn("stop", stop.over(W.partitionBy("run_id")))
        .filter(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
        .groupBy("run_id")
        .agg(F.max("best").alias("best_epoch"), F.first("stop").alias("stopped_epoch"))
    )


def until_stop(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """The epochs that were run: everything up to the early stop."""
    stops = early_stop(history, patience).select("run_id", "stopped_epoch")
    return history.join(stops, "run_id").filter(
        F.col("stopped_epoch").isNull() | (F.col("epoch") <= F.col("stopped_epoch"))
    )


def best_epochs(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Epochs whose weights would be kept: each improves on all earlier ones."""
    kept = _improving(until_stop(history, patience)).filter("improved")
    return kept.select("run_id", "epoch", "val_loss")


def loss_series(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """The two loss curves up to the early stop as (run_id, epoch, series, value)."""
    curves = until_stop(history, patience).select(
        "run_id", "epoch", F.col("loss").alias("Training Loss"), F.col("val_loss").alias("Validation Loss")
    )
    return curves.unpivot(["run_id", "epoch"], ["Training Loss", "Validation Loss"], "series", "value")


def performance_tier(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """How good the validation loss of the last epoch is that each run came to."""
    last = until_stop(history, patience).groupBy("run_id").agg(F.max_by("val_loss", "epoch").alias("val_loss"))
    tier = F.when(F.col("val_loss") < TIER_GOOD, "excellent").when(F.col("val_loss") < TIER_FAIR, "good")
    return last.withColumn("tier", tier.otherwise("needs training"))


def run_summary(history: DataFrame, steps: int, patience: int = PATIENCE, **rate) -> DataFrame:
    """Final learning rate, stop, last validation loss and accuracy of each run."""
    ran = until_stop(history, patience).groupBy("run_id").agg(
        F.max("epoch").alias("last_epoch"),
        F.first("stopped_epoch").alias("stopped_epoch"),
        F.max_by("val_loss", "epoch").alias("val_loss"),
        F.max_by("val_masked_accuracy", "epoch").alias("val_masked_accuracy"),
    )
    return ran.withColumn("final_rate", F.round(learning_rate(F.col("last_epoch") * steps, **rate), 6))


def history_from_events(events: DataFrame, per_type: bool = True) -> DataFrame:
    """A history out of an event table: days are epochs, even users train, odd users validate.

    The accuracy columns are the shares of events with a value above 50. Values are added as decimals, so the order
    in which tasks finish cannot change a loss.
    """
    train = F.col("user_id") % 2 == 0
    run = F.col("event_type") if per_type else F.lit("all")
    value, above = F.col("value").cast("decimal(20,6)"), (F.col("value") > 50).cast("double")

    def mean(rows):
        total, n = F.sum(F.when(rows, value)), F.count_if(rows)
        return F.round(F.try_divide(total, n), 6).cast("double")

    return events.groupBy(run.alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(
        mean(train).alias("loss"),
        mean(~train).alias("val_loss"),
        F.round(F.avg(F.when(train, above)), 6).alias("masked_accuracy"),
        F.round(F.avg(F.when(~train, above)), 6).alias("val_masked_accuracy"),
    )
