"""Epochs and batches as columns: ``batches(epoch, batch_id, slot, pair_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import hash_key, rank_by_hash, rank_by_id
from pairloom.settings import EPOCHS, SEED, TRAIN_BATCH, VALIDATION_BATCH


def epoch_repeat(rows: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Every row once per epoch, without a shuffle."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def epoch_shuffle(pairs: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """A permutation of the rows per epoch: ``rank`` from 0 in the order of a seeded hash, and the ``total``."""
    rows = epoch_repeat(pairs.select("pair_id"), epochs)
    rows = rows.withColumn("key", hash_key(seed, F.col("epoch"), F.col("pair_id")))
    return rank_by_hash(rows, "key", "pair_id", groups=["epoch"], group_count=epochs).drop("key")


def _place(ranked: DataFrame, size: int, span_epochs: bool) -> DataFrame:
    if span_epochs:
        place = ranked.withColumn("g", F.col("epoch") * F.col("total") + F.col("rank"))
        batch = F.expr(f"g div {size}")
    else:
        place = ranked.withColumn("g", F.col("rank"))
        batch = F.expr(f"epoch * ((total + {size - 1}) div {size}) + g div {size}")
    return place.select("epoch", batch.alias("batch_id"), F.expr(f"cast(g % {size} as int)").alias("slot"), "pair_id")


def train_batches(
    pairs: DataFrame, size: int = TRAIN_BATCH, epochs: int = EPOCHS, seed: int = SEED, span_epochs: bool = True
) -> DataFrame:
    """Shuffled batches. Repeating comes before batching, so a batch may span two epochs unless ``span_epochs`` is off."""
    return _place(epoch_shuffle(pairs, epochs, seed), size, span_epochs)


def validation_batches(pairs: DataFrame, size: int = VALIDATION_BATCH) -> DataFrame:
    """One validation round in id order. The set repeats, so its first rows come again to fill the last batch."""
    ranked = rank_by_id(pairs.select("pair_id"), "pair_id")
    filled = F.expr(f"((total + {size - 1}) div {size}) * {size}")
    rounds = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr(f"({size - 1} div total) + 1").cast("int"))))
    return _place(rounds.filter(F.col("epoch") * F.col("total") + F.col("rank") < filled), size, True)


def limit_steps(batches: DataFrame, steps: int, epochs: int = EPOCHS) -> DataFrame:
    """The training batches a fit takes, ``steps`` per epoch from one running iterator, with the epoch they fall in."""
    taken = batches.filter(F.col("batch_id") < steps * epochs)
    return taken.withColumn("fit_epoch", F.expr(f"batch_id div {max(1, steps)}"))


def export_batches(batches: DataFrame, encoded: DataFrame, path: str) -> None:
    """Write whole batches in order: ranges of ``batch_id`` never cut a batch in two."""
    rows = batches.join(encoded.drop("split"), "pair_id")
    rows.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "slot").write.mode("overwrite").parquet(path)
