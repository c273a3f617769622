"""Named splits, exact and hashed, and the steps that follow from their sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import hash_key, smallest_by_hash, smallest_by_id
from pairloom.settings import SEED, TEST_FRACTION, TRAIN_BATCH, VALIDATION_BATCH


def split_disabled(pairs: DataFrame) -> DataFrame:
    """Everything is training data."""
    return pairs.withColumn("split", F.lit("train"))


def split_fraction(pairs: DataFrame, fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """About ``fraction`` of the rows to ``test``, by a hash of the id: one narrow pass, the same rows on any cluster.

    The hash decides in thousandths, so a finer fraction is an error.
    """
    if not 0 <= fraction <= 1 or abs(fraction * 1000 - round(fraction * 1000)) > 1e-9:
        raise ValueError(f"{fraction} is no whole number of thousandths; split_exact takes any fraction")
    digits = F.substring(hash_key(seed, F.col("pair_id")), 1, 8)
    bucket = F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(1000))
    return pairs.withColumn("split", F.when(bucket < round(fraction * 1000), "test").otherwise("train"))


def split_exact(pairs: DataFrame, fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Exactly ``ceil(fraction * n)`` rows to ``test``, chosen by hash. Rows are compared with one cut-off, not sorted."""
    key = hash_key(seed, F.col("pair_id"))
    last = smallest_by_hash(pairs, key, "pair_id", fraction)
    if last is None:
        return split_disabled(pairs)
    h, tie = last
    inside = (key < h) | ((key == h) & (F.col("pair_id") <= tie))
    return pairs.withColumn("split", F.when(inside, "test").otherwise("train"))


def split_tail(pairs: DataFrame, fraction: float = TEST_FRACTION) -> DataFrame:
    """The last ``ceil(fraction * n)`` ids are ``test``, again by one cut-off."""
    cut = smallest_by_id(pairs, "pair_id", lambda n: n - math.ceil(fraction * n) + 1)
    if cut is None:
        return split_disabled(pairs)
    return pairs.withColumn("split", F.when(F.col("pair_id") >= cut, "test").otherwise("train"))


def split_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def steps_per_epoch(
    pairs: DataFrame,
    train_batch: int = TRAIN_BATCH,
    validation_batch: int = VALIDATION_BATCH,
    count: str = "after_split",
) -> DataFrame:
    """Whole training batches and started validation batches. ``count="before_split"`` counts all rows for training."""
    counted = F.lit(True) if count == "before_split" else F.col("split") == "train"
    return pairs.agg(
        F.count_if(counted).alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows")
    ).select(
        "train_rows",
        "test_rows",
        F.expr(f"train_rows div {train_batch}").alias("train_steps"),
        F.ceil(F.col("test_rows") / validation_batch).alias("validation_steps"),
    )
