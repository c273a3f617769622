"""Word vocabularies, corpus chunks and the table of reserved tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.text import words
from pairloom.operators.ranking import rank_by_id
from pairloom.settings import CHUNK_ROWS, MARKS, MASK, ROLES, SENTINELS, SENTINELS_START, VOCABULARY_SIZE
from pairloom.workspace import stage


def special_tokens(spark: SparkSession) -> DataFrame:
    """The reserved ids with their text, flags and roles."""
    mark = F.get(F.array(*[F.lit(m) for m in MARKS]), F.col("n").cast("int"))
    sentinel = F.concat(F.lit("<extra_id_"), F.lit(SENTINELS + len(MARKS) - 1) - F.col("n"), F.lit(">"))
    is_mark = F.col("n") < len(MARKS)
    roles = [F.when(F.col("token") == text, role) for role, text in sorted(ROLES.items())]
    return (
        spark.range(0, len(MARKS) + SENTINELS, 1, 1)
        .select(F.col("id").alias("n"))
        .select(
            F.when(is_mark, F.col("n")).otherwise(F.col("n") + SENTINELS_START - len(MARKS)).cast("int").alias("id"),
            F.when(is_mark, mark).otherwise(sentinel).alias("token"),
            (F.col("n") >= MASK).alias("lstrip"),
            F.lit(True).alias("normalized"),
            F.lit(False).alias("rstrip"),
            F.lit(False).alias("single_word"),
            F.lit(True).alias("special"),
        )
        .withColumn("roles", F.concat_ws(",", *roles))
    )


def corpus_chunks(pairs: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the training rows in id order and cut them into chunks of ``rows``."""
    ids = stage(pairs.filter(F.col("split") == "train").select("pair_id"), "chunk_ids")  # texts are read once
    ranked = rank_by_id(ids, "pair_id")
    return ranked.select("pair_id", F.expr(f"rank div {rows}").alias("chunk_id"))


def token_counts(texts: DataFrame, column: str) -> DataFrame:
    """How often each token occurs. Counted within each task first, so a very common token costs one row per task."""
    return (
        texts.select(F.explode(words(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def learn_words(texts: DataFrame, column: str = "code", size: int = VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent tokens with ids behind the reserved ones. Never more than ``size`` rows.

    A histogram of the counts gives the least count that is kept, so only tokens with exactly this count are sorted to
    choose among.
    """
    counts = stage(token_counts(texts, column), "token_counts")
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    above = F.coalesce(F.sum("tokens").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = sizes.withColumn("above", above).filter(F.col("above") < size).orderBy("n").first()
    if least is None:
        kept = counts.limit(0)
    else:
        ties = counts.filter(F.col("n") == least["n"]).orderBy("token").limit(size - least["above"])
        kept = counts.filter(F.col("n") > least["n"]).unionByName(ties)
    place = F.row_number().over(W.orderBy(F.desc("n"), "token")) + MASK
    return kept.select(
        "token", F.when(place < SENTINELS_START, place).otherwise(place + SENTINELS).alias("id"), "n"
    )


def full_vocabulary(learned: DataFrame) -> DataFrame:
    """Learned and reserved entries together."""
    reserved = special_tokens(learned.sparkSession).select("token", "id", F.lit(0).cast("bigint").alias("n"))
    return learned.unionByName(reserved)
