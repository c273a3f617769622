"""Stages on shared storage: cleaned splits, vocabularies and histories."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.settings import VOCABULARY_BOUND

HISTORY_SCHEMA = (
    "run_id string, epoch int, loss double, val_loss double, masked_accuracy double, val_masked_accuracy double"
)


def write_cleaned(pairs: DataFrame, path: str) -> None:
    """Save named splits; a reader of one split touches only its folder."""
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)


def load_cleaned(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no cleaned data at {path}: build the stage first, or force a rebuild") from error


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its ``_SUCCESS`` mark at the path, on any file system."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def is_current(spark: SparkSession, path: str, parameters: dict | None = None) -> bool:
    """Whether the stage is finished and was built with these parameters."""
    if not stage_done(spark, path):
        return False
    if parameters is None:
        return True
    noted = f"{path}-parameters"
    return stage_done(spark, noted) and spark.read.parquet(noted).first()["parameters"] == _noted(parameters)


def fingerprint(table: DataFrame) -> str:
    """What a table holds, whatever the order of its rows and files: names and types, rows, and sums of two row hashes.

    Sums count repeated rows. Nulls are hashed apart from values, so a value that changes its column is a change.
    """
    columns = [part for name in table.columns for part in (F.isnull(F.col(f"`{name}`")), F.col(f"`{name}`"))]
    hashes = (F.xxhash64(F.lit(mark), *columns).cast("decimal(20,0)") for mark in ("one", "other"))
    sums = [F.coalesce(F.sum(h), F.lit(0)).cast("string") for h in hashes]
    row = table.agg(F.count(F.lit(1)).cast("string").alias("n"), sums[0].alias("a"), sums[1].alias("b")).first()
    return "/".join([table.schema.simpleString(), row["n"], row["a"], row["b"]])


def _noted(parameters: dict) -> str:
    return json.dumps(parameters, sort_keys=True, default=str)


def note_parameters(spark: SparkSession, path: str, parameters: dict | None) -> None:
    """Keep what a stage was built with beside it."""
    if parameters is not None:
        write_table(spark.createDataFrame([(_noted(parameters),)], "parameters string"), f"{path}-parameters")


def build_or_load(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, parameters: dict | None = None
) -> DataFrame:
    """Load the stage at ``path`` when it is finished with the same parameters and not forced; otherwise build, save and load it."""
    if force or not is_current(spark, path, parameters):
        write_cleaned(build(), path)
        note_parameters(spark, path, parameters)
    return load_cleaned(spark, path)


def append_history(history: DataFrame, path: str) -> None:
    history.select(*[f.split()[0] for f in HISTORY_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    """Save a learned table: a vocabulary or a list of merges."""
    table.write.mode("overwrite").parquet(path)


def _bounded(table: DataFrame) -> DataFrame:
    size = table.count()
    if size > VOCABULARY_BOUND:
        raise ValueError(f"{size} entries: a vocabulary may have {VOCABULARY_BOUND} at most")
    return table


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A saved vocabulary, checked to be small enough for the broadcast joins that use it."""
    return _bounded(spark.read.parquet(path))


def load_merges(spark: SparkSession, path: str) -> DataFrame:
    """Saved byte-pair merges ``(place, left, right, n)``, checked like a vocabulary."""
    return _bounded(spark.read.parquet(path).select("place", "left", "right", "n"))
