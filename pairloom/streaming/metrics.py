"""Running loss and accuracy per epoch while scored batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.metrics import evaluate, score_logits

LOGITS_SCHEMA = "vec_id bigint, embedding array<float>, label int"


def read_logits(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(LOGITS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_metrics(rows: DataFrame, folder: str, checkpoint: str, **trigger):
    """Metrics so far per epoch, written at every update. The state is a few sums per epoch.

    ``trigger`` is that of Structured Streaming; by default what has arrived is worked off.
    """
    scored = score_logits(rows, "label", "embedding")
    totals = evaluate(scored, "label", by=("epoch",))
    query = (
        totals.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch_id={n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    return query.start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest update of each epoch."""
    updates = spark.read.parquet(folder)
    values = [c for c in updates.columns if c not in ("epoch", "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return updates.groupBy("epoch").agg(newest).select("epoch", *[f"v.{c}" for c in values])
