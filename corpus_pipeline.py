"""A training corpus from the documents table, in five stages; each works on all that its predecessor kept.

1. language_id: documents whose language cannot be told (no letters, or no language with half of the posterior) go.
2. ngram_jaccard: of the documents connected by 5-word shingle sets with a Jaccard similarity of 0.8 or more, the one with
   the smallest doc_id stays; rows that repeat a doc_id with its text are one.
3. decontaminate: documents that contain a passage of the benchmark go.
4. mix: documents come as often as the target weights of their domains ask for, which may be not at all.
5. shard: every row gets its shard and slot.

Stages 1 to 4 return the columns of documents. Rows without a doc_id stay in stage 2, where they cannot be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import contiguous_shards, decontaminate, jaccard_join, jobs, language_id, soft_mixing

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identified(language_id.of_documents(docs))
    accepted = found.where("accepted").select(F.col("id").alias("_accepted_id")).distinct()
    return docs.join(accepted, F.col("doc_id").cast("long").eqNullSafe(F.col("_accepted_id")), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.linked(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias("_first_id")).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col("_first_id"), "left_semi")
    once = kept.withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return once.unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return soft_mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contiguous_shards.sharded(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Likelihoods, components and rates are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written and read again before the next."""
    docs = jobs.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = jobs.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
