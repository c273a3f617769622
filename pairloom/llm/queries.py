"""The queries of this folder: every operator over its whole table, with the columns of its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    bpe_codec,
    compact_windows,
    contiguous_shards,
    decontaminate,
    hard_negatives,
    jaccard_join,
    jobs,
    language_id,
    repetition,
    secret_links,
    soft_mixing,
    suffix_dedup,
    token_alignment,
    toxicity,
)
from pairloom.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.deduplicated(jobs.documents(spark, sf)).drop("kept")


@query
def op6_repetition_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.judged(jobs.documents(spark, sf))


@query
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked(jobs.documents(spark, sf), width=3, percent=90)


@query
def op10_secret_links(spark: SparkSession, sf: str) -> DataFrame:
    return secret_links.scanned(jobs.documents(spark, sf))


@query
def op4_contiguous_shards(spark: SparkSession, sf: str) -> DataFrame:
    return contiguous_shards.sharded(jobs.documents(spark, sf))


@query
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Contaminated documents only, with the items found in them."""
    found = decontaminate.contaminated(jobs.documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select("doc_id", "n_hits", "items")


@query
def op1_compact_windows(spark: SparkSession, sf: str) -> DataFrame:
    return compact_windows.passages(jobs.documents(spark, sf))


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = language_id.identified(language_id.of_documents(jobs.documents(spark, sf)))
    return found.withColumnRenamed("id", "doc_id")


@query
def language_id_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator over web pages, with the language their markup declares and their addresses."""
    found = language_id.identified(language_id.of_pages(spark.read.parquet(f"{sf}/pages.parquet")))
    return found.withColumnRenamed("id", "page_id")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(jobs.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op8_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return soft_mixing.rated(jobs.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op12_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    done = bpe_codec.round_trip(spark, jobs.documents(spark, sf))
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.aligned(spark, jobs.documents(spark, sf))


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.mined(spark.read.parquet(f"{sf}/embeddings.parquet"))
