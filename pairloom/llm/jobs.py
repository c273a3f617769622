"""Steps that several operators of this folder share: staged tables, sizes, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.workspace import new_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go as soon as the table is complete."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the named types; what else the table holds plays no part."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node that can be reached.

    Alternating large-star and small-star steps: every step replaces edges by edges to the smallest neighbour, whose
    number never grows, until each component is a star. Each step is a grouped minimum (combined before its shuffle) and
    a join, and is staged, so no lineage and no component is ever held in one place.
    """
    def shape(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        return tuple(row)

    edges = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = shape(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, name)
        now = shape(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", F.col("b")))
