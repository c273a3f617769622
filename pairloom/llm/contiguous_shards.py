"""Shards of nearly equal size by minimax contiguous partition of atomic groups, in DataFrame functions only.

Documents with equal texts form a group, which is never cut. Groups are ordered by their smallest doc_id, and the ordered
sequence is cut into at most ``SHARDS`` runs so that the largest run is as small as any cut can make it. The smallest
feasible capacity is found by search: a capacity is feasible when filling shard after shard greedily uses at most
``SHARDS`` of them. One job tests ``TRIES`` capacities at once for one shard each, and it needs only the largest running
total below a bound, so it reads one column of the few row groups in reach (the table is written in order).

Running totals are taken within range partitions and shifted by the totals of the partitions before them; slots are ranks
within hash buckets of a shard, shifted likewise. Both offset tables have a row per shuffle partition (and shard). A hot
group is one row from its partial aggregation on, and its documents are joined back through a skew-splitting join.

Defined cases: a null text is a group of its own, of size 1 per document; rows without a doc_id come first in order;
repeated rows are counted and numbered each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import jobs

SHARDS = 8
TRIES = 32


def ordered_groups(sized: DataFrame) -> DataFrame:
    """(key, bytes, upto) per group, staged in order; upto is the running total of bytes, the group's own included."""
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = sized.groupBy("key").agg(
        F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("first"), F.sum("size").alias("bytes")
    )
    ranged = groups.repartitionByRange(parts, "first", "key").withColumn("part", F.spark_partition_id())
    ranged = jobs.staged(ranged, "shard-groups")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = ranged.groupBy("part").agg(F.sum("bytes").alias("total"))
    offsets = offsets.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("sum", F.sum("bytes").over(within)).join(F.broadcast(offsets), "part")
    return jobs.staged(summed.select("part", "key", "bytes", (F.col("sum") + F.col("offset")).alias("upto")), "shard-totals")


def smallest_cuts(groups: DataFrame, shards: int, tries: int = TRIES) -> list[int]:
    """Running totals at which the shards of the smallest feasible capacity end."""
    total, largest = groups.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return []

    def fill(capacities: list[int]) -> list[list[int]]:
        """The greedy cuts of every capacity; the last one is the total when it is feasible."""
        cuts = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(shards):
            open_ = [k for k, x in enumerate(at) if x < total]
            if not open_:
                break
            bounds = {k: at[k] + capacities[k] for k in open_}
            reach = groups.where(F.col("upto").between(min(bounds.values()) - largest, max(bounds.values())))
            row = reach.agg(*(F.max(F.when(F.col("upto") <= bounds[k], F.col("upto"))).alias(str(k)) for k in open_)).first()
            for k in open_:
                at[k] = row[str(k)]
                cuts[k].append(at[k])
        return cuts

    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest  # always feasible
    best = None
    while low < high or best is None:
        step = max(1, -(-(high - low) // tries))
        capacities = list(range(low, high, step))[:tries] + [high]
        found = fill(capacities)
        good = next(k for k, cuts in enumerate(found) if cuts[-1] == total)
        high, best = capacities[good], found[good]
        low = capacities[good - 1] + 1 if good else high
    return best


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard (null)."""
    spark = docs.sparkSession
    docs = jobs.with_columns(docs, doc_id="long", text="string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    key = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null"))
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    sized = jobs.staged(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("key")), "shard-sizes")
    groups = ordered_groups(sized)
    cuts = smallest_cuts(groups, shards)
    number = sum((F.when(F.col("upto") > cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0))
    placed = sized.join(groups.select("key", number.cast("int").alias("shard")), "key")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    placed = jobs.staged(placed.drop("key"), "shard-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    count = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = count.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    placed = placed.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
