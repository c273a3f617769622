"""Counts of distinct integer keys in dense vectors that a minimal perfect hash function indexes.

Keys are dealt to buckets of about ``BUCKET`` keys by an arithmetic rule. A bucket's function has levels of bits: a key sets
its bit on the first level where no other remaining key has the same place, and its slot is the number of set bits before
that one. Counts then are dense vectors, one per bucket and group of tasks, which are summed up a tree of fan-in ``FAN``: no
task ever holds more than FAN vectors of a bucket. The keys stand in a vector of their own, so every lookup is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

BUCKET = 1 << 16
FAN = 16
LEVELS = 64
GAMMA = 2  # places per remaining key

FUNCTION = "bucket int, sizes array<int>, bits binary"
VECTOR = "bucket int, part int, keys array<long>, counts array<long>"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(key, 32) * F.lit(1_000_003) + F.shiftright(key, 16) * F.lit(31) + key % F.lit(1 << 20) * F.lit(7919), F.lit(buckets)).cast("int")


def bucket_numbers(keys: np.ndarray, buckets: int) -> np.ndarray:
    """``bucket_of`` for an array of keys below 2^40."""
    return ((keys >> 32) * 1_000_003 + (keys >> 16) * 31 + keys % (1 << 20) * 7919) % buckets


def places(keys: np.ndarray, level: int, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (packed.mix(keys.astype(np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(level) * packed.BASE) % np.asarray(size, dtype=np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> list[np.ndarray]:
    """Bits of each level of the function for different keys."""
    out, left = [], keys
    while len(left):
        if len(out) == LEVELS:
            raise ValueError("keys of a perfect hash function are not distinct")
        size = GAMMA * len(left) + 1
        at = places(left, len(out), size)
        count = np.bincount(at, minlength=size)
        out.append(count == 1)
        left = left[count[at] > 1]
    return out


class Function:
    """The functions of many buckets side by side: slots of one bucket follow those of the bucket before."""

    def __init__(self, rows: list[dict], buckets: int):
        self.buckets = buckets
        self.depth = max((len(r["sizes"]) for r in rows), default=0)
        self.size = np.zeros((buckets, self.depth + 1), dtype=np.int64)
        self.base = np.zeros((buckets, self.depth + 1), dtype=np.int64)
        bits, total = [np.zeros(0, bool)], 0
        for r in rows:
            sizes = np.array(r["sizes"], dtype=np.int64)
            self.size[r["bucket"], : len(sizes)] = sizes
            self.base[r["bucket"], : len(sizes)] = total + np.cumsum(sizes) - sizes
            bits.append(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=int(sizes.sum())).astype(bool))
            total += int(sizes.sum())
        self.bits = np.concatenate(bits)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; a key outside the set gets any slot or -1, so compare with the key that is kept there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        bucket = bucket_numbers(keys, self.buckets)
        for level in range(self.depth):
            todo = todo[self.size[bucket[todo], level] > 0]
            if not len(todo):
                break
            at = self.base[bucket[todo], level] + places(keys[todo], level, self.size[bucket[todo], level])
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        return out


def _build(table: pa.Table) -> pa.Table:
    bits = build(table.column("key").to_numpy())
    made = {"bucket": [table.column("bucket")[0].as_py()], "sizes": [[len(b) for b in bits]], "bits": [np.packbits(np.concatenate(bits)).tobytes()]}
    return pa.table(made, schema=pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary())]))


def _vectors(bucket: int, part: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    lists = [packed.list_array(v, np.array([len(v)])) for v in (keys.astype(np.int64), counts.astype(np.int64))]
    return pa.Table.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), *lists], names=["bucket", "part", "keys", "counts"])


NO_VECTOR = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]).empty_table()


def _dense(given: pa.Table, functions: pa.Table) -> pa.Table:
    """Counts of one bucket from one group of tasks as a dense vector."""
    if not given.num_rows:
        return NO_VECTOR
    row = {name: functions.column(name)[0].as_py() for name in ("bucket", "sizes", "bits")}
    function = Function([{**row, "bucket": 0}], 1)
    keys, n = given.column("key").to_numpy(), given.column("n").to_numpy()
    slot = function.slots(keys)
    size = int(function.bits.sum())
    counts, kept = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    np.add.at(counts, slot, n)
    kept[slot] = keys
    if (kept[slot] != keys).any():
        raise ValueError("two keys share a slot")
    return _vectors(row["bucket"], given.column("part")[0].as_py(), kept, counts)


def _sum(table: pa.Table) -> pa.Table:
    """Sum of the vectors of one bucket; their keys must agree wherever both have one."""
    keys = counts = None
    for row in range(table.num_rows):
        k, c = (np.asarray(table.column(name)[row].values) for name in ("keys", "counts"))
        if keys is None:
            keys, counts = k.copy(), c.copy()
            continue
        if ((keys >= 0) & (k >= 0) & (keys != k)).any():
            raise ValueError("two keys share a slot")
        keys, counts = np.maximum(keys, k), counts + c
    return _vectors(table.column("bucket")[0].as_py(), table.column("part")[0].as_py() // FAN, keys, counts)


def counted(partial: DataFrame, bucket_keys: int = BUCKET) -> tuple[DataFrame, int]:
    """``(bucket, sizes, bits, keys, counts)`` with the sums of ``partial`` (part int, key long, n long), and the number of buckets.

    ``part`` numbers the tasks that counted; a task gives each key at most a few times.
    """
    distinct = jobs.staged(partial.select("key").distinct(), "keys")
    number, parts = distinct.count(), partial.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    buckets = max(1, -(-number // bucket_keys))
    by_bucket = distinct.withColumn("bucket", bucket_of(F.col("key"), buckets))
    functions = jobs.staged(by_bucket.groupBy("bucket").applyInArrow(_build, FUNCTION), "functions")
    groups = -(-parts // FAN)
    given = partial.select("key", "n", bucket_of(F.col("key"), buckets).alias("bucket"), (F.col("part") / FAN).cast("int").alias("part"))
    each = functions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sums = given.groupBy("bucket", "part").cogroup(each.groupBy("bucket", "part")).applyInArrow(_dense, VECTOR)
    while True:
        sums = jobs.staged(sums, "vectors")
        if groups == 1:
            break
        groups = -(-groups // FAN)
        nearby = sums.withColumn("group", (F.col("part") / FAN).cast("int")).groupBy("bucket", "group")
        sums = nearby.applyInArrow(_sum, VECTOR)
    return functions.join(sums.drop("part"), "bucket"), buckets
