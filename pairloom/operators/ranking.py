"""Exact global ranks and order statistics without sorting all rows in one task."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OFFSET_ROWS = 1 << 20  # most rows an offset table may have when it is broadcast


def hash_key(*parts) -> Column:
    """md5 of the parts joined by ``|``: an order that any engine and any partitioning reproduces."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def _with_ranks(rows: DataFrame, order: list[str], groups: list[str]) -> DataFrame:
    """Rank rows that carry an ordered ``bucket``: offset of the bucket plus position within it."""
    running = W.partitionBy(*groups).orderBy("bucket") if groups else W.orderBy("bucket")
    whole = W.partitionBy(*groups) if groups else W.partitionBy()
    offsets = (
        rows.groupBy(*groups, "bucket")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            *groups,
            "bucket",
            (F.sum("size").over(running) - F.col("size")).alias("offset"),
            F.sum("size").over(whole).alias("total"),
        )
    )
    inside = F.row_number().over(W.partitionBy(*groups, "bucket").orderBy(*order)) - 1
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(offsets), [*groups, "bucket"])
        .withColumn("rank", F.col("offset") + F.col("inside"))
        .drop("bucket", "inside", "offset")
    )


def rank_by_hash(rows: DataFrame, key: str, tie: str, groups: list[str] = [], group_count: int = 1) -> DataFrame:
    """Add ``rank`` (from 0) by (``key``, ``tie``) and ``total``, per group.

    ``key`` is hexadecimal and evenly spread, so its first digits are balanced buckets whatever the ids look like.
    Their number is fixed, so the broadcast offsets never pass ``OFFSET_ROWS`` rows.
    """
    digits = max(1, min(4, int(math.log(OFFSET_ROWS / max(1, group_count), 16))))
    if group_count * 16**digits > OFFSET_ROWS:
        raise ValueError(f"{group_count} groups need more than {OFFSET_ROWS} offsets; rank fewer groups at a time")
    return _with_ranks(rows.withColumn("bucket", F.substring(key, 1, digits)), [key, tie], groups)


def even_bounds(
    ends: tuple[int, int, int],
    counted: Callable[[list[tuple[int, int, int]]], list[tuple[int, int]]],
    rows_per_bucket: int = 1_000_000,
    cells: int = 8192,
) -> list[int]:
    """Whole numbers that cut ``ends = (least, largest, how many)`` into ranges of about ``rows_per_bucket`` (8 at least).

    ``counted`` gives (start, rows) of the cells of the given ranges (low, high, width of a cell). Cells that hold too
    many rows are counted again in finer ones. A pass asks for at most ``cells`` counts.
    """
    low, high, n = ends
    if not n:
        return []
    target = max(1, min(rows_per_bucket, n // 8))
    todo, sizes = [(low, high)], []
    while todo:
        share = max(2, cells // len(todo))
        ranges = [(low, high, (high - low) // share + 1) for low, high in todo]
        found, again = counted(ranges), []
        for low, high, width in ranges:
            for cell, count in found:
                if low <= cell <= high:
                    end = min(high, cell + width - 1)
                    if count > target and cell < end and len(again) < cells // 8:
                        again.append((cell, end))
                    else:
                        sizes.append((cell, count))
        todo = again
    bounds, held = [], 0
    for start, count in sorted(sizes):
        if held and held + count > target:
            bounds.append(start)
            held = 0
        held += count
    return bounds


def quantile_bounds(rows: DataFrame, column: str, rows_per_bucket: int = 1_000_000, cells: int = 8192) -> list[int]:
    """``even_bounds`` of a column of whole numbers; its counts are combined within each task."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()

    def counted(ranges):
        cell = F.lit(None).cast("bigint")
        for low, high, width in ranges:
            own = F.expr(f"{low}L + ((`{column}` - {low}L) div {width}L) * {width}L")
            cell = F.when(F.col(column).between(low, high), own).otherwise(cell)
        found = rows.groupBy(cell.alias("cell")).count().filter(F.col("cell").isNotNull())
        return [(row["cell"], row["count"]) for row in found.collect()]

    return even_bounds((ends["low"], ends["high"], ends["n"]), counted, rows_per_bucket, cells)


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(int(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= column, low + step).otherwise(low)
    )


def rank_by_id(rows: DataFrame, column: str, bounds: list[int] | None = None) -> DataFrame:
    """Add ``rank`` (from 0) by ``column`` and ``total``. Ranges follow the data, so clustered ids stay balanced.

    The bounds are constants of the plan: a task that runs again puts every row into the same bucket.
    """
    bounds = quantile_bounds(rows, column) if bounds is None else bounds
    return _with_ranks(rows.withColumn("bucket", range_bucket(F.col(column), bounds)), [column], [])


def smallest_by_hash(rows: DataFrame, key: Column, tie: str, fraction: float) -> tuple[str, int] | None:
    """The last (key, tie) among the ``ceil(fraction * n)`` smallest, or None if that is no row.

    Rows are only counted per bucket, once; then one bucket is sorted. Nothing is shuffled whole.
    """
    hashed = rows.select(key.alias("key"), F.col(tie).alias("tie")).withColumn("bucket", F.substring("key", 1, 4))
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    running = F.sum("size").over(W.orderBy("bucket"))
    wanted = F.ceil(F.lit(float(fraction)) * F.sum("size").over(W.partitionBy()))
    upto = sizes.select("bucket", "size", running.alias("upto"), wanted.alias("wanted"))
    hit = upto.filter((F.col("wanted") > 0) & (F.col("upto") >= F.col("wanted"))).orderBy("upto").first()
    if hit is None:
        return None
    rest = hit["wanted"] - (hit["upto"] - hit["size"])
    inside = hashed.filter(F.col("bucket") == hit["bucket"])
    ranked = inside.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("key", "tie")))
    last = ranked.filter(F.col("rank") == rest).first()
    return last["key"], last["tie"]


def smallest_by_id(rows: DataFrame, column: str, place: Callable[[int], int], cells: int = 4096) -> int | None:
    """The value that is ``place(n)``-th smallest of ``n`` whole numbers, by counting in ever finer cells.

    None if there is no such place.
    """
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    take = place(ends["n"])
    if take < 1 or take > ends["n"]:
        return None
    low, high = ends["low"], ends["high"]
    while low < high:
        width = (high - low) // cells + 1
        cell = F.expr(f"(`{column}` - {low}L) div {width}L")
        sizes = rows.filter(F.col(column).between(low, high)).groupBy(cell.alias("cell")).count().orderBy("cell")
        for row in sizes.collect():  # at most ``cells`` rows
            if take <= row["count"]:
                low, high = low + row["cell"] * width, min(high, low + (row["cell"] + 1) * width - 1)
                break
            take -= row["count"]
    return low
