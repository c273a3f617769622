"""Column expressions over arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.settings import BOS, EOS, PAD


def truncate(tokens: Column, limit: int) -> Column:
    """First tokens of a sequence, leaving room for the two marks."""
    return F.slice(tokens, 1, limit - 2)


def add_marks(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def pad(ids: Column, limit: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), limit)), 1, limit)


def frame(ids: Column, limit: int) -> Column:
    """``<s> ids </s>`` cut and padded to exactly ``limit`` ids."""
    return pad(add_marks(truncate(ids, limit)), limit)


def pad_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x != PAD)


def without_pads(ids: Column) -> Column:
    return F.filter(ids, lambda x: x != PAD)


def target_in(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit - 1)


def target_out(ids: Column, limit: int) -> Column:
    return F.slice(ids, 2, limit - 1)


def features() -> Column:
    """Nested training element ``((input_ids, targ_in), targ_out)``."""
    return F.struct(F.struct("input_ids", "targ_in").alias("features"), F.col("targ_out"))
