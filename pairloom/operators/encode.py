"""Texts to fixed-length id sequences and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import sequences as S
from pairloom.functions.text import words
from pairloom.settings import MASK, SENTINELS, SENTINELS_START, SEQUENCE_LENGTH, UNK, VOCABULARY_BOUND
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)


def _entries(vocabulary: DataFrame) -> pa.Table:
    """Tokens and ids, one table of a checked size for every task."""
    found = vocabulary.select("token", F.col("id").cast("int").alias("id")).limit(VOCABULARY_BOUND + 1).toArrow()
    if found.num_rows > VOCABULARY_BOUND:
        raise ValueError(f"a vocabulary may have {VOCABULARY_BOUND} entries at most")
    return found


def _lists(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Flat values of a list column and the bounds of its lists from 0."""
    size = pc.fill_null(pc.list_value_length(column), 0)
    return pc.list_flatten(column), pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])


PIECES = 1 << 18  # list entries worked on at a time


def sliced(batches, column: str, pieces: int | None = None):
    """Slices of the batches with at most ``pieces`` list entries in the column (or one row), so long lists need no more memory than short ones."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + (pieces or PIECES), "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _to_ids(batches, shared, columns: list[str], unknown: int):
    tokens, ids = shared.value.column("token").combine_chunks(), shared.value.column("id").combine_chunks()
    for batch in batches:
        out = {name: batch.column(name) for name in batch.schema.names}
        for name in columns:
            values, bounds = _lists(batch.column(name))
            found = pc.fill_null(pc.take(ids, pc.index_in(values, value_set=tokens)), unknown)
            out[name] = pa.ListArray.from_arrays(bounds, found)
        yield pa.RecordBatch.from_pydict(out)


def encode_ids(
    texts: DataFrame,
    vocabulary: DataFrame,
    columns: dict[str, int],
    key: str = "pair_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Replace each text column by its token ids, at most ``columns[name] - 2`` of them.

    A narrow step: texts become cut token arrays in the JVM, and each Arrow batch looks all its tokens up in the
    vocabulary at once, which goes to the tasks as one table of a checked size. Rows stay apart whatever their keys.
    Texts without tokens keep an empty array.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_entries(vocabulary))
    cut = [F.coalesce(S.truncate(words(F.col(c)), limit), F.array().cast("array<string>")).alias(c) for c, limit in columns.items()]
    tokens = texts.select(key, *keep, *cut)
    kinds = [f"`{f.name}` {'array<int>' if f.name in columns else f.dataType.simpleString()}" for f in tokens.schema]
    names = list(columns)
    return tokens.mapInArrow(lambda batches: _to_ids(batches, shared, names, UNK), ", ".join(kinds))


def teacher_forced(ids: DataFrame, source_length: int = SEQUENCE_LENGTH, target_length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``input_ids`` plus the target shifted for teacher forcing: ``targ_in`` without the last, ``targ_out`` without the first id."""
    framed = S.frame(F.col("code"), target_length)
    return ids.select(
        "pair_id",
        "split",
        S.frame(F.col("title"), source_length).cast("array<int>").alias("input_ids"),
        S.target_in(framed, target_length).cast("array<int>").alias("targ_in"),
        S.target_out(framed, target_length).cast("array<int>").alias("targ_out"),
    )


def encode_pairs(
    pairs: DataFrame,
    vocabulary: DataFrame,
    source_length: int = SEQUENCE_LENGTH,
    target_length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """``encoded(pair_id, split, input_ids, targ_in, targ_out)`` of a split pair table."""
    ids = encode_ids(pairs, vocabulary, {"title": source_length, "code": target_length}, keep=("split",))
    return teacher_forced(ids, source_length, target_length)


def _to_text(batches, shared, key: str, separator: str):
    size = max([0, *shared.value.column("id").to_pylist()]) + 1
    by_id: list[str | None] = [None] * size
    for token, number in zip(shared.value.column("token").to_pylist(), shared.value.column("id").to_pylist()):
        by_id[number] = token
    tokens = pa.array(by_id, pa.string())
    for batch in sliced(batches, "ids"):
        values, bounds = _lists(batch.column("ids"))
        inside = pc.and_(pc.greater_equal(values, 0), pc.less(values, size))
        found = pc.take(tokens, pc.if_else(inside, values, pa.scalar(None, values.type)))
        known = pc.is_valid(found)
        upto = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(known.cast(pa.int32()))])
        lists = pa.ListArray.from_arrays(pc.take(upto, bounds), pc.drop_null(found))
        yield pa.RecordBatch.from_pydict({key: batch.column(key), "text": pc.binary_join(lists, separator)})


def decode_text(rows: DataFrame, vocabulary: DataFrame, key: str, ids: str, separator: str = " ") -> DataFrame:
    """Ids back to text without reserved tokens; words are joined with ``separator``. Narrow, like ``encode_ids``."""
    reserved = (F.col("id") <= MASK) | F.col("id").between(SENTINELS_START, SENTINELS_START + SENTINELS - 1)
    shared = rows.sparkSession.sparkContext.broadcast(_entries(vocabulary.filter(~reserved)))
    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.select(key, F.coalesce(ids, F.array()).cast("array<int>").alias("ids"))
    return wanted.mapInArrow(lambda batches: _to_text(batches, shared, key, separator), f"`{key}` {kind}, text string")
