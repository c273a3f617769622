"""Texts of an Arrow batch as one byte array, and hashes of the words and byte strings in it.

The Python operators of this folder see a batch of documents as pieces: consecutive UTF-8 bytes with the bounds of each
document. Everything below works on whole pieces, so no Python code runs per byte or per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # travels with the tasks that use it

#: Small enough for a processor's cache.
PIECE = 1 << 17
#: Fixed odd multipliers; any odd numbers would do.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0, BASE^1, ... and their inverses modulo 2^64, kept per worker and grown by doubling."""
    if len(_powers.get("up", ())) < size:
        n = 1 << max(16, int(size - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
                out = np.full(n, np.uint64(base))
                out[0] = 1
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:size], _powers["down"][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * MIX_1
        x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of the bytes, one more than there are bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end); equal strings have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] numbers, then the same for the next."""
    size = np.asarray(size, dtype=np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(start, dtype=np.int64) - (ends - size), size) + np.arange(total, dtype=np.int64)


def united(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a key in one, ordered by key and start; positions are below 2^40."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    shift = np.cumsum(np.append(False, key[1:] != key[:-1])) * (1 << 40)
    reach = np.maximum.accumulate(end + shift) - shift
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return key[first], start[first], reach[np.append(first[1:], len(key)) - 1]


@dataclass
class Piece:
    """Rows [first, last) of a batch: their bytes, and len(rows) + 1 bounds within them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[Piece]:
    """The text column in pieces of about ``size`` bytes; a longer text is a piece of its own. Null texts count as empty."""
    values = batch.column(column)
    values = pa.compute.fill_null(values.cast(pa.large_binary()), b"")
    if not len(values):
        return
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, len(values))
        yield Piece(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a piece: byte spans, 64-bit hashes, and for each row the bounds within these."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(piece: Piece, lower: bool = False) -> Words:
    """Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    data = LOWER[piece.data] if lower else piece.data
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[piece.bounds] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sums = prefix_sums(data)
    return Words(start, end, span_hashes(sums, start, end), np.searchsorted(start, piece.bounds))


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words at every word of the piece, and which of them stay within their row."""
    n = len(found.hashes)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for k in range(width):
            factor = factor * int(BASE) % (1 << 64)
            out[: max(0, n - k)] += found.hashes[k:] * np.uint64(factor)
    last = np.repeat(found.bounds[1:], np.diff(found.bounds))
    return mix(out), np.arange(n) + width <= last


def binary_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive byte strings of the given sizes as an Arrow column."""
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def list_array(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive lists of the given sizes as an Arrow column."""
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a list column; null lists count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=bounds[1:])
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False), bounds


def binary_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and bounds of a binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)
