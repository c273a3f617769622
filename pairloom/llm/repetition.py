"""Quality rules over each document's repetition, found with a suffix array of its words.

The suffixes of a document's words are sorted by prefix doubling, and neighbours' longest common prefixes give the
LCP intervals, each of which is a maximal repeated substring. A word position lies in nested intervals; the innermost, the
longer of its two neighbouring prefixes, reaches furthest, so the union of the spans of all maximal repeats of at least
``LEAST`` words is the union of [i, i + longest prefix at i). A document fails when the covered part of its word characters
is over ``COVERED`` or its longest repeat is over ``LONGEST`` words, besides the base rules.

Everything is decided within one document, so there is no shuffle; documents are sorted many at a time, and none can match
another. Defined cases: null, empty and blank texts have no words, hence fail the base rule on the number of words; nulls in
other columns and other columns themselves are ignored; equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

#: Words of a repeat that counts; part of the word characters that repeats may cover; words of the longest repeat allowed.
LEAST = 5
COVERED = 0.2
LONGEST = 100
WINDOW = 5
FEWEST_WORDS = 10
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")
SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS) + ", base_failed boolean, kept boolean"


def longest_prefixes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every word, how many words from there on also follow another word of the same row."""
    n = len(words)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[row + 1]
    order = np.lexsort((words, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (words[order][1:] != words[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # how many suffixes sort before this group
    levels = [rank]
    size = np.diff(np.append(np.flatnonzero(new), n))
    todo = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if size.max() > 1 else np.zeros(0, np.int64)
    step = 1
    while len(todo):  # ranks by 1, 2, 4, ... words; only tied suffixes are sorted again
        later = todo + step
        second = np.where(later < end[todo], rank[np.minimum(later, n - 1)], -1)
        turn = np.lexsort((second, rank[todo]))
        todo, second = todo[turn], second[turn]
        group = rank[todo]
        first = np.append(True, group[1:] != group[:-1])
        part = first | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(todo))
        rank = rank.copy()
        rank[todo] = group + place[part][np.cumsum(part) - 1] - place[first][np.cumsum(first) - 1]
        levels.append(rank)
        step *= 2
        todo = todo[np.repeat(np.diff(np.append(place[part], len(todo))), np.diff(np.append(place[part], len(todo)))) > 1]
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    pair = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    left, right = suffixes[pair], suffixes[pair + 1]
    common = np.zeros(len(pair), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < end[left]) & (b < end[right])
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common[same] += 1 << level
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a span [i, i + length[i]) of at least ``least``."""
    n = len(length)
    reach = np.maximum.accumulate(np.where(length >= least, np.arange(n) + length, 0)) if n else length
    return reach > np.arange(n)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(piece: packed.Piece, found: packed.Words) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line."""
    rows = len(piece.bounds) - 1
    cut = np.flatnonzero(piece.data == 10)
    start = np.union1d(piece.bounds[:-1], cut + 1)
    row = np.searchsorted(piece.bounds, start, side="right") - 1
    inside = row < rows
    start, row = start[inside], row[inside]
    place = np.searchsorted(cut, start)
    end = np.minimum(np.append(cut, len(piece.data))[place], piece.bounds[row + 1])
    worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    hashes = packed.span_hashes(packed.prefix_sums(piece.data), start, end)
    order = np.lexsort((hashes, row))
    same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return np.bincount(row[order][1:][same], minlength=rows)


def _judge(batches):
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for batch in batches:
        counts = {name: np.zeros(batch.num_rows, dtype=np.int64) for name in COUNTS}
        for piece in packed.pieces(batch):
            found = packed.words(piece)
            rows = slice(piece.first, piece.last)
            points = np.append(0, np.cumsum((piece.data & 0xC0) != 0x80))
            chars = points[found.end] - points[found.start]
            prefix = longest_prefixes(found.hashes, found.bounds)
            counts["n_words"][rows] = np.diff(found.bounds)
            counts["word_chars"][rows] = _sums(chars, found.bounds)
            counts["n_symbols"][rows] = _sums(symbol[piece.data], piece.bounds)
            counts["n_dup_lines"][rows] = _dup_lines(piece, found)
            counts["n_repeat_words"][rows] = _sums(covered(prefix, WINDOW), found.bounds)
            counts["covered_chars"][rows] = _sums(chars * covered(prefix, LEAST), found.bounds)
            some = np.flatnonzero(np.diff(found.bounds))
            if len(some):
                longest = np.maximum.reduceat(prefix, found.bounds[some])
                counts["longest_repeat"][rows][some] = np.where(longest >= LEAST, longest, 0)
        failed = (counts["n_words"] < FEWEST_WORDS) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        kept = ~failed & (counts["covered_chars"] <= COVERED * counts["word_chars"]) & (counts["longest_repeat"] <= LONGEST)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[name]) for name in COUNTS), pa.array(failed), pa.array(kept)],
            names=["doc_id", *COUNTS, "base_failed", "kept"],
        )


def judged(docs: DataFrame) -> DataFrame:
    """Per row: the base counts, covered_chars, longest_repeat (0 below LEAST words), base_failed and kept."""
    return jobs.with_columns(docs, doc_id="long", text="string").mapInArrow(_judge, SCHEMA)
