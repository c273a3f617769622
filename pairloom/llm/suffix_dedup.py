"""Exact substring deduplication by suffix sorting in blocks, ties resolved by the ranks of a difference cover.

A byte is removed when a string of ``LENGTH`` bytes covers it that also starts earlier: in a smaller doc_id, or earlier in
the same document. Strings are judged on the input texts; matches never cross documents.

1. *Blocks.* Every string of ``LENGTH`` bytes belongs to one suffix bucket: the one named by the smallest hash among the
   ``SEED``-byte strings in it. Equal strings have the same name, so buckets are sorted independently. Consecutive starts
   with one name form a run, and its bytes travel once. The buckets are dealt to ``BLOCKS`` blocks; each block scans the
   texts again and shuffles its own buckets only, which bounds the disk space, as in blockwise suffix sorting.
2. *Sorting a bucket.* Starts are sorted by their first 32 bytes. Ties are resolved by ranks of the suffixes at the
   positions of a difference cover modulo 31: any two starts have a distance below 31 at which both stand on the cover,
   so one comparison of two ranks decides. Cover ranks come from 32 bytes and two doublings, so memory holds eight-byte
   words and ranks of a single bucket, never the long prefixes themselves.
3. *Removal.* Neighbours in suffix order with a common prefix of ``LENGTH`` bytes form groups. All but the earliest member
   are removed. Per document the removed strings are united.

Hot texts: equal runs are combined within GROUP_BYTES of text before the shuffle, where all but the earliest are settled.
Defined cases: null and empty texts and texts under ``LENGTH`` bytes lose nothing; the digest is then that of the whole
text (null: of no bytes). Rows with the same doc_id are taken as one document's versions and are each returned; among them
only the text decides, so copies under one doc_id do not remove each other. Rows without a doc_id are returned whole and not
compared. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

LENGTH = 100
SEED = 32
BLOCKS = 3
#: Text bytes per bucket task and block; a bucket task holds some 3.3 times as many bytes of runs.
BUCKET_BYTES = 6 << 20
#: Text bytes within which equal runs are combined before the shuffle.
GROUP_BYTES = 8 << 20
#: A perfect difference set: every residue modulo 31 is the difference of two members.
CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)

RUNS = "bucket int, seed long, doc_id long, start long, lead int, runs int, bytes binary"
SPANS = "doc_id long, start long, end long"


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """Which residues are on the cover, and the distance at which two residues both reach it."""
    on = np.zeros(CYCLE, dtype=bool)
    on[list(COVER)] = True
    reach = np.full((CYCLE, CYCLE), -1, dtype=np.int64)
    for step in range(CYCLE):
        both = np.outer(on[(np.arange(CYCLE) + step) % CYCLE], on[(np.arange(CYCLE) + step) % CYCLE])
        reach[(reach < 0) & both] = step
    assert (reach >= 0).all()
    return on, reach


ON_COVER, REACH = _cover_tables()


def _parts(batch: pa.RecordBatch):
    """Pieces of a batch in which no text is longer than a piece: long ones come in parts that overlap by LENGTH - 1."""
    for piece in packed.pieces(batch):
        if piece.last - piece.first > 1 or len(piece.data) <= 2 * packed.PIECE:
            yield piece.first, piece.data, piece.bounds, 0
        else:
            for start in range(0, len(piece.data) - LENGTH + 1, packed.PIECE):
                part = piece.data[start : start + packed.PIECE + LENGTH - 1]
                yield piece.first, part, np.array([0, len(part)]), start


def runs_of(data: np.ndarray, bounds: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, seed position and seed hash of every run of starts with the same seed."""
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    if len(data) < LENGTH:
        return empty
    at = np.arange(len(data) - SEED + 1)
    _, down = packed.powers(len(sums))
    with np.errstate(over="ignore"):
        seeds = packed.mix((sums[SEED:] - sums[:-SEED]) * down[: len(at)])
    bits = np.uint64(20)
    least = (seeds >> bits << bits) | at.astype(np.uint64)
    width = LENGTH - SEED + 1
    done = 1
    while done < width:  # least over 1, 2, 4, ... seeds, then over exactly LENGTH - SEED + 1
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    seed_at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.zeros(len(seed_at) + 1, dtype=bool)  # no string across documents
    begins, ends = bounds[:-1], bounds[1:] - LENGTH + 1
    new = np.ones(len(seed_at) + 1, dtype=bool)
    new[1:-1] = seed_at[1:] != seed_at[:-1]
    for begin, end in zip(begins[begins < ends].tolist(), ends[begins < ends].tolist()):
        starts[begin:end] = True
        new[begin] = new[end] = True
    first = np.flatnonzero(new)
    size = np.diff(first)
    first = first[:-1]
    kept = starts[first]
    first, size = first[kept], size[kept]
    return np.searchsorted(bounds, first, side="right") - 1, first, size, seed_at[first], seeds[seed_at[first]]


def _scan(batches, block: int, blocks: int, buckets: int):
    """Runs of the block's buckets; runs that repeat within a group are settled here and travel as removed spans."""
    schema = pa.schema([("bucket", pa.int32()), ("seed", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("runs", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for group in _groups(_parts(batch)):
            found = [_found(ids, block, blocks, *part) for part in group]
            doc, start, size, lead, seed, whole, text = (np.concatenate(x) for x in zip(*found))
            if not len(doc):
                continue
            order = np.lexsort((start, doc, whole))
            doc_, start_, whole_ = doc[order], start[order], whole[order]
            first = np.flatnonzero(np.append(True, whole_[1:] != whole_[:-1]))
            first = np.repeat(first, np.diff(np.append(first, len(order))))
            settled = np.zeros(len(order), dtype=bool)
            settled[order] = (doc_ != doc_[first]) | (start_ != start_[first])
            spans = packed.united(doc[settled], start[settled], start[settled] + size[settled] + LENGTH - 1)
            if settled.any():
                text = text[np.repeat(~settled, size + LENGTH - 1)]
                doc, start, size, lead, seed = (x[~settled] for x in (doc, start, size, lead, seed))
            bucket = (seed // np.uint64(blocks) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(seed.view(np.int64)), pa.array(doc), pa.array(start), pa.array(lead.astype(np.int32)), pa.array(size.astype(np.int32)), packed.binary_array(text, size + LENGTH - 1)],
                schema=schema,
            )
            if len(spans[0]):
                n = len(spans[0])
                none = pa.nulls(n, pa.int32())
                where = pa.array((packed.mix(spans[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [where, pa.nulls(n, pa.int64()), pa.array(spans[0]), pa.array(spans[1]), none, pa.array((spans[2] - spans[1]).astype(np.int32)), pa.nulls(n, pa.binary())],
                    schema=schema,
                )


def _groups(parts):
    """Parts in groups of about GROUP_BYTES, the unit in which runs are combined."""
    group, size = [], 0
    for part in parts:
        group.append(part)
        size += len(part[1])
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _found(ids, block, blocks, first, data, bounds, shift):
    """The block's runs in one part: document, start, number of starts, offset of the seed, seed, hash and bytes."""
    sums = packed.prefix_sums(data)
    row, start, size, seed_at, seed = runs_of(data, bounds, sums)
    mine = np.flatnonzero(seed % np.uint64(blocks) == np.uint64(block))
    row, start, size, seed_at, seed = (x[mine] for x in (row, start, size, seed_at, seed))
    whole = packed.span_hashes(sums, start, start + size + LENGTH - 1)
    with np.errstate(over="ignore"):
        whole = packed.mix(whole + (seed_at - start).astype(np.uint64) * packed.BASE)
    text = data[packed.ranges(start, size + LENGTH - 1)]
    return ids[first + row], start - bounds[row] + shift, size, seed_at - start, seed, whole, text


def _dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, most significant first, and the dense rank of every element in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def suffix_order(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes there, each up to the end of its string; ``bounds`` part the strings.

    Suffixes that agree in the first LENGTH bytes are neighbours. Every start has LENGTH bytes in its string.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(40, dtype=np.uint8)])
    word = np.zeros(n + 32, dtype=np.uint64)
    for k in range(8):
        word |= padded[k : k + n + 32].astype(np.uint64) << np.uint64(56 - 8 * k)
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    residue = (np.arange(n) - bounds[string]) % CYCLE
    end = bounds[string + 1]

    cover = np.flatnonzero(ON_COVER[residue])
    _, rank = _dense(*(np.where(cover + k < end[cover], word[cover + k], 0) for k in (0, 8, 16, 23)))
    place = np.full(n + 1, -1, dtype=np.int64)
    place[cover] = np.arange(len(cover))
    for step in (CYCLE, 2 * CYCLE):  # ranks by 31 bytes, then 62, then 124
        later = np.where(cover + step < end[cover], place[np.minimum(cover + step, n)], -1)
        _, rank = _dense(rank, np.where(later < 0, -1, rank[later]))
    ranks = np.full(n + CYCLE, -1, dtype=np.int64)
    ranks[cover] = rank

    order, group = _dense(*(word[starts + k] for k in (0, 8, 16, 24)))
    new = np.append(True, np.diff(group[order]) != 0)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group is named by its first place, as its parts will be
    at = starts[order]
    open_ = np.ones(len(at), dtype=bool)
    while True:  # three-way partition of all tied groups at once, around one pivot each, by one rank per element
        tied = np.zeros(len(at), dtype=bool)
        tied[1:] = (group[1:] == group[:-1]) & open_[1:] & open_[:-1]
        tied[:-1] |= tied[1:]
        todo = np.flatnonzero(tied)
        if not len(todo):
            return at
        mine, here = group[todo], at[todo]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        size = np.diff(np.append(first, len(mine)))
        pivot = np.repeat(here[first + size // 2], size)
        step = REACH[residue[here], residue[pivot]]
        left = np.where(here + step < end[here], ranks[here + step], -1)
        right = np.where(pivot + step < end[pivot], ranks[pivot + step], -1)
        side = np.sign(left - right)
        turn = np.lexsort((side, mine))
        at[todo] = here[turn]
        side = side[turn]
        open_[todo] = side != 0
        new = np.append(True, (mine[1:] != mine[:-1]) | (side[1:] != side[:-1]))
        group[todo] = todo[np.flatnonzero(new)][np.cumsum(new) - 1]


def repeated_spans(seed: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, lead: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple:
    """Spans removed in one bucket: of every group of equal strings, all but the one that starts first."""
    settled = (np.zeros(0, np.int64),) * 3
    kept = _repeated(seed)
    if not len(kept):
        return settled
    kept = kept[np.lexsort((start[kept], doc[kept]))]  # places then follow the order of the corpus
    length = np.diff(bounds)[kept]
    data = data[packed.ranges(bounds[:-1][kept], length)]
    doc, start, size, lead, seed = (x[kept] for x in (doc, start, size, lead, seed))
    bounds = np.append(0, np.cumsum(length))

    whole = packed.span_hashes(packed.prefix_sums(data), bounds[:-1], bounds[1:])  # equal runs count once in the sort
    with np.errstate(over="ignore"):
        whole = packed.mix(whole + lead.astype(np.uint64) * packed.BASE)
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    first = first[number]
    gone = (doc != doc[first]) | (start != start[first])
    settled = (doc[gone], start[gone], start[gone] + length[gone])
    alone = np.flatnonzero(first == np.arange(len(first)))
    kept = alone[_repeated(seed[alone])]
    if not len(kept):
        return settled
    data = data[packed.ranges(bounds[:-1][kept], length[kept])]
    doc, start, size, length = doc[kept], start[kept], size[kept], length[kept]
    bounds = np.append(0, np.cumsum(length))
    places = packed.ranges(bounds[:-1], size)
    at = suffix_order(data, bounds, places)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        word |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    same = np.zeros(len(at), dtype=bool)
    same[1:] = True
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same[1:] &= word[at[1:] + k] == word[at[:-1] + k]
    first = np.flatnonzero(~same)
    earliest = np.repeat(np.minimum.reduceat(at, first), np.diff(np.append(first, len(at))))
    run_of = np.repeat(np.arange(len(bounds) - 1), length)
    gone = at[(at != earliest) & ~_same_document(doc, run_of, at, earliest, start, bounds)]
    gone.sort()
    run = run_of[gone]
    begin = start[run] + gone - bounds[run]
    return tuple(np.concatenate(x) for x in zip(settled, (doc[run], begin, begin + LENGTH)))


def _repeated(seed: np.ndarray) -> np.ndarray:
    """Places of the seeds that occur more than once."""
    _, number, count = np.unique(seed, return_inverse=True, return_counts=True)
    return np.flatnonzero(count[number] > 1)


def _same_document(doc, run_of, at, earliest, start, bounds) -> np.ndarray:
    """The very same start of a document that comes in twice is no repetition."""
    a, b = run_of[at], run_of[earliest]
    return (at != earliest) & (doc[a] == doc[b]) & (start[a] + at - bounds[a] == start[b] + earliest - bounds[b])


def _sort_bucket(table: pa.Table) -> pa.Table:
    """One bucket: settled spans pass, runs are sorted and compared."""
    table = table.combine_chunks()
    passing = table.filter(pa.compute.is_null(table.column("bytes")))
    runs = table.filter(pa.compute.is_valid(table.column("bytes")))
    column = lambda t, name: t.column(name).to_numpy()
    spans = [(column(passing, "doc_id"), column(passing, "start"), column(passing, "start") + column(passing, "runs"))]
    if runs.num_rows:
        data, bounds = packed.binary_bounds(runs.column("bytes"))
        spans.append(repeated_spans(column(runs, "seed"), column(runs, "doc_id"), column(runs, "start"), column(runs, "runs").astype(np.int64), column(runs, "lead").astype(np.int64), data, bounds))
    doc, start, end = packed.united(*(np.concatenate(x).astype(np.int64) for x in zip(*spans)))
    return pa.table({"doc_id": pa.array(doc), "start": pa.array(start), "end": pa.array(end)})


def removed_spans(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, start, end) byte spans to remove; those of one document may overlap. One staged table per block."""
    docs = jobs.with_columns(docs, doc_id="long", text="string").where(F.octet_length("text") >= LENGTH).where("doc_id IS NOT NULL")
    buckets = max(16, jobs.text_bytes(docs) // BUCKET_BYTES)
    found = None
    for block in range(blocks):
        runs = docs.mapInArrow(lambda batches, block=block: _scan(batches, block, blocks, buckets), RUNS)
        spans = jobs.staged(runs.groupBy("bucket").applyInArrow(_sort_bucket, SPANS), "suffix-spans")
        found = spans if found is None else found.union(spans)
    return found


def _cut(batches):
    for batch in batches:
        ids, spans = batch.column("doc_id"), batch.column("spans")
        flat = pa.compute.list_flatten(spans)
        size = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
        start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        row, start, end = packed.united(np.repeat(np.arange(len(size)), size), start, end)
        at = np.searchsorted(row, np.arange(len(size) + 1))
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for piece in packed.pieces(batch):
            view = memoryview(np.ascontiguousarray(piece.data))
            for k in range(piece.first, piece.last):
                text = view[piece.bounds[k - piece.first] : piece.bounds[k - piece.first + 1]]
                lo, hi = at[k], at[k + 1]
                ends = [0, *end[lo:hi].tolist()]
                kept = b"".join(text[a:b] for a, b in zip(ends, [*start[lo:hi].tolist(), len(text)]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(int(hi - lo))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
        names = [n for n in out]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(out[n], type=k) for n, k in zip(names, kinds))], names=["doc_id", *names])


def deduplicated(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the remaining bytes."""
    spans = removed_spans(docs, blocks).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = jobs.with_columns(docs, doc_id="long", text="string")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.join(spans, "doc_id", "left").mapInArrow(_cut, schema)
