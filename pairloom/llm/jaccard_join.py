"""Exact Jaccard join of word n-gram sets by T-occurrence search, and the components of its links.

A document's set holds its distinct ``width``-word shingles (A-Z lower-cased; fewer words make one shingle of all of them).
Two documents link when 100 * |intersection| >= percent * |union|. The steps, none of which loses a link:

1. *Equal sets* are found by their size and a 128-bit fingerprint; only the smallest doc_id of each goes on.
2. *Shared shingles.* Linked sets share at least percent % of each one's shingles, so a document goes on only if at
   least that many of its shingles occur in another document. This is counted with 32-bit remainders within buckets of
   the hash range; a chance agreement only lets a document go on.
3. *Rarest first.* Among what is left, shingles are ordered by the number of documents that hold them. Linked sets share
   one of their first |set| - ceil(percent % of |set|) + 1 shingles, so each such shingle joins its documents to a family.
4. *T-occurrence search* within a family: for every document the inverted lists of its shingles are parted into the L
   longest and the rest (DivideSkip). The short lists are merged, candidates that occur at least T - L times there are
   probed for in the long lists by binary search, and those that reach the overlap for their sizes are links. Documents
   already connected need no second link. Families over ``BLOCK`` documents are dealt to tasks by pairs of blocks.
5. Components of the links (``jobs.components``).

Defined cases: null and empty texts and texts without words have no shingles and link with nothing. Rows without a doc_id
are returned with a null component_id and take no part. Repeated rows have equal sets. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

BLOCK = 1000
#: Text bytes whose shingles are packed together; shingles per bucket task, and shingles per search task.
GROUP_BYTES = 6 << 20
BUCKET_ROWS = 3_000_000
#: Buckets are 2 ** LEAST_BITS at least, so that small inputs are spread as well.
LEAST_BITS = 6
TASK_ROWS = 1_000_000
#: Weight of a probe in DivideSkip's choice of the number of long lists, L = T / (WEIGHT * log2(longest) + 1).
WEIGHT = 0.0085

PROFILE = "doc_id long, n_shingles long, mark_1 long, mark_2 long"
SHARES = "bucket int, docs array<long>, hashes binary, owners binary"


def shingle_sets(piece: packed.Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ordered by row and hash."""
    found = packed.words(piece, lower=True)
    count = np.diff(found.bounds)
    hashes, whole = packed.windows(found, width)
    row = np.repeat(np.arange(len(count)), count)
    short = np.flatnonzero((count > 0) & (count < width))
    rows, values = [row[whole]], [hashes[whole]]
    for size in range(1, width):
        some = short[count[short] == size]
        part, _ = packed.windows(found, size)
        rows.append(some)
        values.append(packed.mix(part[found.bounds[some]] ^ np.uint64(size)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _profiles(batches, width: int):
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        marks = np.zeros((2, batch.num_rows), dtype=np.uint64)
        for piece in packed.pieces(batch):
            row, value = shingle_sets(piece, width)
            rows = piece.last - piece.first
            size[piece.first : piece.last] = np.bincount(row, minlength=rows)
            first = np.searchsorted(row, np.arange(rows))
            some = first < np.append(first[1:], len(row))
            for k, salt in enumerate((packed.MIX_1, packed.MIX_2)):
                if some.any():
                    marks[k, piece.first : piece.last][some] = np.add.reduceat(packed.mix(value ^ salt), first[some])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), *(pa.array(m.view(np.int64)) for m in marks)],
            names=["doc_id", "n_shingles", "mark_1", "mark_2"],
        )


def _shares(batches, width: int, bits: int):
    """The shingles of some documents by bucket: sorted 32-bit remainders of their hashes, and whose they are."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        first, size, rows, values = 0, 0, [], []
        for piece in packed.pieces(batch):
            row, value = shingle_sets(piece, width)
            rows.append(row + (piece.first - first))
            values.append(value)
            size += len(piece.data)
            if size < GROUP_BYTES and piece.last < batch.num_rows and piece.last - first < 1 << 15:
                continue
            row, value = np.concatenate(rows), np.concatenate(values)
            mine = ids[first : piece.last]
            first, size, rows, values = piece.last, 0, [], []
            order = np.argsort(value, kind="stable")
            row, value = row[order], value[order]
            bounds = np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rest = ((value >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            used = np.flatnonzero(np.diff(bounds))
            if not len(used):
                continue
            docs, owners = [], []
            for k in used:
                holds = np.zeros(len(mine), dtype=bool)
                holds[row[bounds[k] : bounds[k + 1]]] = True
                docs.append(mine[holds])
                owners.append((np.cumsum(holds) - 1)[row[bounds[k] : bounds[k + 1]]].astype(np.uint32))
            size_of = np.diff(bounds)[used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    packed.list_array(np.concatenate(docs), np.array([len(d) for d in docs])),
                    packed.binary_array(rest.view(np.uint8), size_of * 4),
                    packed.binary_array(np.concatenate(owners).astype(np.uint16).view(np.uint8), size_of * 2),
                ],
                names=["bucket", "docs", "hashes", "owners"],
            )


def _shared(table: pa.Table) -> pa.Table:
    """How many shingles of each document, in one bucket, another document holds as well."""
    docs, doc_bounds = packed.list_bounds(table.column("docs"))
    hashes, bounds = packed.binary_bounds(table.column("hashes"))
    owners, _ = packed.binary_bounds(table.column("owners"))
    value = np.frombuffer(hashes.tobytes(), dtype=np.uint32)
    owner = np.frombuffer(owners.tobytes(), dtype=np.uint16).astype(np.int64) + np.repeat(doc_bounds[:-1], np.diff(bounds) // 4)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.append(True, value[1:] != value[:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1
    count = np.bincount(owner[often], minlength=len(docs))
    some = np.flatnonzero(count)
    return pa.table({"doc_id": pa.array(docs[some].astype(np.int64)), "shared": pa.array(count[some].astype(np.int64))})


def _as_lists(batches, width: int):
    for batch in batches:
        rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for piece in packed.pieces(batch):
            row, value = shingle_sets(piece, width)
            rows.append(row + piece.first)
            values.append(value)
        size = np.bincount(np.concatenate(rows), minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), packed.list_array(np.concatenate(values).view(np.int64), size)], names=["doc_id", "shingles"]
        )


class Index:
    """Inverted lists of some sets: for every shingle the numbers of the sets that hold it, in order."""

    def __init__(self, values: np.ndarray, owners: np.ndarray, sets: int):
        order = np.lexsort((owners, values))
        self.sets, self.owners = sets, owners[order]
        self.shingles, rank, count = np.unique(values[order], return_inverse=True, return_counts=True)
        self.bounds = np.append(0, np.cumsum(count))
        self.keys = rank * sets + self.owners  # (shingle, set) as one sorted number, for binary search

    def occurring(self, query: np.ndarray, least: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets among ``wanted`` that share at least ``least`` shingles with the query, and how many they share."""
        place = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        place = place[self.shingles[place] == query]
        none = np.zeros(0, np.int64)
        if len(place) < least:
            return none, none
        size = self.bounds[place + 1] - self.bounds[place]
        place = place[np.argsort(size, kind="stable")]
        longs = min(least - 1, int(least / (WEIGHT * math.log2(max(2, int(size.max()))) + 1)))
        short, long = place[: len(place) - longs], place[len(place) - longs :]
        merged = self.owners[packed.ranges(self.bounds[short], self.bounds[short + 1] - self.bounds[short])]
        count = np.bincount(merged, minlength=self.sets)
        found = np.flatnonzero((count >= max(1, least - longs)) & wanted)
        count = count[found]
        if len(found) and longs:
            probe = long[:, None] * self.sets + found[None, :]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            count = count + (self.keys[at] == probe).sum(axis=0)
        enough = count >= least
        return found[enough], count[enough]


def links(values: np.ndarray, bounds: np.ndarray, queries: np.ndarray, indexed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between query sets and indexed sets that connect what is not yet connected. Sets are given by number."""
    size = np.diff(bounds)
    take = packed.ranges(bounds[indexed], size[indexed])
    if not len(take):
        return []
    index = Index(values[take], np.repeat(np.arange(len(indexed)), size[indexed]), len(indexed))
    label = np.arange(len(size))
    found = []
    for q in queries.tolist():
        n = size[q]
        least = -(-percent * n // 100)  # the overlap that any partner needs at least
        other = size[indexed]
        wanted = (label[indexed] != label[q]) & (other * 100 >= percent * n) & (n * 100 >= percent * other)
        if not n or not wanted.any():
            continue
        near, overlap = index.occurring(values[bounds[q] : bounds[q + 1]], int(least), wanted)
        good = near[100 * overlap >= percent * (n + other[near] - overlap)]
        for k in indexed[good].tolist():
            if label[k] != label[q]:
                found.append((q, k))
                label[label == label[k]] = label[q]
    return found


def _search(table: pa.Table, percent: int) -> pa.Table:
    """Links within the families, or pairs of blocks of one family, that one task holds."""
    names = ("family", "one", "two", "block", "doc_id")
    family, one, two, block, doc = (table.column(c).to_numpy() for c in names)
    values, bounds = packed.list_bounds(table.column("shingles"))
    order = np.lexsort((doc, two, one, family))
    new = np.append(True, (np.diff(family[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
    first = np.flatnonzero(new)
    left, right = [], []
    for lo, hi in zip(first, np.append(first[1:], len(order))):
        mine = order[lo:hi]
        size = (bounds[mine + 1] - bounds[mine]).astype(np.int64)
        own = values[packed.ranges(bounds[mine], size)]
        own_bounds = np.append(0, np.cumsum(size))
        every = np.arange(len(mine))
        a, b = every[block[mine] == one[mine[0]]], every[block[mine] == two[mine[0]]]
        for q, k in links(own, own_bounds, a, b, percent):
            left.append(doc[mine[q]])
            right.append(doc[mine[k]])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, mark_1, mark_2) of every row: its set's size and fingerprint."""
    texts = jobs.with_columns(docs, doc_id="long", text="string")
    return texts.mapInArrow(lambda batches: _profiles(batches, width), PROFILE)


def linked(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links lead to (itself included)."""
    texts = jobs.with_columns(docs, doc_id="long", text="string")
    every = jobs.staged(profiles(docs, width), "jaccard-profiles")
    some = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "mark_1", "mark_2"]
    first = some.groupBy(*same).agg(F.min("doc_id").alias("first"))
    total = some.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]

    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, total / BUCKET_ROWS))))
    known = texts.where("doc_id IS NOT NULL")
    shares = known.mapInArrow(lambda batches: _shares(batches, width, bits), SHARES)
    shared = shares.groupBy("bucket").applyInArrow(_shared, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    going = first.join(shared, F.col("first") == F.col("doc_id")).where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("doc_id")
    going = jobs.staged(going, "jaccard-going")
    sets = known.join(going, "doc_id", "left_semi").mapInArrow(lambda batches: _as_lists(batches, width), "doc_id long, shingles array<long>")
    sets = jobs.staged(sets, "jaccard-sets")

    owned = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    held = owned.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rarest = owned.join(held, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("known"))
    size = F.size("shingles")
    prefix = size - F.ceil(size * percent / 100) + 1
    keys = sets.join(rarest, "doc_id").withColumn("left", (prefix - (size - F.size("known"))).cast("int")).where("left > 0")
    keys = jobs.staged(keys.select("doc_id", F.explode(F.slice("known", 1, F.col("left"))).alias("key")).select("doc_id", "key.shingle"), "jaccard-keys")
    hubs = keys.groupBy("shingle").agg(F.min("doc_id").alias("hub"))
    families = jobs.components(keys.join(hubs, "shingle").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), "jaccard-families")
    families = families.select(F.col("node").alias("doc_id"), F.col("root").alias("family"))

    number = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = families.join(number, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    member = member.select("doc_id", "family", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    work = member.join(sets, "doc_id")
    tasks = max(16, int(work.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]) // TASK_ROWS)
    work = work.withColumn("task", F.pmod(F.xxhash64("family", "one", "two"), F.lit(tasks)))
    found = work.groupBy("task").applyInArrow(lambda table: _search(table, percent), "a long, b long")
    root = jobs.components(found, "jaccard-links")

    label = first.join(root, F.col("first") == F.col("node"), "left").select(*same, F.coalesce("root", "first").alias("root"))
    out = every.join(label, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
