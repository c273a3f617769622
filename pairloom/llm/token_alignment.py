"""Alignment of two tokenizers over a corpus, with the document counts of the linked id pairs.

A is a byte-level BPE vocabulary (`bpe_codec`), B a sentencepiece model that puts a blank before the text. Byte offsets where
tokens of both end cut a text's tokens into groups, and all A-B pairs of a group are linked.

1. *Segments.* Neither vocabulary joins a character that is no white space with a blank behind it, so a text is cut there, each
   different segment is tokenized and aligned once per task (at most ``SEGMENTS``, then it starts anew), and all values of
   a document are sums over its segments.
2. *One pass over the texts.* Every task writes per document its numbers, its digest and its distinct linked pairs with how often
   each occurs, and counts in how many of its documents each id pair is linked.
3. *Counts.* `pair_counts` builds a minimal perfect hash function of the distinct pairs and sums the partial counts as dense
   vectors up a tree; the keys are kept beside the counts, so every lookup is verified.
4. *Lookups.* The written pairs are looked up; no text is tokenized again. Function, keys and counts go to the tasks while they
   take at most ``TABLE_BYTES``; beyond that the pairs of each document are joined with the counts by shuffle, with the same
   result (a hot pair is on one side only, where Spark splits skewed partitions).

The largest counts by A id are a table as large as A's vocabulary. A group's pairs are made in slices of ``PAIRS`` and combined,
so a text on which the tokenizers never agree needs no more memory than its distinct pairs.

Defined cases: a text that is null, empty, or whose joined tokens of A or B are not its bytes behind a blank (as for U+2581)
has no tokens: all numbers are 0 and groups_sha256 is ''. Every row is a document, repeated ones too; a null doc_id is kept;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.llm.bpe_codec import Encoder, Vocabulary, chunks, default_path, vocabulary
from pairloom.llm.pair_counts import Function, counted
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

SEGMENTS = 1 << 19
PAIRS = 1 << 21
TABLE_BYTES = 96 << 20
HELD = 1 << 20  # pairs that a task keeps before it sums them up
SHIFT = 16  # bits for an id of B in a key

SEGMENT = re.compile(r" \s*(?:\S+(?:[^\S ]\s*)?)*+")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ROWS = 1000  # documents whose pairs are looked up at a time
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, keys array<long>, times array<long>"
PARTS = "part int, key long, n long"


class Pieces:
    """A sentencepiece model: ids of segments, and the bytes of each id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names) or len(names) > 1 << SHIFT:
            raise ValueError("pieces must not go on behind the end of a word, and there may be at most 65,536")
        raw = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.bounds = np.append(0, np.cumsum([len(r) for r in raw]))
        self.blank = self.model.piece_to_id("▁")

    def ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of segments, each of which begins with the blank that the model would put before it."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        if " " in segments:
            found[segments.index(" ")] = [self.blank]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.array(list(chain.from_iterable(found)), dtype=np.int64), size


def _digits(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. limit - 1, each with room for a separator behind it."""
    text = [f"{i},".encode() for i in range(limit)]
    return np.frombuffer(b"".join(text), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in text]))


class Aligner:
    """Segments met by a task, with everything that is known of each."""

    def __init__(self, v: Vocabulary, model: bytes):
        self.v, self.pieces = v, Pieces(model)
        self.encoder = Encoder(v, specials=False)
        self.digits, self.digit_bounds = _digits(max(v.size, len(self.pieces.bounds)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.valid = np.zeros(0, dtype=bool)
        self.numbers = np.zeros((0, len(NUMBERS)), dtype=np.int64)
        self.keys, self.times, self.pair_bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text, self.text_bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def learn(self, segments: list[str]) -> None:
        numbers, valid, keys, times, pairs, text, sizes = self._aligned(segments)
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))
        self.valid, self.numbers = np.concatenate([self.valid, valid]), np.concatenate([self.numbers, numbers])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        self.pair_bounds = np.concatenate([self.pair_bounds, self.pair_bounds[-1] + np.cumsum(pairs)])
        self.text = np.concatenate([self.text, text])
        self.text_bounds = np.concatenate([self.text_bounds, self.text_bounds[-1] + np.cumsum(sizes)])

    def _aligned(self, segments: list[str]):
        n, p, v = len(segments), self.pieces, self.v
        coded = list(map(str.encode, segments))
        length = np.fromiter(map(len, coded), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        (a, size_a), (b, size_b) = self._words(segments), p.ids(segments)
        a, seg_a, seg_b = a.astype(np.int64), np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)
        valid = np.ones(n, dtype=bool)
        for ids, seg, bounds, source in ((a, seg_a, v.bounds, v.data), (b, seg_b, p.bounds, p.data)):
            width = bounds[ids + 1] - bounds[ids]
            valid &= np.bincount(seg, width, minlength=n).astype(np.int64) == length
            kept = valid[seg]
            joined = source[packed.ranges(bounds[ids[kept]], width[kept])]
            same = joined == data[np.repeat(valid, length)]
            owner = np.repeat(np.flatnonzero(valid), length[valid])
            valid[owner[~same]] = False
        a, seg_a, b, seg_b = a[valid[seg_a]], seg_a[valid[seg_a]], b[valid[seg_b]], seg_b[valid[seg_b]]
        end_a, end_b = np.cumsum(v.bounds[a + 1] - v.bounds[a]), np.cumsum(p.bounds[b + 1] - p.bounds[b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        group_seg = seg_a[np.cumsum(n_a) - 1] if len(cut) else np.zeros(0, np.int64)
        numbers = np.zeros((n, len(NUMBERS)), dtype=np.int64)
        for column, (where, weight) in enumerate(((seg_a, None), (seg_b, None), (group_seg, None), (group_seg, n_a * n_b))):
            numbers[:, column] = np.bincount(where, weight, minlength=n)
        keys, times, pairs = self._pairs(n, a, b, seg_a, group_a, n_b)
        text, sizes = self._groups(n, a, b, group_a, group_b, n_a, n_b, group_seg)
        return numbers, valid, keys, times, pairs, text, sizes

    def _words(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of segments. Plain ones are cut into words as one text: no word goes on from one into the next."""
        plain = np.array([not s[-1].isspace() for s in segments], dtype=bool)
        if not self.encoder.uncommon.isdisjoint("".join(segments)):
            plain &= np.array([self.encoder.uncommon.isdisjoint(s) for s in segments], dtype=bool)
        some = segments if plain.all() else [s for s, told in zip(segments, plain.tolist()) if told]
        words = self.encoder.plain.findall("".join(some))
        flat, size = self.encoder.ids(words)
        ends = np.searchsorted(np.cumsum(list(map(len, words))), np.cumsum(list(map(len, some))), side="right")
        counts = np.diff(np.append(0, np.append(0, np.cumsum(size))[ends])) if some else np.zeros(0, np.int64)
        if plain.all():
            return flat, counts
        others, other_counts = self.encoder.encode([s for s, told in zip(segments, plain.tolist()) if not told])
        total = np.zeros(len(segments), dtype=np.int64)
        total[plain], total[~plain] = counts, other_counts
        out = np.empty(int(total.sum()), dtype=np.int64)
        owner = np.repeat(plain, total)
        out[owner], out[~owner] = flat, others
        return out, total

    def _pairs(self, n, a, b, seg_a, group_a, n_b):
        """Distinct linked pairs of every segment, with how often each occurs."""
        first = np.cumsum(n_b) - n_b
        width = n_b[group_a]
        ends = np.cumsum(width)
        found, start = [], 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - width[start] + PAIRS, side="right")))
            at = slice(start, stop)
            key = np.repeat(seg_a[at] << 33 | a[at] << SHIFT, width[at]) | b[packed.ranges(first[group_a[at]], width[at])]
            found.append(np.unique(key, return_counts=True))
            start = stop
        key, times = _summed(found)
        return key & ((1 << 33) - 1), times, np.bincount(key >> 33, minlength=n)

    def _groups(self, n, a, b, group_a, group_b, n_a, n_b, group_seg):
        """The groups of every segment as text, each with a semicolon behind it."""
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at_a = np.arange(len(a)) + before_b[group_a]
        at_b = np.arange(len(b)) + (before_a + n_a)[group_b]
        token = np.empty(len(a) + len(b), dtype=np.int64)
        token[at_a], token[at_b] = a, b
        width = self.digit_bounds[token + 1] - self.digit_bounds[token]
        text = self.digits[packed.ranges(self.digit_bounds[token], width)]
        ends = np.cumsum(width) - 1
        last = before_a + n_a + before_b + n_b - 1
        if len(token):
            text[ends[last - n_b]] = ord("|")
            text[ends[last]] = ord(";")
        sizes = np.zeros(n, dtype=np.int64)
        if len(last):
            np.add.at(sizes, group_seg, np.diff(np.append(-1, ends[last])))
        return text, sizes

    def rows(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Segments of the texts: numbers of known segments, and the bounds of each text."""
        found = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        bounds = np.append(0, np.cumsum([len(f) for f in found]))
        distinct = set().union(*found)
        missing = list(distinct.difference(self.known))
        if missing and len(self.known) + len(missing) > SEGMENTS:
            self._forget()
            missing = list(distinct)
        if missing:
            self.learn(missing)
        every = map(self.known.__getitem__, chain.from_iterable(found))
        return np.fromiter(every, dtype=np.int64, count=int(bounds[-1])), bounds

    def whole(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts have tokens: all their segments are valid."""
        bad = np.append(0, np.cumsum(~self.valid[at]))[bounds]
        return (np.diff(bad) == 0) & (np.diff(bounds) > 0)

    def doc_pairs(self, at: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text << 33 | pair), in order, of whole texts, and how often each occurs."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        kept = whole[doc]
        both, often = np.unique(doc[kept] * len(self.valid) + at[kept], return_counts=True)
        doc, seg = np.divmod(both, max(1, len(self.valid)))
        size = self.pair_bounds[seg + 1] - self.pair_bounds[seg]
        place = packed.ranges(self.pair_bounds[seg], size)
        key = np.repeat(doc << 33, size) | self.keys[place]
        order = np.argsort(key)
        key, times = key[order], (self.times[place] * np.repeat(often, size))[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key[first], np.add.reduceat(times, first) if len(first) else times


def _summed(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys with their counts summed."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


def _texts(batches, v, model):
    """Rows of all documents, and partial counts of one task: in how many of its documents each pair is linked."""
    aligner, held, size = Aligner(v, model), [], 0
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, texts in chunks(batch):
            at, bounds = aligner.rows(texts)
            whole = aligner.whole(at, bounds)
            sums = np.concatenate([np.zeros((1, aligner.numbers.shape[1]), np.int64), np.cumsum(aligner.numbers[at], axis=0)])[bounds]
            numbers = np.where(whole[:, None], np.diff(sums, axis=0), 0)
            width = aligner.text_bounds[at + 1] - aligner.text_bounds[at]
            text = aligner.text[packed.ranges(aligner.text_bounds[at], width)].tobytes()
            ends = np.append(0, np.cumsum(width))[bounds].tolist()
            view = memoryview(text)
            digests = [hashlib.sha256(view[x : y - 1]).hexdigest() if w else "" for x, y, w in zip(ends[:-1], ends[1:], whole.tolist())]
            key, times = aligner.doc_pairs(at, bounds, whole)
            per_doc, key = np.bincount(key >> 33, minlength=len(texts)), key & ((1 << 33) - 1)
            columns = [batch.column("doc_id").slice(first, len(texts)), *(pa.array(numbers[:, k]) for k in range(numbers.shape[1])), pa.array(digests, pa.string())]
            columns += [pa.array(np.arange(len(texts)) + ((part << 40) + done)), packed.list_array(key, per_doc), packed.list_array(times, per_doc)]
            done += len(texts)
            yield _with_nulls(columns, 0)
            held.append(np.unique(key, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from _partial(part, *held.pop())
                    size = 0
    yield from _partial(part, *_summed(held))


def _with_nulls(columns: list[pa.Array], first: int) -> pa.RecordBatch:
    """A batch of the columns of TEXTS and PARTS, of which those from ``first`` on are given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in f"{TEXTS}, {PARTS}".split(", ")]
    every = [columns[i - first] if first <= i < first + len(columns) else pa.nulls(len(columns[0]), kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(every, names=[name for name, _ in fields])


def _partial(part: int, keys: np.ndarray, counts: np.ndarray):
    for i in range(0, len(keys), 1 << 16):
        k, c = keys[i : i + (1 << 16)], counts[i : i + (1 << 16)]
        yield _with_nulls([pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(c.astype(np.int64))], len(TEXTS.split(", ")))


class Lookup:
    """Verified lookups of counts in the dense vectors of all buckets."""

    def __init__(self, rows: list[dict], buckets: int, best: np.ndarray):
        self.function, self.best = Function(rows, buckets), best
        self.keys = np.concatenate([np.asarray(r["keys"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
        self.counts = np.concatenate([np.asarray(r["counts"], np.int64) for r in rows] or [np.zeros(0, np.int64)])

    def __call__(self, keys: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(n_best, count_sum) of every document, whose pairs lie between the bounds."""
        slot = self.function.slots(keys)
        if (slot < 0).any() or (self.keys[slot] != keys).any():
            raise ValueError("a pair of a document was not counted")
        count = self.counts[slot]
        out = [times * (count == self.best[keys >> SHIFT]), times * count]
        return np.stack([np.append(0, np.cumsum(x))[bounds[1:]] - np.append(0, np.cumsum(x))[bounds[:-1]] for x in out], axis=1)


def _score(batches, shared):
    lookup = Lookup(*shared.value)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            keys, bounds = packed.list_bounds(batch.column("keys"))
            times, _ = packed.list_bounds(batch.column("times"))
            found = lookup(keys, times, bounds)
            names = [f.split(" ")[0] for f in ROW.split(", ")]
            new = {"n_best": pa.array(found[:, 0]), "count_sum": pa.array(found[:, 1])}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)


def default_model() -> str:
    return default_path("piece_bpe_32k.model")


def counts(docs: DataFrame, v: Vocabulary, model: bytes) -> tuple[DataFrame, DataFrame, int]:
    """The pass over the texts: the rows of the documents with their pairs, and `pair_counts.counted` of the pairs
    (A id << SHIFT | B id) over these rows."""
    given = jobs.with_columns(docs, doc_id="long", text="string")
    both = jobs.staged(given.mapInArrow(lambda batches: _texts(batches, v, model), f"{TEXTS}, {PARTS}"), "aligned")
    rows = both.where("row IS NOT NULL").drop("part", "key", "n")
    table, buckets = counted(both.where("key IS NOT NULL").select("part", "key", "n"))
    return rows, jobs.staged(table, "pairs"), buckets


def pair_table(table: DataFrame) -> DataFrame:
    """(a, b, n): the id pairs and in how many documents each is linked."""
    both = table.select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    return both.select(F.shiftright("p.keys", SHIFT).alias("a"), (F.col("p.keys") % (1 << SHIFT)).alias("b"), F.col("p.counts").alias("n"))


def aligned(spark: SparkSession, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row of ``docs``: tokens, groups, links, links that are the best of their A id, sum of the links' counts, digest of the groups."""
    v = vocabulary(path_a or default_path())
    with open(path_b or default_model(), "rb") as file:
        model = file.read()
    scored, table, buckets = counts(docs, v, model)
    best = pair_table(table).groupBy("a").agg(F.max("n").alias("best"))
    size = table.agg(F.coalesce(F.sum(F.size("keys") * 20 + F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= table_bytes:
        most = np.zeros(v.size, dtype=np.int64)
        for a, n in best.collect():  # at most one row per id of A
            most[a] = n
        rows = [{"bucket": r["bucket"], "sizes": r["sizes"], "bits": bytes(r["bits"]), "keys": np.array(r["keys"], np.int64), "counts": np.array(r["counts"], np.int64)} for r in table.toLocalIterator()]
        shared = spark.sparkContext.broadcast((sorted(rows, key=lambda r: r["bucket"]), buckets, most))
        return scored.mapInArrow(lambda batches: _score(batches, shared), ROW)
    told = pair_table(table).join(best, "a").select((F.shiftleft("a", SHIFT) + F.col("b")).alias("key"), "n", (F.col("n") == F.col("best")).alias("is_best"))
    links = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    sums = links.join(told, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"))
    out = scored.drop("keys", "times").join(sums, "row", "left")
    return out.select("doc_id", *NUMBERS, F.coalesce("_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
