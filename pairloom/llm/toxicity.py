"""Toxicity scores from class-conditional Kneser-Ney models with shared backoff counts.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary labelled documents. A bigram counts the documents
of a class that hold it, so what one document repeats counts once. The lower order is a continuation count: after how many
different words a word occurs in the class. Every count is discounted by ``DISCOUNT`` or by itself, if it is smaller, and what
the discounts take goes to the next order; the last one is shared by both classes, in how many documents of the whole
corpus a word occurs. An expression that is rare in the labels is therefore smoothed by the shared counts, weighted by how much
a class prefers words with the same first ``STEM`` bytes. A word that no labelled document holds has the same shared
count under both classes, which leaves their ratio, so the corpus counts are taken of the words of the labelled documents.
Near copies among the labelled documents
(one of ``MARKS`` min-hashes in common) count once, or a family of copies would make all its words telling.

A document is compared by two length-normalised log-likelihood ratios, toxic against ordinary: the mean over all its words,
and the best mean over ``SPAN`` consecutive words (the best single word), by which a short toxic passage of a long text stands out. A logistic
curve fitted on labelled documents that the counts have not seen turns them, and the logarithm of the number of words
(among many the best one is better by chance), into a score from 0 to 1.

Labels are read only of rows whose crc32(doc_id as text) mod 4 is not 2 (``held_out``): remainders 0 and 1 give the counts,
3 the curve. At most about ``LABELLED`` rows and ``LABELLED_BYTES`` of text are learned from, chosen by a hash of doc_id; that
bounds the model that is sent to the tasks. No n-gram of them is cut. The shared counts cover all documents, and every whole
text is scored. Counting and scoring are distributed and per-batch sums are combined before they are shuffled.

Defined cases: null, empty and blank texts score as many parts as the curve's rows are toxic; a doc_id that is null is not
learned from (held_out is null); labels other than 0 and 1, and labels that contradict each other, are left out; without
labels of both classes every score is 0. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

LABELLED = 24_000
#: Bytes of text in the labelled documents that are learned from, about; this bounds the n-grams of the model.
LABELLED_BYTES = 32 << 20
#: What every count of a class gives to the lower order, at most: more than the usual share of 1, as an expression in three
#: documents or fewer says little about a class.
DISCOUNT = 3
SPAN = 1
#: Text bytes whose counts are summed before the shuffle.
GROUP_BYTES = 4 << 20
#: Min-hashes by which near copies among the labelled documents are told.
MARKS = 6
THRESHOLD = 0.3
FOLDS, HELD_OUT, CURVE = 4, 2, 3

CLASSES = ("toxic", "ordinary")
#: Bytes of a word that count as its stem.
STEM = 5

FEATURES = ("mean", "best", "size")
KINDS = ", ".join(f"{name} double" for name in FEATURES)
COUNTS = "before long, word long, toxic long, ordinary long"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _bigrams(piece: packed.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word before (0 at the start of a row), word, and the word's stem, as hashes."""
    found = packed.words(piece, lower=True)
    word = found.hashes.view(np.int64)
    sums = packed.prefix_sums(packed.LOWER[piece.data])
    stem = packed.span_hashes(sums, found.start, np.minimum(found.end, found.start + STEM)).view(np.int64)
    before = np.append(0, word[:-1]) if len(word) else word
    before[found.bounds[:-1][np.diff(found.bounds) > 0]] = 0
    return np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds)), before, word, stem


def _gather(before: np.ndarray, word: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values for every (before, word)."""
    order = np.lexsort((word, before))
    before, word = before[order], word[order]
    first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    return before[first], word[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _count(batches):
    """In how many labelled documents of each class a bigram occurs, and a stem, which has -2 as the word before."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        befores, words, classes, size = [], [], [], 0
        for piece in packed.pieces(batch):
            row, before, word, stem = _bigrams(piece)
            for given, what in ((before, word), (np.full(len(word), -2), stem)):
                order = np.lexsort((what, given, row))
                a, b, c = row[order], given[order], what[order]
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])) if len(a) else np.zeros(0, bool)
                befores.append(b[new])
                words.append(c[new])
                classes.append(toxic[piece.first + a[new]])
            size += len(piece.data)
            if size < GROUP_BYTES and piece.last < batch.num_rows:
                continue
            kind = np.concatenate(classes).astype(np.int64)
            got = _gather(np.concatenate(befores), np.concatenate(words), kind, 1 - kind)
            befores, words, classes, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["before", "word", "toxic", "ordinary"])


def _documents_with(batches, shipped):
    """How many documents of a batch hold each known word and stem, and (as word 0) how many they hold in all."""
    for batch in batches:
        for given, known in shipped.value.items():
            count, total = np.zeros(len(known), np.int64), 0
            for piece in packed.pieces(batch):
                row, _, word, stem = _bigrams(piece)
                row, word, _ = _gather(row, word if given == -1 else stem, np.ones(len(row), np.int64))
                place, mine = _find(known, word)
                count += np.bincount(place[mine], minlength=len(known))
                total += len(word)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some) + 1, given)), pa.array(np.append(known[some], 0)), pa.array(np.append(count[some], total))],
                names=["before", "word", "documents"],
            )


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return place, sorted_keys[place] == keys


def _marks(batches):
    """Min-hashes of the 5-word shingles of each text; those of shorter texts are their own, from the doc_id."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.repeat(packed.mix(ids.view(np.uint64))[:, None], MARKS, axis=1)
        for piece in packed.pieces(batch):
            found = packed.words(piece, lower=True)
            hashes, whole = packed.windows(found, 5)
            row = np.repeat(np.arange(piece.last - piece.first), np.diff(found.bounds))[whole]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            for k in range(MARKS if len(row) else 0):
                out[piece.first + row[first], k] = np.minimum.reduceat(packed.mix(hashes[whole] + np.uint64(k + 1)), first)
        yield pa.RecordBatch.from_arrays([pa.array(ids), packed.list_array(out.view(np.int64).ravel(), np.full(len(ids), MARKS))], names=["doc_id", "marks"])


class Model:
    """Both classes' probabilities of the words after each other, as sorted hashes and arrays."""

    def __init__(self, counts: dict[str, np.ndarray], sums: dict[int, dict[str, np.ndarray]], shared: dict[int, tuple[np.ndarray, np.ndarray, int]]):
        def level(given: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
            """Keys, discounted parts, what is left for the shared counts, shared parts, and the part of the unseen."""
            mine = np.flatnonzero(counts["before"] == given)
            mine = mine[np.argsort(counts["word"][mine])]
            keys, of = counts["word"][mine], sums[given]
            total = np.maximum(of["total"], 1)[:, None]
            count = np.stack([counts[c][mine] for c in CLASSES])
            weight = np.clip(of["left"] / total[:, 0], 1e-3, 1)[:, None]
            met, documents, all_of_them = shared[given]
            floor = 1.0 / (all_of_them + 1.0)
            place, known = _find(met, keys)
            common = (np.where(known, documents[place] if len(documents) else 0, 0) + 1.0) * floor
            return mine, keys, np.maximum(count - DISCOUNT, 0) / total, weight, common, floor

        _, self.stems, high, weight, common, _ = level(-2)
        self.lean = np.clip(high / common + weight, 0.02, 50.0)  # how much a class prefers a stem to the whole corpus
        self.plain = np.clip(weight, 0.02, 50.0)
        mine, self.words, self.high, weight, self.common, self.floor = level(-1)
        self.weight = weight
        heads = np.stack([counts[f"heads_{c}"][mine] for c in CLASSES]).astype(float)
        left = np.stack([counts[f"left_{c}"][mine] for c in CLASSES])
        starts, starts_left = sums[0]["starts"][:, None], sums[0]["starts_left"][:, None]
        self.back = np.where(heads > 0, left / np.maximum(heads, 1), 1.0)  # what the discounts of a context leave to the lower order
        self.start_back = np.where(starts > 0, starts_left / np.maximum(starts, 1), 1.0)

        pair = np.flatnonzero((counts["before"] != -1) & (counts["before"] != -2))
        before = counts["before"][pair]
        keys = packed.mix(packed.mix(before.view(np.uint64)) + counts["word"][pair].view(np.uint64))
        order = np.argsort(keys)
        pair, before, self.pairs = pair[order], before[order], keys[order]
        context, known = _find(self.words, before)
        heads = np.where(before == 0, starts, np.where(known, heads[:, context] if heads.size else 0, 0))
        joint = np.stack([counts[c][pair] for c in CLASSES]).astype(float)
        self.joint = np.maximum(joint - DISCOUNT, 0) / np.maximum(heads, 1)

    @classmethod
    def of(cls, state: dict) -> Model:
        """The model again from its arrays, which are what is sent to the tasks."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    def ratios(self, before: np.ndarray, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary)."""
        place, known = _find(self.stems, stem)
        lean = np.where(known, self.lean[:, place], self.plain) if len(self.stems) else np.ones((2, len(word)))
        place, known = _find(self.words, word)
        low = self.weight * np.where(known, self.common[place], self.floor) * lean if len(self.words) else self.weight * self.floor * lean
        if len(self.words):
            low = low + np.where(known, self.high[:, place], 0.0)
            context, heard = np.append(place[-1:], place[:-1]), np.append(known[-1:], known[:-1])  # the word before is the one looked up before
            back = np.where(before == 0, self.start_back, np.where(heard, self.back[:, context], 1.0))
        else:
            back = 1.0
        pair, met = _find(self.pairs, packed.mix(packed.mix(before.view(np.uint64)) + word.view(np.uint64)))
        high = np.where(met, self.joint[:, pair], 0.0) if len(self.pairs) else 0.0
        both = np.log(high + back * low)
        return both[0] - both[1]


def features(piece: packed.Piece, model: Model) -> np.ndarray:
    """Per row: the mean ratio of its words, the best mean over SPAN consecutive words (over all, if there are fewer), and
    the logarithm of one more than its words."""
    row, before, word, stem = _bigrams(piece)
    rows = len(piece.bounds) - 1
    out = np.zeros((rows, len(FEATURES)))
    if not len(word):
        return out
    total = np.append(0, np.cumsum(model.ratios(before, word, stem)))
    size = np.bincount(row, minlength=rows)
    bounds = np.append(0, np.cumsum(size))
    some = np.flatnonzero(size)
    out[some, 0] = (total[bounds[some + 1]] - total[bounds[some]]) / size[some]
    start = np.arange(len(word))
    width = np.minimum(SPAN, size[row])
    inside = start + width <= bounds[row + 1]
    best = np.where(inside, (total[np.minimum(start + width, len(word))] - total[start]) / width, -np.inf)
    out[some, 1] = np.maximum.reduceat(best, bounds[some])
    out[:, 2] = np.log1p(size)
    return out


def _features(batches, shipped, extra: list[str]):
    model = Model.of(shipped.value)
    for batch in batches:
        out = np.zeros((batch.num_rows, len(FEATURES)))
        for piece in packed.pieces(batch):
            out[piece.first : piece.last] = features(piece, model)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(batch.column(c) for c in extra), *(pa.array(x) for x in out.T.copy())], names=["doc_id", *extra, *FEATURES]
        )


def fitted_curve(values: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a constant and the features, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(values)), values])
    weight = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        gradient = x.T @ (toxic - p) - 1e-3 * weight
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), gradient)
        weight += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return weight


def learned(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Model, as a broadcast of its arrays, curve, and the part of toxic rows it was fitted on; None if the labels that may be used do not show both classes."""
    labels = jobs.with_columns(labels, doc_id="long", toxic="int").where("toxic IN (0, 1)").where(fold(F.col("doc_id")) != HELD_OUT)
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(labels, "doc_id")
    rows, size = sizes.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    part = min(1.0, LABELLED / max(1, rows), LABELLED_BYTES / max(1, size))
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(part * (1 << 20))
    sample = jobs.staged(docs.where(share & F.col("text").isNotNull()).join(labels.where(share), "doc_id"), "toxicity-sample")
    marks = jobs.staged(sample.mapInArrow(_marks, "doc_id long, marks array<long>"), "toxicity-marks")
    for k in range(MARKS):  # of rows that share a min-hash only the first is learned from
        first = marks.groupBy(F.col("marks")[k].alias("mark")).agg(F.min("doc_id").alias("doc_id"))
        marks = marks.join(first.select("doc_id").distinct(), "doc_id")
    sample = jobs.staged(sample.join(marks.select("doc_id").distinct(), "doc_id"), "toxicity-distinct")

    counts = sample.where(fold(F.col("doc_id")) != CURVE).mapInArrow(_count, COUNTS)
    counts = jobs.staged(counts.groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in CLASSES)), "toxicity-counts")
    types = [F.count(F.when(F.col(c) > 0, 1)) for c in CLASSES]
    after = counts.where("before <> -2").groupBy("word").agg(*(n.alias(c) for n, c in zip(types, CLASSES)))
    counts = counts.unionByName(after.withColumn("before", F.lit(-1).cast("long")))  # Kneser-Ney: how many words it follows
    kind = F.when(F.col("before").isin(-1, -2), F.col("before")).otherwise(0)
    left = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    start = F.when(F.col("before") == 0, 1).otherwise(0)
    rows = counts.groupBy(kind.alias("kind")).agg(
        *(F.sum(c).alias(f"{c}_total") for c in CLASSES),
        *(left(c).alias(f"{c}_left") for c in CLASSES),
        *(F.sum(start * F.col(c)).alias(f"{c}_starts") for c in CLASSES),
        *(F.sum(start * F.least(F.col(c), F.lit(DISCOUNT))).alias(f"{c}_starts_left") for c in CLASSES),
    )
    names = ("total", "left", "starts", "starts_left")
    sums = {r["kind"]: {name: np.array([r[f"{c}_{name}"] for c in CLASSES], dtype=float) for name in names} for r in rows.collect()}
    if not sums or not sums[-1]["total"].all():
        return None
    found = [f(c).alias(f"{name}_{c}") for name, f in (("heads", F.sum), ("left", left)) for c in CLASSES]
    heads = counts.where(kind == 0).groupBy(F.col("before").alias("word")).agg(*found)
    unigrams = counts.where("before = -1").join(heads, "word", "left").fillna(0)
    told = F.greatest(*CLASSES) > DISCOUNT  # of other n-grams nothing but what they leave to the lower order is in the model
    others = counts.where((F.col("before") != -1) & told).select("*", *(F.lit(0).cast("long").alias(f"{a}_{c}") for a in ("heads", "left") for c in CLASSES))
    kept = unigrams.unionByName(others).orderBy("before", "word").toArrow()
    entries = {c: kept.column(c).to_numpy().astype(np.int64) for c in kept.column_names}

    known = docs.sparkSession.sparkContext.broadcast({given: np.sort(entries["word"][entries["before"] == given]) for given in (-1, -2)})
    found = docs.mapInArrow(lambda batches: _documents_with(batches, known), "before long, word long, documents long")
    found = found.groupBy("before", "word").agg(F.sum("documents").alias("documents")).orderBy("before", "word").toArrow()
    given, word, documents = (found.column(c).to_numpy() for c in ("before", "word", "documents"))
    shared = {}
    for level in (-1, -2):
        every, mine = (given == level) & (word == 0), (given == level) & (word != 0)
        shared[level] = (word[mine], documents[mine], int(documents[every].sum()))
    model = Model(entries, sums, shared)
    del kept, entries, found, given, word, documents, shared

    shipped = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    seen = sample.where(fold(F.col("doc_id")) == CURVE).mapInArrow(lambda batches: _features(batches, shipped, ["toxic"]), f"doc_id long, toxic int, {KINDS}").toArrow()
    values = np.column_stack([seen.column(c).to_numpy() for c in FEATURES])
    toxic = seen.column("toxic").to_numpy().astype(float)
    return (shipped, fitted_curve(values, toxic), toxic.mean()) if 0 < toxic.sum() < len(toxic) else None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the features."""
    docs = jobs.with_columns(docs, doc_id="long", text="string")
    held_out = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    found = learned(docs, labels)
    if found is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *(F.lit(0.0).alias(c) for c in FEATURES))
    shipped, curve, share = found
    out = docs.mapInArrow(lambda batches: _features(batches, shipped, []), f"doc_id long, {KINDS}")
    score = 1 / (1 + F.exp(-sum((F.col(c) * float(w) for c, w in zip(FEATURES, curve[1:])), F.lit(float(curve[0])))))
    score = F.round(F.when(F.col("size") > 0, score).otherwise(float(share)), 9)  # sums of equal texts differ in the last places
    out = out.withColumn("score", score)
    return out.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)
