"""Byte-pair subwords. A symbol is the hexadecimal form of its bytes; a word is its symbols joined by blanks."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.sequences import truncate
from pairloom.operators.encode import decode_text, sliced
from pairloom.settings import MASK, SENTINELS, SENTINELS_START, VOCABULARY_BOUND, VOCABULARY_SIZE
from pairloom.workspace import stage, travels_with_tasks

travels_with_tasks(__name__)

# Words keep a leading blank, so the pieces of a text join back to the text itself.
PIECE_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_WORDS, KNOWN_LENGTH = 1 << 15, 64  # words whose pieces a task keeps from one slice to the next
MERGE_SCHEMA = "place int, left string, right string, n bigint"


def subword_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def as_bytes(word: Column) -> Column:
    """A word as single-byte symbols."""
    return F.trim(F.regexp_replace(F.lower(F.hex(F.encode(word, "UTF-8"))), "(..)", "$1 "))


def as_text(symbols: Column) -> Column:
    """Symbols back to text; bytes that form no character become the replacement character."""
    return F.make_valid_utf8(F.unhex(symbols).cast("string"))


def word_counts(texts: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """Distinct words as symbols with their counts, counted within each task first."""
    counted = (
        texts.select(F.explode(subword_tokens(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    return counted.select(as_bytes(F.col("word")).alias("word"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """How often two symbols stand next to each other."""
    symbols = F.split("word", " ")
    follow = F.arrays_zip(symbols.alias("left"), F.slice(symbols, 2, F.size(symbols)).alias("right"))
    pairs = words.select(F.explode(follow).alias("p"), "n").select("p.left", "p.right", "n")
    return pairs.filter(F.col("right").isNotNull()).groupBy("left", "right").agg(F.sum("n").alias("n"))


def independent_merges(top: list, look: int, symbols: set[str]) -> list:
    """The leading pairs that can be merged in one round with the same result as one at a time.

    ``top`` holds the ``look`` first pairs by count, left and right (fewer if there are no more), ``symbols`` all merged
    symbols so far. Two pairs touch only where the right symbol of one is the left symbol of the other: equal left or
    equal right symbols never share an occurrence. So

    * the round ends before the first pair that touches a taken one, whose count may fall;
    * new pairs come from touching pairs only, so none counts more than the first of these. A taken pair with just that
      count stays if all new pairs sort behind it: those with a new right symbol always do, those with a new left
      symbol do if that symbol does;
    * a pair of equal symbols, and one whose result is a symbol already, change more than that and end a round.
    """
    taken, lefts, rights, results = [], set(), set(), set()
    barrier = top[-1]["n"] if len(top) == look else 0
    for place, pair in enumerate(top):
        if pair["right"] in lefts or pair["left"] in rights:
            barrier = pair["n"]
            break
        taken.append(pair)
        lefts.add(pair["left"])
        rights.add(pair["right"])
        result = pair["left"] + pair["right"]
        if pair["left"] == pair["right"] or result in symbols or result in results:
            barrier = top[place + 1]["n"] if place + 1 < len(top) else barrier
            break
        results.add(result)
    kept = taken[:1]
    for pair in taken[1:]:
        first = min(t["left"] + t["right"] for t in kept)
        if pair["n"] < barrier or (pair["n"] == barrier and first <= pair["left"]):
            break
        kept.append(pair)
    return kept


def merge_once(symbols: list[str], pairs: set[tuple[str, str]]) -> list[str]:
    """Merge pairs that do not touch each other, from left to right."""
    if pairs.isdisjoint(zip(symbols, symbols[1:])):
        return symbols
    out, i = [], 0
    while i < len(symbols):
        both = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) in pairs
        out.append(symbols[i] + symbols[i + 1] if both else symbols[i])
        i += 2 if both else 1
    return out


def _merged(batches, rounds: list[set[tuple[str, str]]]):
    for batch in batches:
        words = [w.split(" ") for w in batch.column("word").to_pylist()]
        for pairs in rounds:
            words = [merge_once(w, pairs) for w in words]
        yield pa.RecordBatch.from_pydict({"word": pa.array([" ".join(w) for w in words], pa.string()), "n": batch.column("n")})


def learn_merges(texts: DataFrame, column: str, merges: int = VOCABULARY_SIZE, min_count: int = 1, look: int = 512, rewrite: int = 8) -> DataFrame:
    """The first ``merges`` merges as ``(place, left, right, n)``: most frequent pair first, then by left and right.

    Works on distinct words with counts, until there is no pair left. A round is one job: it applies the merges learned since
    the words were last written, counts pairs and returns the ``look`` first ones; all leading pairs that cannot change each
    other are merged together, which gives the same list as one merge per round. Every ``rewrite`` rounds the words are
    written to the shared folder. At most ``merges`` rows and ``look`` pairs are on the driver.
    """
    spark = texts.sparkSession
    words = stage(word_counts(texts, column, min_count), "words")
    learned, rounds, symbols = [], [], set()
    while len(learned) < merges:
        now = words.mapInArrow(lambda batches, rounds=tuple(rounds): _merged(batches, rounds), "word string, n bigint") if rounds else words
        if len(rounds) >= rewrite:
            now = words = stage(now, "words")
            rounds = []
        top = pair_counts(now).orderBy(F.desc("n"), "left", "right").limit(look).collect()  # at most ``look`` rows
        if not top:
            break
        chosen = independent_merges(top, look, symbols)[: merges - len(learned)]
        for pair in chosen:
            learned.append((len(learned), pair["left"], pair["right"], pair["n"]))
        symbols.update(pair["left"] + pair["right"] for pair in chosen)
        rounds.append({(pair["left"], pair["right"]) for pair in chosen})
    return spark.createDataFrame(learned, MERGE_SCHEMA)


def subword_vocabulary(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """``(token, id)``: the 256 bytes, then one symbol per merge, behind the reserved ids."""
    bytes_ = spark.range(0, 256, 1, 1).select(
        F.lower(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("place")
    )
    joined = merges.select(F.concat("left", "right").alias("token"), (F.col("place") + 256).alias("place"))
    place = F.col("place") + MASK + 1
    symbols = bytes_.unionByName(joined).groupBy("token").agg(F.min("place").alias("place"))
    return symbols.select("token", F.when(place < SENTINELS_START, place).otherwise(place + SENTINELS).alias("id"))


def heap_merge(symbols: list, merges: dict) -> list:
    """Apply merges ((left, right) -> (place, result)) to one word, earliest learned first and from left to right.

    Symbols are linked, and a heap holds the pairs that can be merged, so a word of n symbols takes O(n log n).
    """
    n, symbols = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in merges]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = merges[left, right][1], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        after[j] = n
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                pair = (symbols[k], symbols[after[k]])
                if pair in merges:
                    heapq.heappush(heap, (merges[pair][0], k, pair))
    return [s for s in symbols if s is not None]


def _to_subwords(batches, shared, key: str, most: int):
    merges, ids = shared.value
    known: dict[str, list[int]] = {}

    def pieces_of(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            found = [ids[s] for s in heap_merge([f"{b:02x}" for b in word.encode()], merges)]
            if len(word) <= KNOWN_LENGTH:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[word] = found
        return found

    for batch in sliced(batches, "words"):
        column = batch.column("words")
        words = pc.list_flatten(column).dictionary_encode()
        split = [pieces_of(word) for word in words.dictionary.to_pylist()]
        pieces = pa.array(split, pa.list_(pa.int32())).take(words.indices)
        after = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)))
        bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
        start, size = after[bounds[:-1]], np.minimum(np.diff(after[bounds]), most)
        ends = np.cumsum(size)
        kept = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pc.list_flatten(pieces).take(pa.array(kept, pa.int64())))
        yield pa.RecordBatch.from_pydict({key: batch.column(key), "ids": lists})


def encode_subwords(texts: DataFrame, merges: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """``(key, ids)`` by learned merges, at most ``limit - 2`` ids per text.

    No shuffle: the merges, a table of a checked size, go to all tasks; a slice of an Arrow batch (at most ``PIECES`` words)
    splits its distinct words once and looks all others up by their place in the slice's dictionary. A text has at least as many ids as words, so cutting
    to ``limit - 2`` words first loses nothing.
    """
    spark = texts.sparkSession
    learned = merges.limit(VOCABULARY_BOUND + 1).collect()
    if len(learned) > VOCABULARY_BOUND:
        raise ValueError(f"at most {VOCABULARY_BOUND} merges")
    ranks: dict = {}
    for m in sorted(learned, key=lambda m: m["place"]):
        ranks.setdefault((m["left"], m["right"]), (m["place"], m["left"] + m["right"]))
    ids = {v["token"]: v["id"] for v in subword_vocabulary(spark, merges).collect()}
    shared = spark.sparkContext.broadcast((ranks, ids))
    kind = texts.schema[key].dataType.simpleString()
    words = F.coalesce(truncate(subword_tokens(F.col(column)), limit), F.array().cast("array<string>"))
    cut = texts.select(key, words.alias("words"))
    return cut.mapInArrow(lambda batches: _to_subwords(batches, shared, key, limit - 2), f"`{key}` {kind}, ids array<int>")


def decode_subwords(rows: DataFrame, merges: DataFrame, key: str, ids: str) -> DataFrame:
    """Ids back to text: the bytes of all pieces, joined. Narrow, like ``decode_text``."""
    joined = decode_text(rows, subword_vocabulary(rows.sparkSession, merges), key, ids, "")
    return joined.withColumn("text", as_text(F.col("text")))
