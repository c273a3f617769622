"""Byte-level BPE encoding and decoding in batched merge rounds.

1. *Words.* A text is cut at the strings of special tokens and, between them, into words by the vocabulary's pattern. Each
   task keeps the ids of the words it has met (at most ``WORDS``, then it starts anew), so a word is merged once per task.
2. *Merge rounds.* All new words of a chunk stand in one flat array of symbols. A round looks up the rank of every adjacent
   pair by binary search over the sorted pair keys, takes the lowest rank of each word, merges all its occurrences from
   left to right, and looks up again only what has new neighbours. Words without a known pair leave the array. A word of
   more than ``LONG`` bytes would take as many rounds as it has different merges; it is merged with a heap of ranks over
   linked symbols instead, in O(n log n).
3. *Decoding* gathers the bytes of all ids at once; bytes that form no character become U+FFFD.

Both directions are narrow: no shuffle, and a task holds one chunk of about ``CHUNK`` characters (a longer text is taken in
slices of ``SLICE`` words), its words and the vocabulary. The vocabulary file is read on the driver and goes along with the
tasks (about 2 MB for 50,000 entries; its size does not depend on the documents).

Defined cases: a null or empty text has no ids and decodes to the empty text; ids that are null or outside the vocabulary
decode to nothing; a null list decodes to the empty text; the string of a special token becomes its id unless ``specials``
is off; equal rows give equal results; other columns are ignored; rows keep their doc_id, null or not.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import jobs, packed
from pairloom.operators.bpe import heap_merge
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)
travels_with_tasks("pairloom.operators.bpe")

CHUNK = 1 << 20
SLICE = 1 << 17
WORDS = 1 << 19
LONG = 512
NONE = np.int32(2**31 - 1)

# Fixed value: the pattern that cuts texts into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without uncommon characters, for the faster engine.
PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def uncommon_characters() -> tuple[str, str]:
    """Characters that the plain pattern below would class wrongly (digits that are no decimal digits, and four separators),
    and letters and digits that Unicode took up only recently, on which pattern engines differ."""
    known = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    digits = "".join(c for c in known if unicodedata.category(c) in ("Nl", "No"))
    recent = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", known) if unicodedata.category(c) == "Cn")
    return digits + "\x1c\x1d\x1e\x1f", recent


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary as arrays. ``keys`` are left id * size + right id, sorted, with their rank and result."""

    size: int
    first: np.ndarray  # id of each byte
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    data: np.ndarray  # bytes of all tokens, one after another
    bounds: np.ndarray
    specials: dict[str, int]
    uncommon: str
    recent: str
    _heap: dict = field(default_factory=dict)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def heap(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, result), made where a long word first asks for it."""
        if not self._heap:
            left, right = np.divmod(self.keys, self.size)
            self._heap = {pair: told for pair, told in zip(zip(left.tolist(), right.tolist()), zip(self.ranks.tolist(), self.results.tolist()))}
        return self._heap


def vocabulary(path: str) -> Vocabulary:
    """Read a vocabulary file (the JSON form with ``model.vocab`` and ``model.merges``) on the driver."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    ids, merges = given["model"]["vocab"], given["model"]["merges"]
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    specials = {token["content"]: token["id"] for token in given.get("added_tokens", [])}
    size = max([*ids.values(), *specials.values()]) + 1
    tokens = [b""] * size
    for token, number in ids.items():
        tokens[number] = bytes(byte_of[c] for c in token)
    for token, number in specials.items():
        tokens[number] = token.encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
    results = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
    made = np.full(size, -1)
    made[results[::-1]] = np.arange(len(pairs))[::-1]
    if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
        raise ValueError("a merge comes before the merge that makes one of its symbols")
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(t) for t in tokens])
    return Vocabulary(
        size,
        np.array([ids[c] for c in byte_characters()], dtype=np.int64),
        keys[order],
        np.arange(len(pairs), dtype=np.int32)[order],
        results[order].astype(np.int32),
        np.frombuffer(b"".join(tokens), dtype=np.uint8),
        np.append(0, np.cumsum(sizes)),
        specials,
        *uncommon_characters(),
    )


def merge_rounds(v: Vocabulary, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that are given as consecutive bytes: flat ids and how many each word has."""
    symbol, word = v.first[data], np.repeat(np.arange(len(size)), size)
    by_rank = np.empty(len(v.ranks), dtype=np.int64)
    by_rank[v.ranks] = v.results
    rank = np.full(len(symbol), NONE, dtype=np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = v.pair_ranks(symbol[inner], symbol[inner + 1])
    done_symbols, done_words = [], []
    while len(symbol):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(start, len(word)))
        least = np.minimum.reduceat(rank, start)
        if (least == NONE).any():
            live = np.repeat(least < NONE, count)
            done_symbols.append(symbol[~live])
            done_words.append(word[~live])
            symbol, word, rank = symbol[live], word[live], rank[live]
            count, least = count[least < NONE], least[least < NONE]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(least, count))
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), place, 0))
        at = at[(place - run) % 2 == 0]  # of a run of the same symbol, every second pair
        symbol[at] = by_rank[rank[at]]
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        symbol, word, rank = symbol[keep], word[keep], rank[keep]
        changed = np.concatenate([at, at[at > 0] - 1])
        rank[changed] = NONE
        changed = changed[changed + 1 < len(word)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed] = v.pair_ranks(symbol[changed], symbol[changed + 1])
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    word = np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(size))


class Encoder:
    """Words to ids within one task, each word merged once."""

    def __init__(self, v: Vocabulary, specials: bool = True):
        self.v, self.specials = v, v.specials if specials else {}
        self.pattern, self.plain = regex.compile(PATTERN), re.compile(PLAIN)
        self.recent, self.uncommon = set(v.recent), set(v.uncommon) | set(v.recent)
        self.odd = False  # whether the texts at hand have uncommon characters
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens are known; their keys are numbers, which no word equals."""
        self.known: dict = {number: place for place, number in enumerate(self.specials.values())}
        self.flat = np.array(list(self.specials.values()), dtype=np.int32)
        self.bounds = np.arange(len(self.flat) + 1)

    def _words(self, text: str):
        pattern = self.plain
        if self.odd and not self.uncommon.isdisjoint(text):
            if not self.recent.isdisjoint(text):
                from tokenizers.pre_tokenizers import ByteLevel  # its own, older, character classes decide

                return (text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text))
            pattern = self.pattern
        if len(text) < CHUNK:
            return pattern.findall(text)
        return (m.group() for m in pattern.finditer(text))

    def slices(self, text: str):
        """The words of a text, special tokens as their ids, in lists of at most SLICE."""
        for place, part in enumerate(self.cut.split(text) if self.specials else [text]):
            if place % 2:
                yield [self.specials[part]]
            elif part:
                found = self._words(part)
                if isinstance(found, list) and len(found) <= SLICE:
                    yield found
                    continue
                found = iter(found)
                while some := list(islice(found, SLICE)):
                    yield some

    def learn(self, words: set) -> None:
        missing = list(words.difference(self.known))
        if missing and len(self.known) + len(missing) > WORDS:
            self._forget()
            missing = [w for w in words if w not in self.known]
        if not missing:
            return
        coded = list(map(str.encode, missing))
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        long = np.flatnonzero(size > LONG).tolist()
        apart = {k: heap_merge([int(self.v.first[b]) for b in coded[k]], self.v.heap()) for k in long}
        for k in long:
            coded[k] = b""
        size[long] = 0
        flat, count = merge_rounds(self.v, np.frombuffer(b"".join(coded), dtype=np.uint8), size)
        if apart:
            ends = np.cumsum(count)
            flat = np.concatenate([np.concatenate([flat[e - c : e], apart.get(k, [])]) for k, (e, c) in enumerate(zip(ends, count))])
            count[long] = [len(apart[k]) for k in long]
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing))))
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])

    def ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and how many each has."""
        self.learn(set(words))
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        size = self.bounds[at + 1] - self.bounds[at]
        return self.flat[packed.ranges(self.bounds[at], size)], size

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and how many each has."""
        out, total = [np.zeros(0, np.int32)], np.zeros(len(texts), dtype=np.int64)
        words: list = []
        rows: list[tuple[int, int]] = []

        def flush() -> None:
            flat, size = self.ids(words)
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([n for _, n in rows]))]
            np.add.at(total, [row for row, _ in rows], np.diff(ends))
            out.append(flat)
            words.clear()
            rows.clear()

        self.odd = not self.uncommon.isdisjoint(set().union(*filter(None, texts)))
        for row, text in enumerate(texts):
            for some in self.slices(text or ""):
                words.extend(some)
                rows.append((row, len(some)))
                if len(words) >= SLICE:
                    flush()
        if words:
            flush()
        return np.concatenate(out), total


def chunks(batch: pa.RecordBatch, column: str = "text"):
    """(first row, texts) of consecutive rows with about CHUNK characters; a longer text is alone."""
    values = batch.column(column)
    size = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        before = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield first, values.slice(first, last - first).to_pylist()
        first = last


def _encode(batches, v: Vocabulary, specials: bool):
    encoder = Encoder(v, specials)
    for batch in batches:
        for first, texts in chunks(batch):
            flat, size = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), packed.list_array(flat, size)], names=["doc_id", "ids"])


def encoded(docs: DataFrame, v: Vocabulary, specials: bool = True) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    given = jobs.with_columns(docs, doc_id="long", text="string")
    return given.mapInArrow(lambda batches: _encode(batches, v, specials), "doc_id long, ids array<int>")


def token_bytes(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lists of ids, and the bounds of each list within them."""
    size = v.bounds[ids + 1] - v.bounds[ids]
    return v.data[packed.ranges(v.bounds[ids], size)], np.append(0, np.cumsum(size))[bounds]


def _decode(batches, v: Vocabulary):
    for batch in batches:
        ids, bounds = packed.list_bounds(pa.compute.fill_null(batch.column("ids").cast(pa.list_(pa.int64())), []))
        ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
        good = (ids >= 0) & (ids < v.size)
        ids, bounds = ids[good], np.append(0, np.cumsum(good))[bounds]
        size = np.append(0, np.cumsum(v.bounds[ids + 1] - v.bounds[ids]))[bounds]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, min(batch.num_rows, int(np.searchsorted(size, size[first] + CHUNK, side="right")) - 1))
            data, within = token_bytes(v, ids[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(within[:-1].tolist(), within[1:].tolist())]
            out = [batch.column("doc_id").slice(first, last - first), batch.column("ids").slice(first, last - first), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "text"])
            first = last


def decoded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids, text) of every row of ``rows`` (doc_id, ids)."""
    given = jobs.with_columns(rows, doc_id="long", ids="array<int>")
    return given.mapInArrow(lambda batches: _decode(batches, v), "doc_id long, ids array<int>, text string")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabularies of this installation lie; any other file's path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): every text encoded, and its ids decoded again."""
    v = vocabulary(path or default_path())
    return decoded(encoded(docs, v), v)
