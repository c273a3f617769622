"""Byte-level BPE against the tokenizers library, and the alignment of two tokenizers against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from pairloom.llm import bpe_codec, pair_counts, token_alignment
from tests.llm.conftest import frame

STRANGE = [
    "",
    None,
    " ",
    "a ",
    "\n",
    "hello world's  \n\t <|endoftext|><|endoftext|> x<|endoftext|> <s> </s><unk> they'll",
    "x▁y",
    "½²Ⅷ 3² Ᲊ aꟋ1 \U000105c0 ࣰ՘",
    "a" * 3000 + "b" * 700,
    "\x1c \x85\xa0　 x\0b <0x0A>",
    "日本語" * 300,
    "é́ ‍😀👨‍👩‍👧  ",
    "=" * 1000 + " " * 99 + "-" * 77,
    "_" * 5 + "__x" * 40,
]


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(1)
    ranges = [(32, 127), (0xA0, 0x2000), (0x3000, 0xD000), (0x10000, 0x1FFFF), (9, 14)]
    noise = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(150)) for _ in range(40)]
    letters = ["".join(rng.choice("abcdefghij") for _ in range(30_000))]
    return texts + [(7000 + i, t) for i, t in enumerate(STRANGE + noise + letters)] + [(None, "foo"), (7000, "foo"), (7000, "foo")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_path())


@pytest.fixture(scope="module")
def given(spark, rows):
    from pyspark.sql import functions as F

    return frame(spark, rows).withColumns({"ids": F.lit("<ids>"), "row": F.lit(1), "keys": F.lit(2)})


def test_round_trip(spark, given, rows, library):
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in bpe_codec.round_trip(spark, given).collect())
    want = collections.Counter()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_decoding_of_any_ids(spark, library):
    lists = [[0, 220, 10], [50256], [], None, [187, 188], [94, 40000], [-1, 70000, 5, None], [222] * 9, [168, 239]]
    v = bpe_codec.vocabulary(bpe_codec.default_path())
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe_codec.decoded(df, v).collect()}
    for doc, ids in enumerate(lists):
        kept = [i for i in ids or [] if i is not None and 0 <= i < v.size]
        assert got[doc] == library.decode(kept, skip_special_tokens=False), doc


def test_long_texts_come_in_slices(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CHUNK", 1000)
    monkeypatch.setattr(bpe_codec, "SLICE", 50)
    monkeypatch.setattr(bpe_codec, "WORDS", 60)
    v = bpe_codec.vocabulary(bpe_codec.default_path())
    texts = [" ".join(f"w{k % 97}<|endoftext|>" for k in range(900)), "short one", "½ " * 800]
    flat, size = bpe_codec.Encoder(v).encode(texts)
    ends = np.append(0, np.cumsum(size))
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bad_merge_order_is_refused(tmp_path):
    import json

    path = tmp_path / "v.json"
    vocab = {c: i for i, c in enumerate(bpe_codec.byte_characters())} | {"ab": 256, "abc": 257}
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}}))
    with pytest.raises(ValueError):
        bpe_codec.vocabulary(str(path))


def aligned_by_force(rows, library):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_model())
    byte_of = {c: b for b, c in enumerate(bpe_codec.byte_characters())}
    token = {i: bytes(byte_of[c] for c in t) for t, i in library.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        name = pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode()

    found = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        if not text or b"".join(map(token.get, a)) != whole or b"".join(map(piece, b)) != whole:
            found.append(None)
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((token.get, a), (piece, b))]
        cut = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cut]
        for side, ids in enumerate((a, b)):
            for i, group in zip(ids, np.searchsorted(cut, ends[side]).tolist()):
                groups[group][side].append(i)
        found.append((len(a), len(b), groups))
    count = collections.Counter()
    for one in filter(None, found):
        count.update({(p, q) for ga, gb in one[2] for p in ga for q in gb})
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for (doc, _), one in zip(rows, found):
        if one is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for ga, gb in one[2] for p in ga for q in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in one[2])
        best_links = sum(count[link] == best[link[0]] for link in links)
        out.append((doc, one[0], one[1], len(one[2]), len(links), best_links, sum(map(count.get, links)), hashlib.sha256(shown.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def forced(rows, library):
    library.encode_special_tokens = True
    try:
        return aligned_by_force(rows, library)
    finally:
        library.encode_special_tokens = False


@pytest.mark.parametrize("table_bytes", [token_alignment.TABLE_BYTES, 0])
def test_alignment(spark, given, forced, table_bytes):
    got = token_alignment.aligned(spark, given, table_bytes=table_bytes)
    assert collections.Counter(map(tuple, got.collect())) == forced


@pytest.mark.parametrize("table_bytes", [token_alignment.TABLE_BYTES, 0])
def test_texts_are_read_once(spark, given, table_bytes):
    plan = token_alignment.aligned(spark, given, table_bytes=table_bytes)._jdf.queryExecution().analyzed().toString()
    assert "text#" not in plan and "keys#" in plan


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None), (None, ""), (2, "▁")]):
        for size in (token_alignment.TABLE_BYTES, 0):
            got = token_alignment.aligned(spark, spark.createDataFrame(rows, "doc_id long, text string"), table_bytes=size)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, 0, 0, 0, 0, 0, 0, "") for d, _ in rows), key=repr)


def test_segments_are_the_text_and_forgotten_ones_come_back(rows, monkeypatch):
    for _, text in rows:
        assert not text or "".join(token_alignment.SEGMENT.findall(" " + text)) == " " + text
    monkeypatch.setattr(token_alignment, "SEGMENTS", 100)
    monkeypatch.setattr(token_alignment, "PAIRS", 7)
    v = bpe_codec.vocabulary(bpe_codec.default_path())
    with open(token_alignment.default_model(), "rb") as file:
        model = file.read()
    some = token_alignment.Aligner(v, model)
    texts = [t for _, t in rows if t][:60]
    numbers = []
    for text in texts:
        at, _ = some.rows([text])
        numbers.append(some.numbers[at].sum(axis=0).tolist())
    monkeypatch.undo()
    whole = token_alignment.Aligner(v, model)
    at, bounds = whole.rows(texts)
    assert [whole.numbers[at[a:b]].sum(axis=0).tolist() for a, b in zip(bounds[:-1], bounds[1:])] == numbers


def test_pair_counts(spark):
    rng = np.random.default_rng(4)
    keys = rng.choice(1 << 33, 3000, replace=False)
    rows = [(int(p), int(k), int(n)) for p in range(40) for k, n in zip(rng.choice(keys, 300, replace=False), rng.integers(1, 9, 300))]
    table, buckets = pair_counts.counted(spark.createDataFrame(rows, "part int, key long, n long"), bucket_keys=400)
    want = collections.Counter()
    for _, k, n in rows:
        want[k] += n
    got = {k: n for r in table.collect() for k, n in zip(r["keys"], r["counts"])}
    assert buckets > 3 and got == want
    function = pair_counts.Function([r.asDict() for r in table.orderBy("bucket").collect()], buckets)
    known = np.array(sorted(want))
    assert sorted(function.slots(known)) == list(range(len(known)))
    assert len(pair_counts.build(np.arange(100_000))) < 40
