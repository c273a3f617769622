import collections

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import sequences as S
from pairloom.functions.text import words
from pairloom.operators import bpe, encode, vocabulary

TEXT = st.text(alphabet=st.sampled_from(list("ab cD_é9.,!\n\t ß漢🙂")), max_size=30)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ids(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


@pytest.mark.parametrize(
    "values,expected",
    [((7, 8), [1, 7, 8, 2, 0, 0]), ((7, 8, 9, 10, 11, 12), [1, 7, 8, 9, 10, 2]), ((), [1, 2, 0, 0, 0, 0])],
)
def test_frame(spark, values, expected):
    assert one(spark, S.frame(ids(*values), 6)) == expected


def test_shift_and_mask(spark):
    row = ids(1, 7, 8, 2, 0, 0)
    assert one(spark, S.target_in(row, 6)) == [1, 7, 8, 2, 0]
    assert one(spark, S.target_out(row, 6)) == [7, 8, 2, 0, 0]
    assert one(spark, S.pad_mask(row)) == [True, True, True, True, False, False]


def corpus(spark, texts):
    return spark.createDataFrame([(i, "train", t, t) for i, t in enumerate(texts)], "pair_id long, split string, title string, code string")


def test_vocabulary_order_and_jump(spark):
    df = corpus(spark, ["b a a c", "c a b"])
    learned = {r["token"]: (r["id"], r["n"]) for r in vocabulary.learn_words(df).collect()}
    assert learned == {"a": (5, 3), "b": (6, 2), "c": (7, 2)}
    many = corpus(spark, [" ".join(f"w{i:05d}" for i in range(32010))])
    found = {r["token"]: r["id"] for r in vocabulary.learn_words(many).collect()}
    assert found["w31994"] == 31999 and found["w31995"] == 32100 and len(set(found.values())) == 32010
    assert vocabulary.learn_words(many, size=10).count() == 10


def test_special_tokens(spark):
    rows = {r["id"]: r for r in vocabulary.special_tokens(spark).collect()}
    assert len(rows) == 105 and rows[0]["token"] == "<pad>" and rows[0]["roles"] == "pad_token"
    assert rows[32000]["token"] == "<extra_id_99>" and rows[32099]["token"] == "<extra_id_0>"
    assert rows[1]["roles"] == "bos_token,cls_token" and [rows[i]["lstrip"] for i in (3, 4, 32050)] == [False, True, True]


def test_unknown_and_empty_texts(spark):
    words_ = vocabulary.full_vocabulary(vocabulary.learn_words(corpus(spark, ["a b"])))
    df = corpus(spark, ["a x b", "", " \n "])
    got = {r["pair_id"]: r for r in encode.encode_pairs(df, words_, 6, 6).collect()}
    assert got[0]["input_ids"] == [1, 5, 3, 6, 2, 0] and got[1]["input_ids"] == [1, 2, 0, 0, 0, 0] == got[2]["input_ids"]
    assert got[0]["targ_in"] == [1, 5, 3, 6, 2] and got[0]["targ_out"] == [5, 3, 6, 2, 0]
    back = {r["pair_id"]: r["text"] for r in encode.decode_text(encode.encode_pairs(df, words_, 6, 6), words_, "pair_id", "targ_out").collect()}
    assert back == {0: "a b", 1: "", 2: ""}


def test_encoding_moves_no_rows(spark):
    df = corpus(spark, ["a b"])
    plan = encode.encode_pairs(df, vocabulary.learn_words(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_known_words_come_back(spark, texts):
    df = corpus(spark, texts)
    known = vocabulary.learn_words(df)
    encoded = encode.encode_ids(df, known, {"code": 512})
    back = {r["pair_id"]: r["text"] for r in encode.decode_text(encoded, known, "pair_id", "code").collect()}
    expected = {r["pair_id"]: " ".join(r["w"]) for r in df.select("pair_id", words(F.col("code")).alias("w")).collect()}
    assert back == expected


def naive_merges(counts, merges):
    table = {w: [f"{b:02x}" for b in w.encode()] for w in counts}
    out = []
    for _ in range(merges):
        pairs = {}
        for w, symbols in table.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] = pairs.get(p, 0) + counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((*best, pairs[best]))
        for w, symbols in table.items():
            new, i = [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    new.append("".join(best))
                    i += 2
                else:
                    new.append(symbols[i])
                    i += 1
            table[w] = new
    return out


@pytest.mark.parametrize(
    "texts",
    [
        ["low low low lower lowest newest newest widest", "wide new low"],
        ["aaaa aaa aa aaaaa abab ababab", "bcbc bcd xyz xyz"],
        ["été étés 漢字 漢字 🙂🙂", "tête été ab ab"],
    ],
)
def test_merges_are_the_same_as_one_at_a_time(spark, texts):
    df = corpus(spark, texts)
    counts = {}
    for r in df.select(F.explode(bpe.subword_tokens(F.col("code"))).alias("w")).collect():
        counts[r["w"]] = counts.get(r["w"], 0) + 1
    got = bpe.learn_merges(df, "code", 25).orderBy("place").collect()
    assert [(r["left"], r["right"], r["n"]) for r in got] == naive_merges(counts, 25)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_subwords_are_lossless(spark, texts):
    df = corpus(spark, texts)
    merges = bpe.learn_merges(df, "code", 6)
    encoded = bpe.encode_subwords(df, merges, "code", "pair_id", 1000)
    back = {r["pair_id"]: r["text"] for r in bpe.decode_subwords(encoded, merges, "pair_id", "ids").collect()}
    assert back == dict(enumerate(texts))


def test_broken_bytes_are_replaced(spark):
    df = spark.createDataFrame([(1, [5 + 0xC3])], "pair_id long, ids array<int>")
    none = spark.createDataFrame([], bpe.MERGE_SCHEMA)
    assert bpe.decode_subwords(df, none, "pair_id", "ids").first()["text"] == "�"


def test_long_words_are_merged_in_order_and_quickly():
    def by_rescan(symbols, ranks):
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, (len(ranks), "")))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                both = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best
                out.append(symbols[i] + symbols[i + 1] if both else symbols[i])
                i += 2 if both else 1
            symbols = out
        return symbols

    import random
    import time

    rng = random.Random(3)
    learned = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("aa", "aa"), ("b", "ab"), ("abab", "aa"), ("b", "b")]
    ranks = {pair: (place, pair[0] + pair[1]) for place, pair in enumerate(learned)}
    for size in (0, 1, 2, 3, 50, 300):
        word = [rng.choice("abc") for _ in range(size)]
        assert bpe.heap_merge(word, ranks) == by_rescan(word, ranks)
    word = [rng.choice("ab") for _ in range(100_000)]
    start = time.perf_counter()
    assert "".join(bpe.heap_merge(word, ranks)) == "".join(word)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("look", [5, 512])
def test_rounds_of_merges_equal_single_merges_to_the_end(spark, look):
    """Ties, repeated symbols and symbols that arise in two ways, until no pair is left."""
    import random

    rng = random.Random(look)
    counts = collections.Counter()
    for _ in range(40):
        counts["".join(rng.choice("aabc") for _ in range(rng.randrange(1, 9)))] += rng.choice([1, 1, 2, 5])
    rows = [(k, " ".join([w] * 1)) for k, (w, n) in enumerate(counts.items()) for _ in range(n)]
    df = spark.createDataFrame(rows, "pair_id bigint, code string").repartition(3)
    got = bpe.learn_merges(df, "code", 10_000, look=look).orderBy("place").collect()
    want = naive_merges(counts, 10_000)
    assert [(r["left"], r["right"], r["n"]) for r in got] == want
