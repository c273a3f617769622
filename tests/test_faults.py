"""Cases that used to give wrong rows without a word."""

import math
import sqlite3

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from pairloom.functions import scoring
from pairloom.operators import bpe, encode, history, metrics, ranking, split, vectors, vocabulary
from pairloom.plans import training
from pairloom.sources import pairs as P
from pairloom.sources import stages
from pairloom.streaming import prompts as live
from pairloom.workspace import laid_out, new_folder, remove, scratch, stage

TURNS = "conv_id long, turn long, role string, text string"


def test_prompts_of_long_conversations_do_not_clash(spark):
    turns = spark.createDataFrame([(1, 1005, "user", "a"), (2, 5, "user", "b")], TURNS)
    with pytest.raises(Exception, match="raise the stride"):
        P.prompts_from_turns(turns).collect()
    ids = [r[0] for r in P.prompts_from_turns(turns, stride=10_000).collect()]
    assert sorted(ids) == [11_005, 20_005]


def test_sqlite_keeps_its_own_pair_id(spark, tmp_path, rows):
    path = str(tmp_path / "own.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE snippets (pair_id INTEGER, title TEXT)")
        db.executemany("INSERT INTO snippets VALUES (?, ?)", [(500, "a"), (501, "b"), (502, "c")])
    assert rows(P.read_pairs(spark, path, "snippets")) == [(500, "a"), (501, "b"), (502, "c")]


@pytest.mark.parametrize("fraction", [0.0004, 1.5, -0.1])
def test_odd_fractions_are_errors(spark, fraction):
    with pytest.raises(ValueError, match="thousandths"):
        split.split_fraction(spark.range(3).withColumnRenamed("id", "pair_id"), fraction)


def test_a_label_without_logit_is_an_error(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (7, [0.0, 0.0])], "label int, z array<double>")
    with pytest.raises(Exception, match="label 7 has no logit"):
        metrics.evaluate(metrics.score_logits(rows, "label", "z"), "label").collect()


def test_reports_end_at_the_early_stop(spark, rows):
    losses = [3.0, 0.3, 2.0, 2.0, 2.0, 2.0, 0.4, 0.01]
    df = spark.createDataFrame(
        [("a", k + 1, 1.0, x, 0.5, 0.5) for k, x in enumerate(losses)], stages.HISTORY_SCHEMA
    )
    assert rows(history.performance_tier(df)) == [("a", 0.4, "good")]
    assert max(r["epoch"] for r in history.loss_series(df).collect()) == 7


def test_equal_keys_stay_two_rows(spark, rows):
    texts = spark.createDataFrame([(1, "a b", "x"), (1, "c", "y"), (2, None, None), (3, "", "zz a")], "pair_id long, title string, code string")
    words = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", 7, 1), ("x", 8, 1)], "token string, id int, n long")
    ids = encode.encode_ids(texts, words, {"title": 10, "code": 10})
    assert rows(ids) == sorted([(1, [5, 6], [8]), (1, [7], [3]), (2, [], []), (3, [], [3, 5])], key=repr)
    back = encode.decode_text(ids, words, "pair_id", "title")
    assert rows(back) == sorted([(1, "a b"), (1, "c"), (2, ""), (3, "")], key=repr)


def test_encoding_and_decoding_are_narrow(spark):
    texts = spark.range(4).select(F.col("id").alias("pair_id"), F.lit("a b").alias("title"))
    words = spark.createDataFrame([("a", 5, 1)], "token string, id int, n long")
    ids = encode.encode_ids(texts, words, {"title": 10})
    plan = encode.decode_text(ids, words, "pair_id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_large_vocabulary_is_not_sent(spark, monkeypatch):
    monkeypatch.setattr(encode, "VOCABULARY_BOUND", 1)
    words = spark.createDataFrame([("a", 5, 1), ("b", 6, 1)], "token string, id int, n long")
    with pytest.raises(ValueError, match="at most"):
        encode.encode_ids(spark.createDataFrame([(1, "a")], "pair_id long, title string"), words, {"title": 10})


def test_vector_ids_may_have_gaps(spark):
    table = spark.createDataFrame([(10, [1.0, 2.0]), (20, [3.0, 4.0])], "vec_id long, embedding array<float>")
    words = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("c", 7, 1)], "token string, id int, n long")
    got = {r["id"]: r["vector"] for r in vectors.vocabulary_vectors(words, table).collect()}
    assert got == {5: [3.0, 4.0], 6: [1.0, 2.0], 7: [3.0, 4.0]}


def test_attention_gives_every_query_position(spark):
    table = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "id int, vector array<double>")
    rows = spark.createDataFrame([(1, [5, 6, 0], [6, 5, 5]), (2, [0, 0], [5])], "pair_id long, q array<int>, k array<int>")
    got = {(r["pair_id"], r["pos"]): r["vector"] for r in vectors.attend(rows, table, "pair_id", "q", "k").collect()}
    q, k = np.eye(2), np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    want = vectors.softmax_average(q, k, False)
    assert set(got) == {(1, 0), (1, 1)}
    assert np.allclose([got[1, 0], got[1, 1]], want)


def test_stages_follow_their_parameters(spark):
    pairs = spark.createDataFrame([(k, f"t{k}", f"word{k % 5} and more words") for k in range(60)], "pair_id long, title string, code string")
    folder = new_folder(spark, "stale")
    assert training.prepare(pairs, folder, length=8).encoded.first()["input_ids"].__len__() == 8
    assert training.prepare(pairs, folder, length=16).encoded.first()["input_ids"].__len__() == 16
    fewer = pairs.filter("pair_id < 30")
    again = training.prepare(fewer, folder, length=16)
    assert again.pairs.count() == 30 and again.encoded.count() == 30


def test_merges_come_back(spark, rows):
    texts = spark.createDataFrame([(1, "low lower lowest")], "pair_id long, code string")
    merges = bpe.learn_merges(texts, "code", 4)
    path = new_folder(spark, "merges")
    stages.write_table(merges, path)
    loaded = stages.load_merges(spark, path)
    assert rows(loaded) == rows(merges)
    assert rows(bpe.encode_subwords(texts, loaded, "code", "pair_id", 50)) == rows(bpe.encode_subwords(texts, merges, "code", "pair_id", 50))


def test_subwords_are_cut(spark):
    texts = spark.createDataFrame([(1, "abc def ghi"), (2, None), (3, "a")], "pair_id long, code string")
    merges = spark.createDataFrame([], bpe.MERGE_SCHEMA)
    got = {r["pair_id"]: r["ids"] for r in bpe.encode_subwords(texts, merges, "code", "pair_id", 6).collect()}
    assert [len(got[k]) for k in (1, 2, 3)] == [4, 0, 1]


def test_frequent_words_at_a_tie(spark, rows):
    text = "a a a b b c c d d e"
    df = spark.createDataFrame([(1, text)], "pair_id long, code string")
    assert [r[0] for r in vocabulary.learn_words(df, "code", 3).orderBy("id").collect()] == ["a", "b", "c"]
    assert vocabulary.learn_words(df, "code", 50).count() == 5
    assert vocabulary.learn_words(df.limit(0), "code", 50).count() == 0


def test_ranks_of_clustered_ids(spark):
    ids = [*range(1000), *range(10**12, 10**12 + 50), -(10**15)]
    df = spark.createDataFrame([(i,) for i in ids], "pair_id long").repartition(5)
    bounds = ranking.quantile_bounds(df, "pair_id", rows_per_bucket=40, cells=64)
    assert len(bounds) > 10
    got = {r["pair_id"]: r["rank"] for r in ranking.rank_by_id(df, "pair_id", bounds).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_joins_on_the_buckets_move_one_side(spark):
    model = laid_out(spark.range(100).select(F.col("id").alias("s"), (F.col("id") * 2).alias("w"), F.lit(0.5).alias("t")), "model", "s", "w")
    asked = spark.range(10).select(F.col("id").alias("s"), F.col("id").alias("w"))
    joined = asked.hint("shuffle_hash").join(model, ["s", "w"], "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert joined.where("t IS NOT NULL").count() == 1


def test_scratch_folders_go(spark):
    with scratch(spark, "batch") as folder:
        stage(spark.range(3).toDF("id"), "inner")
        assert stages.stage_done(spark, spark.read.parquet(folder + "/*").inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(Exception):
        spark.read.parquet(folder + "/*")
    path = new_folder(spark, "gone")
    spark.range(1).write.parquet(path)
    remove(spark, path)
    assert not stages.stage_done(spark, path)


def test_a_stream_that_goes_on(spark, tmp_path):
    folder = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0, "user", "Hi THERE")], TURNS).write.parquet(folder)
    words = spark.createDataFrame([("hi", 5, 1)], "token string, id int, n long")
    out, progress = new_folder(spark, "out"), new_folder(spark, "progress")
    query = live.stream_prompts(live.read_turns(spark, folder), words, out, progress, processingTime="1 second")
    try:
        query.processAllAvailable()
        spark.createDataFrame([(2, 0, "user", "hi")], TURNS).write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert query.isActive
        got = {r["prompt_id"]: r["input_ids"][:4] for r in spark.read.parquet(out).collect()}
        assert got == {1000: [1, 5, 3, 2], 2000: [1, 5, 2, 0]}
    finally:
        query.stop()


def test_long_batches_are_worked_on_in_slices(monkeypatch):
    """The memory of a subword task follows the slice, not the Arrow batch that it comes in; the results are those of whole batches."""
    rows = [["ab", "abc"] * 40, [], None, ["abc"] * 500, ["x"]] * 20
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(rows))), "words": pa.array(rows, pa.list_(pa.string()))})
    shared = type("Shared", (), {"value": ({("61", "62"): (0, "6162")}, {"6162": 9, "61": 1, "62": 2, "63": 3, "78": 4})})
    whole = pa.Table.from_batches(list(bpe._to_subwords([batch], shared, "k", 1000))).to_pylist()
    monkeypatch.setattr(encode, "PIECES", 600)
    parts = list(bpe._to_subwords([batch], shared, "k", 1000))
    assert pa.Table.from_batches(parts).to_pylist() == whole
    assert len(parts) > 10 and all(p.num_rows == 1 or pc.sum(pc.list_value_length(p.column("ids"))).as_py() <= 2 * 600 for p in parts)
    assert whole[0]["ids"] == [9, 9, 3] * 40 and whole[1]["ids"] == [] and whole[3]["ids"] == [9, 3] * 500


def test_averages_are_handed_back_in_parts(spark, monkeypatch):
    """Averaged vectors leave a task in Arrow batches of bounded size, whatever the sequences of a batch."""
    monkeypatch.setattr(vectors, "AVERAGES", 3)
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 5)], "id int, vector array<double>")
    rows = spark.createDataFrame([(1, [1, 2, 0], [3, 4]), (2, [], [1]), (3, [4, 0, 4, 1], [2]), (4, None, [1]), (5, [2], [0])], "pair_id long, q array<int>, k array<int>").coalesce(1)
    out = vectors.attend(rows, table, "pair_id", "q", "k")
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = {(r["pair_id"], r["pos"]): r["vector"] for r in out.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (3, 0), (3, 2), (3, 3)]
    assert got[3, 0] == got[3, 3] == [2.0, 1.0]


def test_quick_rounding_is_that_of_the_digits(spark):
    """Both forms of rounding give what F.round gives, at halves and their neighbours, for huge, tiny, signed and missing values."""
    halves = [s * (k + 0.5) / 1e6 for k in (0, 1, 2, 7, 12345, 999_999, 123_456_789_012) for s in (1, -1)]
    near = [float(np.nextafter(x, x + d)) for x in halves for d in (1, -1)]
    values = halves + near + [0.0, -0.0, -1e-9, 1e-300, 1e300, 0.1, 1.0000005, 2.675, math.pi * 1e5, float("inf"), float("-inf"), float("nan")]
    values += np.random.default_rng(1).normal(size=300).tolist()
    rows = spark.createDataFrame([(x,) for x in [*values, None]], "x double").select("x", F.round("x", 6).alias("want"), scoring.rounded(F.col("x")).alias("got")).collect()
    assert all(r["want"] == r["got"] or r["want"] != r["want"] and r["got"] != r["got"] or r["want"] is r["got"] is None for r in rows)
    want = np.array([r["want"] for r in rows if r["x"] is not None])
    assert np.array_equal(vectors.rounded(np.array([values]), 6)[0], want, equal_nan=True)
