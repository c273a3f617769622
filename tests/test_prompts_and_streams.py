import pytest
from pyspark.sql import functions as F

from pairloom.functions.text import normalize_prompt, prompt_route
from pairloom.operators import vocabulary
from pairloom.plans import training
from pairloom.streaming import metrics as live_metrics
from pairloom.streaming import prompts as live
from pairloom.workspace import new_folder

TURNS = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} says {t}, again.") for c in range(12) for t in range(4)]


@pytest.mark.parametrize(
    "text,expected",
    [("\n  ABC\t", "abc"), (" x y \x1f", "x y"), (" " * 510 + "ab" + "c", "ab"), ("x" * 600, "x" * 512), ("", "")],
)
def test_normalize(spark, text, expected):
    got = spark.range(1).select(normalize_prompt(F.lit(text)).alias("x")).first()["x"]
    assert got == expected == text.lower()[:512].strip()


def test_routes(spark):
    routes = {":s": "samples", ":TS": "temperature_samples", ":q": "quit", ":a": "architecture", ":p": "parameters"}
    routes |= {":ls": "rejected", ":": "rejected", "hello": "prompt", " :s": "prompt", "": "prompt"}
    df = spark.createDataFrame([(t,) for t in routes], "text string")
    assert {r["text"]: r["route"] for r in df.withColumn("route", prompt_route(F.col("text"))).collect()} == routes


@pytest.fixture
def turns(spark):
    folder = new_folder(spark, "test-turns")
    df = spark.createDataFrame(TURNS, live.TURNS_SCHEMA)
    df.filter("conv_id < 6").write.parquet(folder)
    df.filter("conv_id >= 6").write.mode("append").parquet(folder)
    return folder


def test_prompt_stream_equals_batch(spark, turns, rows):
    texts = spark.read.parquet(turns)
    words = vocabulary.learn_words(texts, "text")
    out, progress = new_folder(spark, "test-out"), new_folder(spark, "test-progress")
    for _ in range(2):  # a second start finds nothing new and repeats nothing
        stream = live.read_turns(spark, turns, files_per_batch=1)
        live.stream_prompts(stream, words, out, progress, limit=10).awaitTermination()
    batch = live.encode_prompts(live.prompt_columns(live.prompts_from_turns(texts)), words, 10)
    streamed = spark.read.parquet(out)
    assert streamed.select("batch_id").distinct().count() > 1
    assert rows(streamed.select(batch.columns)) == rows(batch)


def test_replayed_batch_replaces_itself(spark, turns):
    out = new_folder(spark, "test-replay")
    for progress in (new_folder(spark, "p1"), new_folder(spark, "p2")):  # lost progress: everything is replayed
        stream = live.prompts_from_turns(live.read_turns(spark, turns))
        live.write_batches(stream, out, progress, lambda batch: batch).awaitTermination()
    assert spark.read.parquet(out).count() == 24


def test_answers(spark, turns):
    from pairloom.sources.pairs import pairs_from_turns

    corpus = training.prepare(pairs_from_turns(spark.read.parquet(turns)), length=16)
    model = training.fit(corpus, 1).model()
    out = new_folder(spark, "test-answers")
    stream = live.read_turns(spark, turns)
    live.stream_answers(stream, corpus.vocabulary, model, out, new_folder(spark, "p3"), 6).awaitTermination()
    answers = spark.read.parquet(out).collect()
    assert len(answers) == 24 and all(r["text"].startswith("text") for r in answers)


def test_running_metrics_end_at_the_batch_result(spark):
    folder, out = new_folder(spark, "test-logits"), new_folder(spark, "test-live")
    df = spark.range(200).selectExpr(
        "id as vec_id", "array(float(id % 7), float(id % 5), float(1)) as embedding", "cast(id % 3 as int) as label"
    )
    df.repartition(4).write.parquet(folder)
    stream = live_metrics.read_logits(spark, folder, files_per_batch=1).withColumn("epoch", F.expr("vec_id div 100"))
    live_metrics.stream_metrics(stream, out, new_folder(spark, "p4")).awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4
    from pairloom.operators.metrics import evaluate, score_logits

    whole = evaluate(score_logits(df, "label", "embedding").withColumn("epoch", F.expr("vec_id div 100")), "label", ("epoch",))
    expected = {r["epoch"]: tuple(r)[1:] for r in whole.collect()}
    got = {r["epoch"]: tuple(r)[1:] for r in live_metrics.latest(spark, out).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_the_query_answers_at_full_length(spark, monkeypatch, rows):
    """Answers may be as long as a prompt, not a few tokens; the steps themselves are compared with the SQL."""
    from pairloom.plans.queries import QUERIES

    folder, asked = new_folder(spark, "test-full"), []
    spark.createDataFrame(TURNS, live.TURNS_SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    greedy = live.decode_greedy
    monkeypatch.setattr(live, "decode_greedy", lambda sources, model, length=100, **options: asked.append(length) or greedy(sources, model, 1, **options))
    assert len(rows(QUERIES["stream_answers"](spark, folder))) == 24
    assert set(asked) == {live.PROMPT_LENGTH} == {100}
