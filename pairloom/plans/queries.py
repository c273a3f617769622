"""One query per operator, over the whole given tables. Id arrays are shown as text, floats with six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import scoring
from pairloom.functions import sequences as S
from pairloom.functions import text as T
from pairloom.operators import align, batches, bpe, decode, encode, history, metrics, ngram, split, vectors, vocabulary
from pairloom.plans import training
from pairloom.settings import ANSWER_LENGTH, COMPARED_LENGTH, EPOCHS, MERGES, PROMPT_LENGTH, SEQUENCE_LENGTH, TEMPERATURE, TRAIN_BATCH
from pairloom.sources import pairs as P
from pairloom.sources import stages
from pairloom.streaming import metrics as live_metrics
from pairloom.streaming import prompts as live
from pairloom.workspace import new_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}



def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def shown(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def long(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def six(column: str) -> Column:
    return scoring.rounded(F.col(column)).alias(column)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return P.read_table(spark, f"{sf}/{name}.parquet")


def document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.pairs_from_documents(table(spark, sf, "documents"))


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_fraction(document_pairs(spark, sf))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.pairs_from_turns(table(spark, sf, "conversations"))


def only(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.filter(F.col("split") == name)


def learned(pairs: DataFrame) -> DataFrame:
    return vocabulary.learn_words(only(pairs, "train"))


def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    pairs = split_documents(spark, sf)
    return encode.encode_pairs(pairs, learned(pairs))


def document_ids(spark: SparkSession, sf: str, limit: int = SEQUENCE_LENGTH) -> DataFrame:
    """Ids of both columns, cut but without marks."""
    pairs = split_documents(spark, sf)
    return encode.encode_ids(pairs, learned(pairs), {"title": limit, "code": limit}, keep=("split",))


# --- sources, sinks, stages -------------------------------------------------------------------------------------


@query
def pairs_scan(spark, sf):
    return P.read_pairs(spark, f"{sf}/conversations.parquet")


@query
def pairs_select(spark, sf):
    return P.select_pairs(table(spark, sf, "documents"), source="lang", target="text", key="doc_id")


@query
def pairs_from_turns(spark, sf):
    return turn_pairs(spark, sf)


@query
def pairs_from_documents(spark, sf):
    return document_pairs(spark, sf)


@query
def drop_columns(spark, sf):
    return P.drop_columns(table(spark, sf, "documents"), ["source", "n_chars"])


@query
def named_splits(spark, sf):
    return split.split_disabled(document_pairs(spark, sf))


@query
def cleaned_write(spark, sf):
    path = new_folder(spark, "cleaned")
    stages.write_cleaned(split_documents(spark, sf), path)
    return stages.load_cleaned(spark, path).select("pair_id", "split", "title", "code")


@query
def cleaned_load_test(spark, sf):
    path = new_folder(spark, "cleaned")
    stages.write_cleaned(split_documents(spark, sf), path)
    return only(stages.load_cleaned(spark, path), "test").select("pair_id", "title")


@query
def stage_reuse(spark, sf):
    path, built = new_folder(spark, "reused"), []

    def build():
        built.append(1)
        return split_documents(spark, sf)

    for force in (False, False, True):
        pairs = stages.build_or_load(spark, path, build, force)
    return split.split_counts(pairs).withColumn("builds", F.lit(len(built)).cast("bigint"))


@query
def history_roundtrip(spark, sf):
    path = new_folder(spark, "history")
    for per_type in (True, False):
        stages.append_history(history.history_from_events(table(spark, sf, "events"), per_type), path)
    loaded = stages.load_history(spark, path)
    return loaded.withColumn("epoch", long("epoch"))


@query
def vocab_roundtrip(spark, sf):
    path = new_folder(spark, "vocabulary")
    stages.write_table(learned(split_documents(spark, sf)), path)
    return stages.load_vocabulary(spark, path).select("token", long("id"), "n")


# --- splits and steps -------------------------------------------------------------------------------------------


@query
def split_counts(spark, sf):
    return split.split_counts(split_documents(spark, sf))


@query
def split_fraction(spark, sf):
    return split_documents(spark, sf).select("pair_id", "split")


@query
def split_exact(spark, sf):
    return split.split_exact(document_pairs(spark, sf)).select("pair_id", "split")


@query
def split_tail(spark, sf):
    return split.split_tail(document_pairs(spark, sf)).select("pair_id", "split")


@query
def split_disabled(spark, sf):
    return split.steps_per_epoch(split.split_disabled(document_pairs(spark, sf)))


@query
def steps_per_epoch(spark, sf):
    return split.steps_per_epoch(split_documents(spark, sf))


@query
def steps_before_split(spark, sf):
    return split.steps_per_epoch(split_documents(spark, sf), count="before_split")


# --- vocabulary, encoding, decoding -----------------------------------------------------------------------------


@query
def corpus_chunks(spark, sf):
    return vocabulary.corpus_chunks(split_documents(spark, sf))


@query
def vocab_words(spark, sf):
    return learned(split_documents(spark, sf)).select("token", long("id"), "n")


@query
def vocab_size(spark, sf):
    return vocabulary.full_vocabulary(learned(split_documents(spark, sf))).agg(F.count(F.lit(1)).alias("size"))


@query
def special_tokens(spark, sf):
    """The reserved tokens and how often encoded inputs and outputs hold each."""
    ids = encoded_documents(spark, sf).select(F.explode(F.concat("input_ids", "targ_in")).alias("id"))
    used = ids.groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    reserved = vocabulary.special_tokens(spark)
    flags = ["lstrip", "normalized", "rstrip", "single_word", "special"]
    return reserved.join(used, "id", "left").select(
        long("id"), "token", *[F.col(f).cast("bigint").alias(f) for f in flags], "roles",
        F.coalesce("uses", F.lit(0)).alias("uses"),
    )


def _merges(spark, sf) -> DataFrame:
    return bpe.learn_merges(only(split.split_fraction(turn_pairs(spark, sf)), "train"), "code", MERGES)


@query
def bpe_merges(spark, sf):
    return _merges(spark, sf).select(long("place"), "left", "right", "n")


@query
def encode_bpe(spark, sf):
    pairs = turn_pairs(spark, sf)
    path = new_folder(spark, "merges")
    stages.write_table(_merges(spark, sf), path)
    merges = stages.load_merges(spark, path)
    ids = bpe.encode_subwords(pairs, merges, "code", "pair_id", SEQUENCE_LENGTH)
    return ids.select("pair_id", shown(S.frame(F.col("ids"), SEQUENCE_LENGTH)).alias("ids"))


@query
def decode_bpe(spark, sf):
    """Subword ids of whole texts, how many there are, and the texts that they decode to."""
    pairs = turn_pairs(spark, sf)
    merges = stage(_merges(spark, sf), "merges")
    ids = stage(bpe.encode_subwords(pairs, merges, "code", "pair_id", 1 << 30), "subwords")
    sizes = ids.select("pair_id", F.size("ids").cast("bigint").alias("pieces"))
    return bpe.decode_subwords(ids, merges, "pair_id", "ids").join(sizes, "pair_id")


@query
def encode_ids(spark, sf):
    ids = document_ids(spark, sf)
    return ids.select("pair_id", shown(F.col("title")).alias("title"), shown(F.col("code")).alias("code"))


def _both(ids: DataFrame, made) -> DataFrame:
    return ids.select("pair_id", *[shown(made(F.col(c))).alias(c) for c in ("title", "code")])


@query
def add_bos_eos(spark, sf):
    return _both(document_ids(spark, sf), S.add_marks)


@query
def truncate_ids(spark, sf):
    """Both columns cut for the model, and the outputs cut for a prompt."""
    ids = document_ids(spark, sf)
    short = S.truncate(F.col("code"), PROMPT_LENGTH)
    kept = [F.size(c).cast("bigint").alias(f"{c}_kept") for c in ("title", "code")]
    return ids.select("pair_id", *kept, shown(F.col("title")).alias("title"), shown(F.col("code")).alias("code"), shown(short).alias("short"))


@query
def pad_ids(spark, sf):
    return _both(document_ids(spark, sf), lambda c: S.frame(c, SEQUENCE_LENGTH))


@query
def pad_mask(spark, sf):
    return _both(document_ids(spark, sf), lambda c: S.pad_mask(S.frame(c, SEQUENCE_LENGTH)).cast("array<int>"))


@query
def teacher_forcing(spark, sf):
    arrays = [shown(F.col(c)).alias(c) for c in ("input_ids", "targ_in", "targ_out")]
    return encoded_documents(spark, sf).select("pair_id", "split", *arrays)


@query
def features(spark, sf):
    rows = encoded_documents(spark, sf).select("pair_id", F.inline(F.array(S.features())))
    return rows.select(
        "pair_id",
        shown(F.col("features.input_ids")).alias("input_ids"),
        shown(F.col("features.targ_in")).alias("targ_in"),
        shown(F.col("targ_out")).alias("targ_out"),
    )


@query
def cast_format(spark, sf):
    """The decoding form: prompts of 100 ids as 64-bit numbers."""
    ids = document_ids(spark, sf, PROMPT_LENGTH)
    return _both(ids, lambda c: S.frame(c, PROMPT_LENGTH).cast("array<bigint>"))


@query
def decode_text(spark, sf):
    pairs = split_documents(spark, sf)
    words = stage(vocabulary.full_vocabulary(learned(pairs)), "vocabulary")
    return encode.decode_text(encode.encode_pairs(pairs, words), words, "pair_id", "targ_out")


# --- epochs and batches -----------------------------------------------------------------------------------------


@query
def epoch_shuffle(spark, sf):
    order = batches.epoch_shuffle(only(split_documents(spark, sf), "train"))
    return order.select(long("epoch"), "pair_id", "rank")


@query
def epoch_repeat(spark, sf):
    rows = batches.epoch_repeat(only(split_documents(spark, sf), "train").select("pair_id"))
    return rows.select(long("epoch"), "pair_id")


def _layout(df: DataFrame) -> DataFrame:
    return df.select(long("epoch"), "batch_id", long("slot"), "pair_id")


@query
def train_batches(spark, sf):
    return _layout(batches.train_batches(only(split_documents(spark, sf), "train")))


@query
def train_batches_per_epoch(spark, sf):
    return _layout(batches.train_batches(only(split_documents(spark, sf), "train"), span_epochs=False))


@query
def val_batches(spark, sf):
    return _layout(batches.validation_batches(only(split_documents(spark, sf), "test")))


def _limited(spark, sf) -> DataFrame:
    pairs = split_documents(spark, sf)
    steps = split.steps_per_epoch(pairs).first()["train_steps"]
    return batches.limit_steps(batches.train_batches(only(pairs, "train")), steps)


@query
def steps_limit(spark, sf):
    return _limited(spark, sf).select(long("epoch"), "batch_id", long("slot"), "pair_id", "fit_epoch")


@query
def batch_export(spark, sf):
    path = new_folder(spark, "batches")
    batches.export_batches(_limited(spark, sf), encoded_documents(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.select("batch_id", long("slot"), "pair_id", *[shown(F.col(c)).alias(c) for c in ("input_ids", "targ_out")])


# --- metrics, schedule, history ---------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return metrics.score_logits(table(spark, sf, "embeddings"), "label", "embedding")


@query
def argmax_class(spark, sf):
    return _scored(spark, sf).select("vec_id", long("predicted"))


@query
def masked_loss(spark, sf):
    return metrics.evaluate(_scored(spark, sf), "label").select(six("loss"))


@query
def masked_loss_by_batch(spark, sf):
    rows = _scored(spark, sf).withColumn("batch_id", F.expr(f"vec_id div {TRAIN_BATCH}"))
    return metrics.evaluate(rows, "label", by=("batch_id",)).select("batch_id", six("loss"))


@query
def masked_accuracy(spark, sf):
    return metrics.evaluate(_scored(spark, sf), "label").select(six("accuracy"))


@query
def masked_accuracy_strict(spark, sf):
    return metrics.evaluate(_scored(spark, sf), "label").select(six("accuracy_strict"))


@query
def lr_schedule(spark, sf):
    """The rate when event numbers are taken as training steps."""
    rate = scoring.learning_rate(F.col("event_id"))
    return table(spark, sf, "events").select("event_id", F.round(rate, 6).alias("learning_rate"))


@query
def lr_fixed(spark, sf):
    return metrics.lr_by_batch(_limited(spark, sf), lambda s: scoring.learning_rate(s, fixed=True))


@query
def lr_by_batch(spark, sf):
    return metrics.lr_by_batch(_limited(spark, sf), scoring.learning_rate)


def _runs(spark, sf) -> DataFrame:
    return history.history_from_events(table(spark, sf, "events"))


@query
def best_epochs(spark, sf):
    return history.best_epochs(_runs(spark, sf)).select("run_id", long("epoch"), "val_loss")


@query
def early_stop(spark, sf):
    return history.early_stop(_runs(spark, sf)).select("run_id", long("best_epoch"), long("stopped_epoch"))


@query
def loss_series(spark, sf):
    return history.loss_series(_runs(spark, sf)).select("run_id", long("epoch"), "series", "value")


@query
def performance_tier(spark, sf):
    """Tiers of the runs, each with its losses scaled by 50, 150 and 400, so that all tiers occur."""
    scale = F.explode(F.array(*[F.lit(x) for x in (50, 150, 400)]))
    runs = _runs(spark, sf).withColumn("scale", scale).withColumn("run_id", F.concat_ws("/", "run_id", "scale"))
    return history.performance_tier(runs.withColumn("val_loss", F.round(F.col("val_loss") / F.col("scale"), 6)))


@query
def run_summary(spark, sf):
    steps = split.steps_per_epoch(split_documents(spark, sf)).first()["train_steps"]
    summary = history.run_summary(_runs(spark, sf), steps)
    return summary.select(
        "run_id", long("last_epoch"), long("stopped_epoch"), "val_loss", "val_masked_accuracy", "final_rate"
    )


# --- learning, scoring, decoding --------------------------------------------------------------------------------


def _corpus(spark, sf) -> training.Corpus:
    return training.prepare(turn_pairs(spark, sf))


def _train(corpus: training.Corpus) -> DataFrame:
    return only(corpus.encoded, "train")


def _prompts(corpus: training.Corpus, spark, sf) -> DataFrame:
    cleaned = live.prompt_columns(P.prompts_from_turns(table(spark, sf, "conversations")))
    return stage(live.encode_prompts(cleaned, corpus.vocabulary), "prompts")


@query
def ngram_counts(spark, sf):
    counts = ngram.ngram_counts(_train(_corpus(spark, sf)))
    return counts.select(*[long(c) for c in ("n_order", "c2", "c1", "w", "n")])


@query
def ngram_model(spark, sf):
    corpus = _corpus(spark, sf)
    rows = ngram.ngram_table(ngram.fit_ngrams(_train(corpus), corpus.vocabulary))
    return rows.select(*[long(c) for c in ("n_order", "c2", "c1", "w")], six("p"))


@query
def align_em(spark, sf):
    model = align.fit_alignment(_train(_corpus(spark, sf)), EPOCHS)[-1]
    return model.select(long("s"), long("w"), six("t"))


@query
def align_weights(spark, sf):
    train = _train(_corpus(spark, sf))
    model = align.fit_alignment(train, 1)[-1]
    weights = align.align_weights(train, model)
    return weights.select("pair_id", long("s"), long("w"), six("weight"))


@query
def next_token_dist(spark, sf):
    """The distribution of the first answer token of every test pair."""
    corpus = _corpus(spark, sf)
    model = training.fit(corpus).model()
    states = only(corpus.encoded, "test").select(
        F.col("pair_id").alias("key"), F.lit(ngram.NONE).alias("c2"), F.get("targ_in", F.lit(0)).alias("c1"), "input_ids"
    )
    dist = decode.next_token_dist(states, model)
    return dist.select(F.col("key").alias("pair_id"), long("w"), six("p"))


@query
def model_validation(spark, sf):
    corpus = _corpus(spark, sf)
    fitted = training.fit(corpus)
    test = only(corpus.encoded, "test")
    rows = None
    for epoch in range(1, EPOCHS + 1):
        row = training.validate(test, fitted.model(after=epoch)).withColumn("epoch", F.lit(epoch).cast("bigint"))
        rows = row if rows is None else rows.unionByName(row)
    names = ("val_loss", "val_masked_accuracy", "val_masked_accuracy_strict")
    return rows.select("epoch", *[six(c) for c in names])


@query
def decode_greedy(spark, sf):
    corpus = _corpus(spark, sf)
    answers = decode.decode_greedy(_prompts(corpus, spark, sf), training.fit(corpus).model(), ANSWER_LENGTH)
    return encode.decode_text(answers, corpus.vocabulary, "prompt_id", "ids")


@query
def decode_greedy_fixed(spark, sf):
    corpus = _corpus(spark, sf)
    answers = decode.decode_greedy(
        _prompts(corpus, spark, sf), training.fit(corpus).model(), ANSWER_LENGTH, stop_at_end=False
    )
    return encode.decode_text(answers, corpus.vocabulary, "prompt_id", "ids")


@query
def decode_sample(spark, sf):
    corpus = _corpus(spark, sf)
    answers = decode.decode_sample(_prompts(corpus, spark, sf), training.fit(corpus).model(), TEMPERATURE, COMPARED_LENGTH)
    return encode.decode_text(answers, corpus.vocabulary, "prompt_id", "ids")


@query
def decoder_compare(spark, sf):
    corpus = _corpus(spark, sf)
    model, sources = training.fit(corpus).model(), _prompts(corpus, spark, sf)
    prompts = decode.prepare_prompts(sources, model)
    outputs = {
        "plain": decode.decode_greedy(sources, model, COMPARED_LENGTH, prompts=prompts),
        "sampled": decode.decode_sample(sources, model, TEMPERATURE, COMPARED_LENGTH),
        "greedy": decode.decode_greedy(sources, model, COMPARED_LENGTH, stop_at_end=False, prompts=prompts),
    }
    texts = {name: encode.decode_text(df, corpus.vocabulary, "prompt_id", "ids") for name, df in outputs.items()}
    return decode.decoder_compare(texts)


@query
def prompt_normalize(spark, sf):
    prompts = P.prompts_from_turns(table(spark, sf, "conversations"))
    return prompts.select("prompt_id", T.normalize_prompt(F.col("text")).alias("text"))


@query
def prompt_route(spark, sf):
    """Routes of all turns as they are and behind a colon, and of single letters behind a colon."""
    turns = table(spark, sf, "conversations").select("text", F.col("turn"))
    letters = F.get(F.array(*[F.lit(x) for x in (":s", ":ts", ":q", ":A", ":p", ":ls", " :s")]), F.col("turn").cast("int"))
    asked = turns.select("turn", F.explode(F.array("text", F.concat(F.lit(":"), "text"), letters)).alias("text"))
    asked = asked.filter(F.col("text").isNotNull())
    return asked.groupBy("turn", T.prompt_route(F.col("text")).alias("route")).agg(F.count(F.lit(1)).alias("prompts"))


def _vector_table(corpus: training.Corpus, spark, sf) -> DataFrame:
    return stage(vectors.vocabulary_vectors(corpus.vocabulary, table(spark, sf, "embeddings")), "vectors")


def _by_dimension(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", F.posexplode("vector").alias("dim", "value")).select(
        "pair_id", long("dim"), six("value")
    )


WIDTH = 64  # of the given vectors


@query
def embed_tokens(spark, sf):
    corpus = _corpus(spark, sf)
    rows = vectors.embed_tokens(corpus.encoded, _vector_table(corpus, spark, sf), "pair_id", "input_ids", WIDTH)
    return _by_dimension(rows)


@query
def positional_table(spark, sf):
    """The position signal, summed over the unmasked positions of each pair's input."""
    corpus = _corpus(spark, sf)
    taken = corpus.encoded.select("pair_id", F.posexplode("input_ids").alias("pos", "id")).filter(F.col("id") != 0)
    placed = taken.join(F.broadcast(vectors.positional_table(spark, WIDTH)), "pos")
    return placed.groupBy("pos").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.round(F.sum(F.get("signal", F.lit(i))), 6).alias(f"d{i}") for i in range(WIDTH)],
    ).withColumn("pos", long("pos"))


def _attend(spark, sf, queries: str, keys: str, causal: bool = False) -> DataFrame:
    corpus = _corpus(spark, sf)
    table_ = _vector_table(corpus, spark, sf)
    rows = vectors.attend(corpus.encoded, table_, "pair_id", queries, keys, causal, places=6)
    return rows.select("pair_id", long("pos"), *[F.get("vector", F.lit(i)).alias(f"d{i}") for i in range(WIDTH)])


@query
def attend_cross(spark, sf):
    return _attend(spark, sf, "targ_in", "input_ids")


@query
def attend_self(spark, sf):
    return _attend(spark, sf, "input_ids", "input_ids")


@query
def attend_causal(spark, sf):
    return _attend(spark, sf, "targ_in", "targ_in", causal=True)


# --- streams ----------------------------------------------------------------------------------------------------


@query
def stream_prompts(spark, sf):
    corpus = _corpus(spark, sf)
    folder = new_folder(spark, "streamed")
    turns = live.read_turns(spark, f"{sf}/conversations*.parquet")
    live.stream_prompts(turns, corpus.vocabulary, folder, new_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(folder).select("prompt_id", "route", shown(F.col("input_ids")).alias("ids"))


@query
def stream_answers(spark, sf):
    corpus = _corpus(spark, sf)
    folder = new_folder(spark, "answers")
    turns = live.read_turns(spark, f"{sf}/conversations*.parquet")
    model = training.fit(corpus).model()
    progress = new_folder(spark, "progress")
    live.stream_answers(turns, corpus.vocabulary, model, folder, progress).awaitTermination()
    return spark.read.parquet(folder).select("prompt_id", "text")


@query
def stream_metrics(spark, sf):
    folder = new_folder(spark, "live")
    rows = live_metrics.read_logits(spark, f"{sf}/embeddings*.parquet")
    rows = rows.withColumn("epoch", F.expr(f"vec_id div {TRAIN_BATCH * 8}"))
    live_metrics.stream_metrics(rows, folder, new_folder(spark, "progress")).awaitTermination()
    values = ("loss", "accuracy", "accuracy_strict")
    return live_metrics.latest(spark, folder).select("epoch", *[six(c) for c in values])
