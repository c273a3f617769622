"""The whole way from a pair table to a fitted, validated model, stage by stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.align import fit_alignment, target_scores
from pairloom.operators.decode import PairModel, best_of_all, pair_model, truth_probability
from pairloom.operators.encode import encode_pairs
from pairloom.operators.metrics import masked_accuracy, masked_loss
from pairloom.operators.ngram import NgramModel, fit_ngrams, positions
from pairloom.operators.split import split_fraction
from pairloom.operators.vocabulary import full_vocabulary, learn_words
from pairloom.settings import EPOCHS, SEQUENCE_LENGTH
from pairloom.sources.stages import append_history, build_or_load, fingerprint, is_current, load_vocabulary, note_parameters, write_table
from pairloom.workspace import new_folder, stage


@dataclass
class Corpus:
    """Split pairs, their vocabulary (learned and reserved entries) and the encoded rows."""

    pairs: DataFrame
    vocabulary: DataFrame
    encoded: DataFrame


def prepare(
    pairs: DataFrame,
    folder: str | None = None,
    split=split_fraction,
    length: int = SEQUENCE_LENGTH,
    force: bool = False,
) -> Corpus:
    """Split, learn the vocabulary from the training outputs, encode.

    Finished stages under ``folder`` are used again while the rows of the pairs, the split and the length are the same; a
    stage that is built anew has all that follow it built anew. Rows are compared by a fingerprint, which reads them
    once, so files rewritten at the same path are noticed and the same rows under another path are not built again.
    """
    spark = pairs.sparkSession
    rows = fingerprint(pairs) if folder else None
    folder = folder or new_folder(spark, "corpus")
    inputs = {"pairs": rows, "split": getattr(split, "__name__", repr(split))}
    rebuild = force or not is_current(spark, f"{folder}/cleaned", inputs)
    cleaned = build_or_load(spark, f"{folder}/cleaned", lambda: split(pairs), rebuild, inputs)
    words = f"{folder}/vocabulary"
    rebuild = rebuild or not is_current(spark, words, inputs)
    if rebuild:
        write_table(full_vocabulary(learn_words(cleaned.filter(F.col("split") == "train"))), words)
        note_parameters(spark, words, inputs)
    vocabulary = load_vocabulary(spark, words)
    encoded = build_or_load(
        spark, f"{folder}/encoded", lambda: encode_pairs(cleaned, vocabulary, length, length), rebuild, {**inputs, "length": length}
    )
    return Corpus(cleaned, vocabulary, encoded)


@dataclass
class Fitted:
    """N-gram model and the alignment after each pass."""

    ngrams: NgramModel
    alignments: list[DataFrame]

    def model(self, after: int = 0, **options) -> PairModel:
        """The joint model after pass ``after``; the last one by default."""
        return pair_model(self.ngrams, self.alignments[after - 1], **options)


def fit(corpus: Corpus, epochs: int = EPOCHS) -> Fitted:
    train = corpus.encoded.filter(F.col("split") == "train")
    return Fitted(fit_ngrams(train, corpus.vocabulary), fit_alignment(train, epochs))


def token_losses(encoded: DataFrame, model: PairModel) -> DataFrame:
    """``(prompt_id, pos, w, p)``: the model's probability of every true token."""
    rows = positions(encoded, "pair_id").withColumnRenamed("pair_id", "prompt_id")
    return truth_probability(rows, model, target_scores(encoded, model.alignment), "prompt_id", "pos")


def validate(encoded: DataFrame, model: PairModel) -> DataFrame:
    """One row of masked loss, accuracy and strict accuracy over encoded pairs. Padding is never predicted."""
    rows = positions(encoded, "pair_id").withColumnRenamed("pair_id", "prompt_id")
    sources = encoded.select(F.col("pair_id").alias("prompt_id"), "input_ids")
    best = best_of_all(rows.select("prompt_id", "pos", "c2", "c1"), sources, model).select("prompt_id", "pos", F.col("w").alias("predicted"))
    scored = token_losses(encoded, model).join(best, ["prompt_id", "pos"])
    label = F.col("w")
    return scored.agg(
        masked_loss(-F.ln("p"), label).alias("val_loss"),
        masked_accuracy(F.col("predicted"), label).alias("val_masked_accuracy"),
        masked_accuracy(F.col("predicted"), label, strict=True).alias("val_masked_accuracy_strict"),
    )


def validation_history(corpus: Corpus, fitted: Fitted, run_id: str) -> DataFrame:
    """A history row per pass: loss and accuracy on the training rows and on the test rows."""
    train = corpus.encoded.filter(F.col("split") == "train")
    test = corpus.encoded.filter(F.col("split") == "test")
    history = None
    for epoch in range(1, len(fitted.alignments) + 1):
        model = fitted.model(after=epoch)
        seen = validate(train, model).select(
            F.lit(epoch).alias("epoch"), F.col("val_loss").alias("loss"), F.col("val_masked_accuracy").alias("masked_accuracy")
        )
        row = validate(test, model).withColumn("epoch", F.lit(epoch)).join(seen, "epoch").select(
            F.lit(run_id).alias("run_id"), "epoch", "loss", "val_loss", "masked_accuracy", "val_masked_accuracy"
        )
        history = row if history is None else history.unionByName(row)
    return stage(history, "history")


def train(pairs: DataFrame, folder: str, run_id: str, epochs: int = EPOCHS, **options) -> tuple[Corpus, Fitted, DataFrame]:
    """Prepare, fit, validate and append the history to ``folder/history``."""
    corpus = prepare(pairs, folder, **options)
    fitted = fit(corpus, epochs)
    history = validation_history(corpus, fitted, run_id)
    append_history(history, f"{folder}/history")
    return corpus, fitted, history
