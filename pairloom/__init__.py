"""Paired-text analytics on Spark: corpora, vocabularies, batches, metrics, count models and decoding."""
