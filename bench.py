"""Time the headline queries: one JSON line with seconds per query and their sum.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a list of other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.plans.queries import QUERIES  # noqa: E402
from pairloom.plans.session import local_session  # noqa: E402

HEADLINE = (
    "steps_per_epoch split_exact vocab_words encode_ids teacher_forcing decode_text corpus_chunks train_batches "
    "batch_export masked_loss early_stop ngram_model align_em embed_tokens attend_cross decode_greedy "
    "bpe_merges next_token_dist model_validation"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pairloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(lower(text)))").collect()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
