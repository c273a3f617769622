import pytest
from pyspark.sql import functions as F

from pairloom.operators import batches, ranking, split, vocabulary


def pairs(spark, n, step=1):
    return spark.range(n).select((F.col("id") * step).alias("pair_id"), F.lit("t").alias("title"), F.lit("c").alias("code"))


def by_id(df, column):
    return {r["pair_id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("n,test", [(11, 3), (10, 2), (1, 1), (0, 0), (935, 187)])
def test_exact_sizes(spark, n, test):
    for function in (split.split_exact, split.split_tail):
        got = function(pairs(spark, n))
        assert got.filter("split = 'test'").count() == test and got.count() == n


def test_tail_takes_the_last_ids(spark):
    ids = spark.createDataFrame([(i,) for i in (5, 10**15, -7, 3, 10**15 + 1)], "pair_id long")
    got = by_id(split.split_tail(ids, 0.4), "split")
    assert sorted(k for k, v in got.items() if v == "test") == [10**15, 10**15 + 1]


def test_smallest_by_id_in_clustered_ids(spark):
    ids = spark.range(1000).selectExpr("if(id < 900, id, id * 1000000007) as x")
    values = sorted(r["x"] for r in ids.collect())
    for take in (1, 500, 900, 901, 1000):
        assert ranking.smallest_by_id(ids, "x", lambda n: take, cells=16) == values[take - 1]
    assert ranking.smallest_by_id(ids, "x", lambda n: n + 1) is None


def test_splits_and_batches_do_not_depend_on_partitioning(spark):
    a, b = pairs(spark, 500), pairs(spark, 500).repartition(7, "pair_id")
    assert by_id(split.split_fraction(a), "split") == by_id(split.split_fraction(b), "split")
    assert by_id(split.split_exact(a), "split") == by_id(split.split_exact(b), "split")
    assert sorted(batches.train_batches(a).collect()) == sorted(batches.train_batches(b).collect())


def test_steps(spark):
    df = spark.range(125).selectExpr("id as pair_id", "if(id < 100, 'train', 'test') as split")
    row = split.steps_per_epoch(df).first()
    assert (row["train_steps"], row["validation_steps"]) == (3, 4)
    assert split.steps_per_epoch(df, count="before_split").first()["train_steps"] == 3
    row = split.steps_per_epoch(split.split_disabled(df)).first()
    assert (row["train_rows"], row["test_rows"], row["validation_steps"]) == (125, 0, 0)


def test_batches_span_epochs(spark):
    got = batches.train_batches(pairs(spark, 6), size=4, epochs=2).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch_id"], []).append(r["epoch"])
    assert {k: len(v) for k, v in sizes.items()} == {0: 4, 1: 4, 2: 4}
    assert sorted(sizes[1]) == [0, 0, 1, 1]
    for epoch in (0, 1):
        assert sorted(r["pair_id"] for r in got if r["epoch"] == epoch) == list(range(6))
    apart = batches.train_batches(pairs(spark, 6), size=4, epochs=2, span_epochs=False).collect()
    assert {(r["epoch"], r["batch_id"]) for r in apart} == {(0, 0), (0, 1), (1, 2), (1, 3)}


@pytest.mark.parametrize("n", [1, 3, 8, 9, 21])
def test_validation_fills_its_last_batch(spark, n):
    got = batches.validation_batches(pairs(spark, n), size=8)
    steps = -(-n // 8)
    assert got.count() == steps * 8 and got.select("batch_id", "slot").distinct().count() == steps * 8
    assert [r["pair_id"] for r in got.orderBy("batch_id", "slot").collect()] == [i % n for i in range(steps * 8)]


def test_step_limit(spark):
    layout = batches.train_batches(pairs(spark, 70), size=32, epochs=2)
    taken = batches.limit_steps(layout, steps=2, epochs=2)
    assert taken.count() == 4 * 32 and {r["fit_epoch"] for r in taken.collect()} == {0, 1}


def test_export_keeps_batches_whole(spark, tmp_path):
    layout = batches.train_batches(pairs(spark, 200), size=16, epochs=1)
    encoded = pairs(spark, 200).select("pair_id", F.lit("train").alias("split"), F.array("pair_id").alias("input_ids"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batches.export_batches(layout, encoded, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    assert rows.count() == 200
    assert rows.groupBy("batch_id").agg(F.countDistinct("file").alias("files")).filter("files > 1").count() == 0
    assert rows.select("file").distinct().count() > 1


def test_ranks_of_clustered_and_repeated_ids(spark):
    ids = spark.createDataFrame([(i % 3 * 10**12 + i,) for i in range(300)] + [(5,)] * 50, "pair_id long")
    ranked = ranking.rank_by_id(ids, "pair_id", bounds=[3, 6, 10**12, 2 * 10**12]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(350)) and {r["total"] for r in ranked} == {350}
    assert [r["pair_id"] for r in ranked] == sorted(r["pair_id"] for r in ids.collect())


def test_range_bucket(spark):
    bounds = [2, 4, 8, 100, 1000]
    got = spark.range(0, 1100).select("id", ranking.range_bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(c <= r["id"] for c in bounds) for r in got)


def test_too_many_groups_are_refused(spark):
    with pytest.raises(ValueError):
        ranking.rank_by_hash(pairs(spark, 1), "title", "pair_id", group_count=1 << 20)


def test_chunks(spark):
    df = pairs(spark, 25, 3).withColumn("split", F.lit("train"))
    got = by_id(vocabulary.corpus_chunks(df, rows=10), "chunk_id")
    assert got == {3 * i: i // 10 for i in range(25)}


def test_no_data_rows_in_one_partition(spark):
    plan = batches.epoch_shuffle(pairs(spark, 100))._jdf.queryExecution().executedPlan().toString()
    # The offsets are grouped per epoch; the rows themselves are spread by (epoch, bucket).
    assert "SinglePartition" not in plan and "Window" in plan
