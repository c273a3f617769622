import sqlite3

import pytest
from pyspark.sql import functions as F

from pairloom.sources import pairs as P
from pairloom.sources import stages
from pairloom.workspace import SETTING, new_folder, shared_folder


def test_sqlite_table_is_read_in_ranges(spark, tmp_path, rows):
    path = str(tmp_path / "pairs.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE snippets (title TEXT, code TEXT, stars INTEGER)")
        db.executemany("INSERT INTO snippets VALUES (?, ?, ?)", [(f"t{i}", f"c{i}", i) for i in range(100)])
        db.execute("DELETE FROM snippets WHERE rowid BETWEEN 20 AND 40")
    df = P.read_pairs(spark, path, "snippets", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert df.columns == ["pair_id", "title", "code", "stars"]
    assert df.count() == 79 and df.agg(F.sum("stars")).first()[0] == sum(i for i in range(100) if not 19 <= i <= 39)
    assert rows(P.select_pairs(df).filter("pair_id = 1")) == [(1, "t0", "c0")]


def test_sqlite_empty_and_missing_table(spark, tmp_path):
    path = str(tmp_path / "pairs.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE snippets (title TEXT, code TEXT)")
    assert P.read_pairs(spark, path, "snippets").count() == 0
    with pytest.raises(Exception, match="no table"):
        P.read_pairs(spark, path, "other").count()


def test_drop_unknown_column(spark):
    df = spark.range(1).withColumn("a", F.lit(1))
    assert P.drop_columns(df, ["a"]).columns == ["id"]
    assert P.drop_columns(df, None).columns == ["id", "a"]
    with pytest.raises(ValueError, match="b"):
        P.drop_columns(df, ["a", "b"])


def test_turns_pair_only_direct_answers(spark, rows):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "x"), (1, 4, "assistant", "late")]
    turns += [(2, 0, "assistant", "hello"), (2, 1, "user", "q2"), (2, 2, "user", "q3"), (2, 3, "assistant", "a3")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert rows(P.pairs_from_turns(df)) == [(1000, "q", "a"), (2002, "q3", "a3")]


def test_too_long_conversation_is_an_error(spark):
    turns = spark.createDataFrame(
        [(1, 7, "user", "q"), (1, 8, "assistant", "a")], "conv_id long, turn long, role string, text string"
    )
    with pytest.raises(Exception, match="raise the stride"):
        P.pairs_from_turns(turns, stride=5).collect()


def test_documents_split_at_first_newline(spark, rows):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "one line"), (3, "\nb"), (4, "a\n")], "doc_id long, text string")
    assert rows(P.pairs_from_documents(df)) == [(1, "a", "b\nc"), (3, "", "b"), (4, "a", "")]


def test_missing_stage_and_reuse(spark):
    path, built = new_folder(spark, "test-stage"), []
    with pytest.raises(FileNotFoundError, match="no cleaned data"):
        stages.load_cleaned(spark, path)

    def build():
        built.append(1)
        return spark.createDataFrame([(len(built), "train")], "pair_id long, split string")

    assert stages.build_or_load(spark, path, build).first()["pair_id"] == 1
    assert stages.build_or_load(spark, path, build).first()["pair_id"] == 1
    assert stages.build_or_load(spark, path, build, force=True).first()["pair_id"] == 2


def test_split_is_a_folder(spark):
    path = new_folder(spark, "test-split")
    stages.write_cleaned(spark.range(4).selectExpr("id as pair_id", "if(id < 1, 'test', 'train') as split"), path)
    plan = stages.load_cleaned(spark, path).filter("split = 'test'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_large_vocabulary_is_refused(spark):
    path = new_folder(spark, "test-vocabulary")
    stages.write_table(spark.range(60000).selectExpr("cast(id as string) token", "cast(id as int) id", "1L n"), path)
    with pytest.raises(ValueError, match="at most"):
        stages.load_vocabulary(spark, path)


class Session:
    """A session with the given setting, on a cluster."""

    def __init__(self, folder):
        self.conf = {SETTING: folder}
        self.sparkContext = self
        self.master = "spark://cluster"

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(Session("/shared/run/")) == "/shared/run"
    with pytest.raises(ValueError, match=SETTING):
        shared_folder(Session(None))
    assert shared_folder(spark)


def test_tasks_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from pairloom.operators import bpe, vectors
    from pairloom.sources.sqlite import SqliteReader, SqliteSource

    sent = tmp_path / "sent"
    sent.write_bytes(cloudpickle.dumps([bpe.heap_merge, vectors.softmax_average, SqliteReader, SqliteSource]))
    code = "from pyspark import cloudpickle; f = cloudpickle.load(open('sent', 'rb'))[0]; print(f(['a', 'b'], {('a', 'b'): (0, 'ab')}))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "['ab']", done.stderr


def keyed_table(keys):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE snippets (id BIGINT, title VARCHAR)")
    db.execute("INSERT INTO snippets SELECT unnest(?::BIGINT[]), 't'", [list(keys)])
    return lambda query: db.execute(query).fetchall()


@pytest.mark.parametrize("keys", [
    list(range(1000)),
    [i**3 for i in range(-300, 300)] + [None] * 20,  # dense in the middle, far apart at the ends, and no key
    [5] * 400 + list(range(10**12, 10**12 + 400)),  # one key with half of the rows
    [7], [], [None, None],
])
def test_ranges_of_a_database_table(keys):
    ask = keyed_table(keys)
    bounds = P.key_bounds(ask, "snippets", "id", 50)
    predicates = P.range_predicates("id", bounds)
    counts = [ask(f"SELECT COUNT(*) FROM snippets WHERE {p}")[0][0] for p in predicates]
    assert sum(counts) == len(keys)  # every row once: the conditions exclude each other
    assert ask(f"SELECT COUNT(*) FROM snippets WHERE {' OR '.join(f'({p})' for p in predicates)}")[0][0] == len(keys)
    without = [k for k in keys if k is not None]
    hottest = max([without.count(k) for k in set(without)], default=0)
    assert all(n <= max(50, hottest) + keys.count(None) for n in counts) and len(counts) <= len(without) // 20 + 8


def test_many_ranges_take_several_queries(monkeypatch):
    monkeypatch.setattr(P, "RANGES_PER_QUERY", 2)
    keys = [10**10 * cluster + i for cluster in range(9) for i in range(60)]
    asked, ask = [], keyed_table(keys)
    bounds = P.key_bounds(lambda query: asked.append(query) or ask(query), "snippets", "id", 20)
    counts = [ask(f"SELECT COUNT(*) FROM snippets WHERE {p}")[0][0] for p in P.range_predicates("id", bounds)]
    assert sum(counts) == len(keys) and max(counts) <= 20 and len(asked) > 5
    assert all(query.count("WHEN") <= 2 for query in asked)


def test_database_table_is_asked_by_ranges():
    seen, ask = [], keyed_table(range(100))

    class Reader:
        """Stands for the session, its reader and the table it loads."""

        def __getattr__(self, name):
            return self

        def format(self, name):
            return self

        def options(self, **options):
            self.query = options["query"]
            return self

        def load(self):
            return self

        def collect(self):
            return ask(self.query)

        def jdbc(self, url, table, predicates, properties):
            seen.append((url, table, predicates, properties))
            return "table"

    assert P.read_pairs(Reader(), "jdbc:x:y", "snippets", key="id", rows_per_task=50, fetchsize=10) == "table"
    (url, table, predicates, properties), = seen
    assert (url, table, properties) == ("jdbc:x:y", "snippets", {"fetchsize": "10"})
    assert len(predicates) >= 8 and predicates[0].endswith("OR id IS NULL")


def test_fingerprint_follows_the_rows(spark):
    schema = "pair_id long, title string, code string"
    table = [(1, "a", None), (2, None, "a"), (3, "b", "c"), (3, "b", "c")]
    one = stages.fingerprint(spark.createDataFrame(table, schema))
    assert stages.fingerprint(spark.createDataFrame(table[::-1], schema).repartition(3)) == one
    changed = [
        [(1, None, "a"), *table[1:]], table[:3], [*table, table[3]], [*table[:2], (3, "b", "d"), (3, "b", "c")], [],
        [(1, "a", None), (2, "a", None), *table[2:]],
    ]
    found = [stages.fingerprint(spark.createDataFrame(t, schema)) for t in changed]
    assert len({one, *found}) == len(changed) + 1
    assert stages.fingerprint(spark.createDataFrame(table, schema.replace("code", "other"))) != one


def test_rewritten_input_is_noticed(spark):
    from pairloom.plans import training

    source, folder = new_folder(spark, "test-input"), new_folder(spark, "test-corpus")

    def prepared(texts, path):
        rows = [(i, t, f"{t} answer") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "pair_id long, title string, code string").repartition(2).write.mode("overwrite").parquet(path)
        corpus = training.prepare(spark.read.parquet(path), folder, length=8)
        return {r["title"] for r in corpus.pairs.collect()}, corpus.encoded.inputFiles()

    first, files = prepared(["red", "blue", "green"], source)
    assert first == {"red", "blue", "green"}
    again, same = prepared(["red", "blue", "green"], f"{source}-moved")  # equal rows, other files: nothing is built
    assert again == first and same == files
    changed, other = prepared(["red", "blue", "black"], source)  # the same path, other rows
    assert changed == {"red", "blue", "black"} and not set(other) & set(files)
