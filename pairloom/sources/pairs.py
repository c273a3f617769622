"""Tables of (input, output) text pairs: ``pairs(pair_id, title, code)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.ranking import even_bounds
from pairloom.settings import INPUT_COLUMN, OUTPUT_COLUMN


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, read as it is; ``spark.sql.files.*`` decides into how many pieces."""
    return spark.read.parquet(path)


def read_pairs(
    spark: SparkSession, location: str, table: str | None = None, key: str | None = None, rows_per_task: int = 1_000_000, **options
) -> DataFrame:
    """A whole pair table: Parquet by path, SQLite by database file and table name, or JDBC by url and table name.

    A JDBC table is read by one task per ``rows_per_task`` rows where ``key`` names a column of whole numbers, by a single
    task otherwise (or as Spark's own options say).
    """
    if location.startswith("jdbc:"):
        if key is None:
            return spark.read.format("jdbc").options(url=location, dbtable=table, **options).load()
        return _read_ranges(spark, location, table, key, rows_per_task, options)
    if table is not None:
        from pairloom.sources.sqlite import SqliteSource

        spark.dataSource.register(SqliteSource)
        return spark.read.format("sqlite_table").options(path=location, table=table, **options).load()
    return read_table(spark, location)


def ends_sql(table: str, key: str) -> str:
    """Least and largest key and how many rows have one."""
    return f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n FROM {table}"


def cells_sql(table: str, key: str, ranges: list[tuple[int, int, int]]) -> str:
    """Rows per cell of the ranges (low, high, width); the database counts, only the counts travel."""
    cases = " ".join(
        f"WHEN {key} BETWEEN {low} AND {high} THEN {low} + FLOOR(({key} - {low}) / {width}) * {width}" for low, high, width in ranges
    )
    return f"SELECT cell, COUNT(*) AS n FROM (SELECT CASE {cases} END AS cell FROM {table}) cells WHERE cell IS NOT NULL GROUP BY cell"


def range_predicates(key: str, bounds: list[int]) -> list[str]:
    """Conditions that together hold for every row exactly once; rows without a key go with the first."""
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [f"{key} < {bounds[0]} OR {key} IS NULL", *inner, f"{key} >= {bounds[-1]}"]


#: Ranges that are counted by one query: databases bound the length of a statement.
RANGES_PER_QUERY = 100


def key_bounds(ask: Callable[[str], list], table: str, key: str, rows_per_task: int) -> list[int]:
    """Keys that cut the table into ranges of about equal rows, however uneven the keys are; ``ask`` runs a query."""

    def counted(ranges):
        parts = [ranges[i : i + RANGES_PER_QUERY] for i in range(0, len(ranges), RANGES_PER_QUERY)]
        return [(int(cell), int(n)) for part in parts for cell, n in ask(cells_sql(table, key, part))]

    low, high, n = ask(ends_sql(table, key))[0]
    return even_bounds((int(low), int(high), int(n)), counted, rows_per_task) if n else []


def _read_ranges(spark: SparkSession, url: str, table: str, key: str, rows_per_task: int, options: dict) -> DataFrame:
    def ask(query):
        return [tuple(r) for r in spark.read.format("jdbc").options(url=url, query=query, **options).load().collect()]

    predicates = range_predicates(key, key_bounds(ask, table, key, rows_per_task))
    return spark.read.jdbc(url, table, predicates=predicates, properties={k: str(v) for k, v in options.items()})


def select_pairs(df: DataFrame, source: str = INPUT_COLUMN, target: str = OUTPUT_COLUMN, key: str = "pair_id") -> DataFrame:
    """Keep the key and the two configured text columns under their standard names."""
    return df.select(F.col(key).alias("pair_id"), F.col(source).alias("title"), F.col(target).alias("code"))


def drop_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Drop columns by name. An unknown name is an error, where ``DataFrame.drop`` would be silent."""
    unknown = sorted(set(columns or []) - set(df.columns))
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return df.drop(*(columns or []))


def turn_id(stride: int) -> Column:
    """``conv_id * stride + turn``. A turn that would run into the next conversation's ids is an error, not a clash."""
    turn = F.when(F.col("turn") < stride, F.col("turn")).otherwise(
        F.raise_error(F.lit(f"a conversation has more than {stride} turns; raise the stride"))
    )
    return F.col("conv_id") * stride + turn


def pairs_from_turns(conversations: DataFrame, stride: int = 1000) -> DataFrame:
    """A user turn and the assistant turn right behind it.

    An equi-join on (conversation, turn) rather than a window per conversation: one very long conversation spreads
    over all tasks. ``stride`` is the room for turns in an id.
    """
    asked = conversations.filter(F.col("role") == "user").select(
        "conv_id",
        (F.col("turn") + 1).alias("answer_turn"),
        turn_id(stride).alias("pair_id"),
        F.col("text").alias("title"),
    )
    answered = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("answer_turn"), F.col("text").alias("code")
    )
    return asked.join(answered, ["conv_id", "answer_turn"]).select("pair_id", "title", "code")


def pairs_from_documents(documents: DataFrame) -> DataFrame:
    """First line as input, the rest as output; texts of one line have no output and are left out."""
    newline = F.instr("text", "\n")
    return documents.filter(newline > 0).select(
        F.col("doc_id").alias("pair_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substring(text, instr(text, '\n') + 1)").alias("code"),
    )


def prompts_from_turns(conversations: DataFrame, stride: int = 1000) -> DataFrame:
    """Every user turn as a prompt."""
    return conversations.filter(F.col("role") == "user").select(
        turn_id(stride).alias("prompt_id"), "text"
    )
