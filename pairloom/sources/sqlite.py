"""SQLite tables as a partitioned Spark source. The file must be readable by every executor."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

AFFINITY = {"INT": LongType(), "CHAR": StringType(), "CLOB": StringType(), "TEXT": StringType(), "BLOB": BinaryType()}
AFFINITY |= {"REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType()}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: ``path``, ``table``, and ``partitions`` (rowid ranges read side by side, 8 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        fields = []
        for _, name, declared, *_ in columns:
            kind = next((t for part, t in AFFINITY.items() if part in declared.upper()), StringType())
            fields.append(StructField(name, kind))
        if any(f.name.lower() == "pair_id" for f in fields):
            return StructType(fields)
        return StructType([StructField("pair_id", LongType()), *fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        with _connect(self.options["path"]) as db:
            own = {row[1] for row in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")}
        return SqliteReader(self.options, [_quoted(f.name) if f.name in own else "rowid" for f in schema.fields])


class SqliteReader(DataSourceReader):
    """Each task reads one rowid range in batches; ``pair_id`` is the rowid unless the table has a column of that name."""

    def __init__(self, options, columns: list[str]):
        self.path, self.table = options["path"], options["table"]
        self.count, self.columns = int(options.get("partitions", 8)), columns

    def partitions(self) -> list[RowidRange]:
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowidRange(0, 0)]
        width = (high - low) // self.count + 1
        return [RowidRange(a, a + width) for a in range(low, high + 1, width)]

    def read(self, partition: RowidRange):
        query = f"SELECT {', '.join(self.columns)} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?"
        with _connect(self.path) as db:
            yield from db.execute(query, (partition.low, partition.high))
