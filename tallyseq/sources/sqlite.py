"""SQLite tables and views as a Spark data source: ranges of row numbers, read in Arrow batches; one range where there are none.

Values are cast by the database to what their column's declared type says, as its own expressions would be.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000
#: What a declared type holds decides, in this order, how it is read; a column of no type, and dates, are read as text.
_TYPES = [("INT", "INTEGER", "long", pa.int64()), ("CHAR", "TEXT", "string", pa.string()), ("CLOB", "TEXT", "string", pa.string()), ("TEXT", "TEXT", "string", pa.string()), ("BLOB", "BLOB", "binary", pa.binary()),
          ("REAL", "REAL", "double", pa.float64()), ("FLOA", "REAL", "double", pa.float64()), ("DOUB", "REAL", "double", pa.float64()), ("BOOL", "INTEGER", "long", pa.int64()), ("NUM", "REAL", "double", pa.float64()),
          ("DEC", "REAL", "double", pa.float64()), ("", "TEXT", "string", pa.string())]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _columns(path: str, table: str) -> list[tuple[str, str, str, pa.DataType]]:
    """(name, how it is cast, Spark type, Arrow type) of a table's columns."""
    with closing(_open(path)) as db:
        found = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"{path}: no table {table}")
    return [(c[1], *next(t[1:] for t in _TYPES if t[0] in (c[2] or "").upper())) for c in found]


def _row_number(db: sqlite3.Connection, table: str, names: list[str]) -> str | None:
    """A name of the row number that no column has; None for a table without it, and for a view."""
    free = [n for n in ("rowid", "_rowid_", "oid") if n not in {c.lower() for c in names}]
    kind = db.execute("SELECT type FROM sqlite_master WHERE name = ?", (table,)).fetchone()
    if not free or kind is None or kind[0] != "table":
        return None
    try:
        db.execute(f"SELECT {free[0]} FROM {_quoted(table)} LIMIT 1")
    except sqlite3.OperationalError:
        return None
    return free[0]


class _Range(InputPartition):
    def __init__(self, number: str | None = None, low: int = 0, high: int = 0):
        self.number, self.low, self.high = number, low, high


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))

    def partitions(self):
        names = [c[0] for c in _columns(self.path, self.table)]
        with closing(_open(self.path)) as db:
            number = _row_number(db, self.table, names)
            if number is None:
                return [_Range()]
            low, high = db.execute(f"SELECT min({number}), max({number}) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(number)]
        step = -(-(high + 1 - low) // self.parts)
        return [_Range(number, x, min(x + step, high + 1)) for x in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        columns = _columns(self.path, self.table)
        listed = ", ".join(f"CAST({_quoted(c[0])} AS {c[1]})" for c in columns)
        bounds, values = ("", ()) if partition.number is None else (f" WHERE {partition.number} >= ? AND {partition.number} < ?", (partition.low, partition.high))
        with closing(_open(self.path)) as db:
            db.text_factory = lambda raw: raw.decode("utf-8", "replace")
            rows = db.execute(f"SELECT {listed} FROM {_quoted(self.table)}{bounds}", values)
            while got := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(v, c[3]) for c, v in zip(columns, zip(*got))], [c[0] for c in columns])


class SqliteSource(DataSource):
    """Options: path, table, partitions. The file must be where executors can open it (SRC-24)."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        return ", ".join(f"`{n}` {t}" for n, _, t, _ in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema):
        return _Reader(self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, clustered_by: str | None = None) -> DataFrame:
    """A table; with ``clustered_by`` all rows of a value stand together in one partition, in order."""
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").options(path=path, table=table, partitions=partitions).load()
    return df if clustered_by is None else df.repartition(F.col(clustered_by)).sortWithinPartitions(clustered_by)
