"""A data source for SQLite databases: parallel reads by ranges of rowids, a stream by cursors, and writes in parts.

A path is one database, or a folder of databases (*.db) that a write has left, one for each of its tasks. Paths are files that all executors reach.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

# sources travel with their code, as the process that plans them doesn't know the shipped package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TO_SPARK = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
_TO_SQLITE = {"byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB", "string": "TEXT"}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _files(path: str) -> list[str]:
    path = _local(path)
    return sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else [path]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(file: str) -> sqlite3.Connection:
    if not os.path.exists(file):
        raise FileNotFoundError(file)
    # read only: a reader never waits for a lock that it would need to write
    return sqlite3.connect(f"file:{file.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True, timeout=60)


def _columns(path: str, table: str) -> list[tuple[str, T.DataType]]:
    for file in _files(path):
        with _open(file) as c:
            found = [(r[1], next((t for k, t in _TO_SPARK if k in (r[2] or "").upper()), T.StringType())) for r in c.execute(f"PRAGMA table_info({_quoted(table)})")]
        if found:
            return found
    raise ValueError(f"no table {table} in {path}")


def _tables(c: sqlite3.Connection) -> set[str]:
    return {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}


def _value(v, kind: T.DataType):
    """A stored value as its column's type has it: SQLite lets any value into any column."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    try:
        return int(v) if isinstance(kind, T.LongType) else float(v)
    except (TypeError, ValueError):
        return None


@dataclass
class _Range(InputPartition):
    """Rows of one table in one file with low < key <= high."""

    file: str
    table: str
    key: str
    low: int
    high: int


def _ranges(file: str, table: str, key: str, low: int, high: int, n: int) -> list[_Range]:
    step = max(1, -(-(high - low) // n))
    return [_Range(file, table, key, a, min(a + step, high)) for a in range(low, high, step)]


def _rows(part: _Range, names: list[str], schema: T.StructType, where: str = "", values: tuple = ()) -> Iterator[tuple]:
    shown = ", ".join(_quoted(n) for n in names)
    with _open(part.file) as c:
        cursor = c.execute(f"SELECT {shown} FROM {_quoted(part.table)} WHERE {part.key} > ? AND {part.key} <= ?{where}", (part.low, part.high, *values))
        kinds = [schema[n].dataType for n in names]
        while rows := cursor.fetchmany(4096):
            for r in rows:
                yield tuple(_value(v, k) for v, k in zip(r, kinds, strict=True))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, n: int):
        self._path, self._table, self._schema, self._n = path, table, schema, n
        self._where, self._values = "", ()

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and isinstance(f, tuple(_COMPARED)) and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self._where += f" AND {_quoted(column[0])} {_COMPARED[type(f)]} ?"
                self._values += (f.value,)
            elif len(column) == 1 and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value) and len(f.value) <= 500:
                self._where += f" AND {_quoted(column[0])} IN ({', '.join('?' * len(f.value))})"
                self._values += tuple(f.value)
            elif len(column) == 1 and isinstance(f, IsNotNull):
                self._where += f" AND {_quoted(column[0])} IS NOT NULL"
            # Spark checks all filters again: SQLite may hold values of another type than the column's
            yield f

    def partitions(self):
        files = _files(self._path)
        each = max(1, self._n // max(1, len(files)))
        out = []
        for file in files:
            with _open(file) as c:
                if self._table not in _tables(c):
                    continue
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self._table)}").fetchone()
            if low is not None:
                out += _ranges(file, self._table, "rowid", low - 1, high, each)
        return out

    def read(self, partition):
        if partition is not None:  # what Spark hands over for a table without rows
            yield from _rows(partition, self._schema.names, self._schema, self._where, self._values)


class _Cursors(DataSourceStreamReader):
    """New rows of several tables; the offset is the largest id seen of each."""

    def __init__(self, path: str, keys: dict[str, str], schema: T.StructType, n: int):
        self._path, self._keys, self._schema, self._n = path, keys, schema, n

    def _held(self, table: str) -> list[str]:
        return [n for n, _ in _columns(self._path, table)]

    def initialOffset(self) -> dict:
        return {table: 0 for table in self._keys}

    def latestOffset(self) -> dict:
        last = self.initialOffset()
        for file in _files(self._path):
            with _open(file) as c:
                for table in _tables(c) & self._keys.keys():
                    last[table] = max(last[table], c.execute(f"SELECT coalesce(max({_quoted(self._keys[table])}), 0) FROM {_quoted(table)}").fetchone()[0])
        return last

    def partitions(self, start: dict, end: dict):
        files = _files(self._path)
        each, out = max(1, self._n // max(1, len(files))), []
        for file in files:
            with _open(file) as c:
                held = _tables(c)
            for table, key in self._keys.items():
                if table in held:
                    out += _ranges(file, table, _quoted(key), start.get(table, 0), end.get(table, 0), each)
        return out

    def read(self, partition):
        if partition is None:
            return
        held = set(self._held(partition.table))
        names = [n for n in self._schema.names if n in held]
        own = {n: k for k, n in enumerate(names)}
        for r in _rows(partition, names, self._schema):
            yield tuple(partition.table if n == "source_table" else r[own[n]] if n in own else None for n in self._schema.names)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class _Writer(DataSourceWriter):
    """Each task writes a database of its own under a name that isn't read, which gets its final name when all tasks have ended."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self._path, self._table, self._schema, self._overwrite = _local(path), table, schema, overwrite

    def write(self, iterator):
        os.makedirs(self._path, exist_ok=True)
        file = f"{self._path}/part-{uuid.uuid4().hex}.db-unfinished"
        names = ", ".join(f"{_quoted(f.name)} {_TO_SQLITE.get(f.dataType.typeName(), 'TEXT')}" for f in self._schema)
        plain = [f.dataType.typeName() in _TO_SQLITE for f in self._schema]
        with sqlite3.connect(file) as c:
            c.execute(f"CREATE TABLE {_quoted(self._table)} ({names})")
            marks = ", ".join("?" * len(plain))
            c.executemany(f"INSERT INTO {_quoted(self._table)} VALUES ({marks})", (tuple(v if ok or v is None else str(v) for v, ok in zip(r, plain, strict=True)) for r in iterator))
        c.close()
        return _Written((file,))

    def commit(self, messages):
        old = _files(self._path) if self._overwrite and os.path.isdir(self._path) else []
        for m in messages:
            for file in m.files if m else ():
                os.rename(file, file.removesuffix("-unfinished"))
        for file in old:
            os.remove(file)

    def abort(self, messages):
        for m in messages:
            for file in m.files if m else ():
                if os.path.exists(file):
                    os.remove(file)


class SQLite(DataSource):
    """format("sqlite") with the options path, dbtable and partitions (8). A stream takes cursors instead of dbtable, such as posts:post_id,votes:vote_id: integer
    ids that grow from 1; its rows have the table's name in source_table and null in columns that the table lacks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _keys(self) -> dict[str, str]:
        return dict(pair.strip().split(":") for pair in self.options["cursors"].split(","))

    def schema(self) -> T.StructType:
        path = self.options["path"]
        if "cursors" not in self.options:
            return T.StructType([T.StructField(n, t) for n, t in _columns(path, self.options["dbtable"])])
        found: dict[str, T.DataType] = {"source_table": T.StringType()}
        for table in self._keys():
            for n, t in _columns(path, table):
                if found.setdefault(n, t) != t:
                    raise ValueError(f"column {n} of {table} has another type in an earlier table")
        return T.StructType([T.StructField(n, t) for n, t in found.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("partitions", 8)))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Cursors(self.options["path"], self._keys(), schema, int(self.options.get("partitions", 8)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["dbtable"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("sqlite") known to a session, which then pushes filters to Python sources unless it says otherwise."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLite)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a database, read in about so many parts by ranges of rowids."""
    register(spark)
    return spark.read.format("sqlite").option("dbtable", table).option("partitions", partitions).load(path)


def write_sqlite(rows: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """Rows as a folder of databases, one for each partition. Types that SQLite lacks are written as texts."""
    register(rows.sparkSession)
    rows.write.format("sqlite").option("dbtable", table).mode(mode).save(path)


def sqlite_news(spark: SparkSession, path: str, cursors: dict[str, str], partitions: int = 8) -> DataFrame:
    """A stream of what a forum's database gains: rows of each table beyond the id seen last, by table and id column."""
    register(spark)
    return spark.readStream.format("sqlite").option("cursors", ",".join(f"{t}:{k}" for t, k in cursors.items())).option("partitions", partitions).load(path)
