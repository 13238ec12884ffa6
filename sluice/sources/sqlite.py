"""A SQLite reader as a Spark data source: `spark.read.format("sqlite")`.

Options: `path`, and `dbtable` or `query`; `numPartitions` splits a table by rowid ranges.
The file must be on a folder all executors share.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TABLES = "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"


def _connect(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


def _spark_type(declared: str) -> T.DataType:
    """By SQLite's own affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "DEC", "NUM")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def _fitting(kind: T.DataType, column: str):
    """A function that gives a value in the column's type, or raises where it does not fit: SQLite
    keeps any value in any column."""
    def fit(v):
        if v is None:
            return None
        if isinstance(kind, T.LongType) and isinstance(v, int) or isinstance(kind, T.BinaryType) and isinstance(v, bytes):
            return v
        if isinstance(kind, T.DoubleType) and (isinstance(v, float) or isinstance(v, int) and int(float(v)) == v):
            return float(v)
        if isinstance(kind, T.StringType) and isinstance(v, str):
            return v
        if isinstance(kind, T.StringType) and isinstance(v, int | float):
            return str(v)
        raise ValueError(f"column {column}: {v!r} is not a {kind.simpleString()}; give a schema that holds it")

    return fit


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.text = options["path"], options.get("dbtable"), options.get("query")
        self.parts = int(options.get("numpartitions", options.get("numPartitions", 1)))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        if self.text or self.parts <= 1:
            return [_Range(None, None)]
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [_Range(None, None)]
        size = (high - low) // self.parts + 1
        return [_Range(s, min(s + size, high + 1)) for s in range(low, high + 1, size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        casts = [_fitting(f.dataType, f.name) for f in self.schema.fields]
        text, args = self.text, ()
        if not text:
            text = f"SELECT * FROM {_name(self.table)}"
            if partition.low is not None:
                text, args = text + " WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)
        with _connect(self.path) as db:
            for row in db.execute(text, args):
                yield tuple(cast(v) for cast, v in zip(casts, row))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as db:
            if "query" in self.options:
                # The kinds of all values decide, counted by SQLite; a column of numbers of both
                # kinds is double, any other mixture text.
                text = self.options["query"]
                names = [d[0] for d in db.execute(f"SELECT * FROM ({text}) LIMIT 0").description]
                kinds = {frozenset({"integer"}): T.LongType(), frozenset({"real"}): T.DoubleType(),
                         frozenset({"integer", "real"}): T.DoubleType(), frozenset({"blob"}): T.BinaryType()}
                fields = []
                for name in names:
                    rows = db.execute(f"SELECT DISTINCT typeof({_name(name)}) FROM ({text})").fetchall()
                    found = frozenset(x for x, in rows) - {"null"}
                    fields.append(T.StructField(name, kinds.get(found, T.StringType())))
                return T.StructType(fields)
            rows = db.execute(f"PRAGMA table_info({_name(self.options['dbtable'])})").fetchall()
        return T.StructType([T.StructField(r[1], _spark_type(r[2] or ""), not r[3],
                                           {"raw_type": r[2], "primary_key": bool(r[5]), "default": r[4]})
                             for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


# Connector types by name; more can be added with register_connector.
_CONNECTORS: dict[str, type[DataSource]] = {"sqlite": SqliteSource}


def register_connector(spark: SparkSession, name: str, source: type[DataSource]) -> None:
    """Make a data source class available as `spark.read.format(name)`."""
    if source.name() != name:
        raise ValueError(f"the class calls itself {source.name()!r}, not {name!r}")
    _CONNECTORS[name] = source
    spark.dataSource.register(source)


def available_connectors() -> list[str]:
    return sorted({*_CONNECTORS, "postgresql", "mysql"})


def read(spark: SparkSession, path: str, table: str | None = None, query: str | None = None,
         partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("numPartitions", partitions)
    return (reader.option("dbtable", table) if table else reader.option("query", query)).load()


def tables(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, query=_TABLES.replace("name FROM", "name AS table_name FROM"))


def columns(spark: SparkSession, path: str, table: str) -> DataFrame:
    quoted = table.replace("'", "''")
    return read(spark, path, query=(
        f"SELECT '{quoted}' AS table_name, cid AS ordinal_position, name AS column_name, type AS raw_type, "
        f"\"notnull\" = 0 AS nullable, dflt_value AS default_value, pk > 0 AS is_primary_key "
        f"FROM pragma_table_info('{quoted}')"))


def sample(spark: SparkSession, path: str, table: str, n: int = 100) -> DataFrame:
    return read(spark, path, table).limit(n)
