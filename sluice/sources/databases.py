"""PostgreSQL and MySQL through JDBC: options, table lists and metadata.

The JDBC driver jar comes with the cluster. Reads are split by a numeric or date column,
so executors fetch in parallel.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.sources import sqlite

# Default ports, and the variables that hold connection defaults.
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306, "sqlite": 0}
ALIASES = {"postgres": "postgresql"}
ENVIRONMENT = {
    "postgresql": {"host": "POSTGRES_HOST", "port": "POSTGRES_PORT", "database": "POSTGRES_DATABASE",
                   "username": "POSTGRES_USER", "password": "POSTGRES_PASSWORD"},
    "mysql": {"host": "MYSQL_HOST", "port": "MYSQL_PORT", "database": "MYSQL_DATABASE",
              "username": "MYSQL_USER", "password": "MYSQL_PASSWORD"},
}
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}
SYSTEM_SCHEMAS = {
    "postgresql": ("information_schema", "pg_catalog"),
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
}


def resolve(config: Mapping[str, Any], environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Connection parameters: given ones first, then the environment, then defaults."""
    environ = os.environ if environ is None else environ
    kind = ALIASES.get(config.get("type", ""), config.get("type", ""))
    if kind not in DEFAULT_PORTS:
        raise ValueError(f"unknown source type {kind!r}; one of {sorted(DEFAULT_PORTS)}")
    out = {**config, "type": kind}
    if kind == "sqlite":
        out.setdefault("database", ":memory:")
        return out
    defaults = {"host": "localhost", "port": str(DEFAULT_PORTS[kind]), "database": "", "username": "", "password": ""}
    for key, variable in ENVIRONMENT[kind].items():
        if out.get(key) is None:
            out[key] = environ.get(variable, defaults[key])
    out["port"] = int(out["port"])
    return out


def jdbc_options(config: Mapping[str, Any], table: str | None = None, query: str | None = None,
                 partition: tuple[str, Any, Any, int] | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for a table or a query; `partition` is (column, lower, upper, parts)."""
    c = resolve(config)
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {
        "url": f"jdbc:{c['type']}://{c['host']}:{c['port']}/{c['database']}",
        "user": c["username"], "password": c["password"], "driver": DRIVERS[c["type"]],
        "fetchsize": str(fetch_size),
    }
    if partition:
        column, lower, upper, parts = partition
        # Spark splits only `dbtable` reads, so a query becomes a derived table.
        options["dbtable"] = table if table is not None else f"({query}) AS q"
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(parts)}
    elif table is not None:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def read(spark: SparkSession, config: Mapping[str, Any], table: str | None = None, query: str | None = None,
         partition: tuple[str, Any, Any, int] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config, table, query, partition)).load()


def tables_query(kind: str, schema: str | None = None) -> str:
    """The user tables of a database."""
    kind = ALIASES.get(kind, kind)
    hidden = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS[kind])
    text = ("SELECT table_schema, table_name FROM information_schema.tables "
            f"WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ({hidden})")
    return text + (f" AND table_schema = '{_quoted(schema)}'" if schema else "")


def columns_query(kind: str, table: str, schema: str | None = None) -> str:
    """Column metadata of a table."""
    text = ("SELECT table_schema, table_name, ordinal_position, column_name, data_type, is_nullable, column_default, "
            "character_maximum_length, numeric_precision, numeric_scale FROM information_schema.columns "
            f"WHERE table_name = '{_quoted(table)}'")
    return text + (f" AND table_schema = '{_quoted(schema)}'" if schema else "")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def connection_info(config: Mapping[str, Any]) -> dict[str, Any]:
    """The parameters without the password."""
    return {k: v for k, v in resolve(config).items() if k != "password"}


def test_connection(spark: SparkSession, config: Mapping[str, Any]) -> bool:
    """Can one row be read? The reason of a failure is not hidden: it is raised by `read`."""
    try:
        c = resolve(config)
        if c["type"] == "sqlite":
            return sqlite.read(spark, c["database"], query="SELECT 1 AS one").count() == 1
        return read(spark, c, query="SELECT 1 AS one").count() == 1
    except Exception:  # noqa: BLE001 - any failure means no connection
        return False


test_connection.__test__ = False
