"""What is in a source: tables, columns, row counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.mapping.types import raw_type_name


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session, by name."""
    names = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "table_name string, table_type string")


def list_files(spark: SparkSession, folder: str, suffix: str = "parquet") -> DataFrame:
    """Tables of a folder: one per file or sub-folder with the suffix."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path))
    rows = [(n[: -len(suffix) - 1], f"{folder.rstrip('/')}/{n}") for n in names if n.endswith("." + suffix)]
    return spark.createDataFrame(rows, "table_name string, path string")


def column_rows(tables: Mapping[str, DataFrame], source_id: str,
                primary_keys: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Catalog rows from the schemas alone; no data is read."""
    keys = primary_keys or {}
    rows = [
        (source_id, name, i, f.name, f.dataType.simpleString(), raw_type_name(f.dataType.simpleString()),
         f.nullable, f.name in keys.get(name, []))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "source_id string, table_name string, ordinal_position int, column_name string, spark_type string, "
              "raw_type string, nullable boolean, is_primary_key boolean")


def column_details(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column: position from 1, nullable, precision and scale of numbers, default, length.

    Defaults and lengths come from the schema's metadata, where a database reader or a table
    definition has left them; files have none.
    """
    # Bits or digits of the number types; fixed values.
    digits = {"tinyint": (8, 0), "smallint": (16, 0), "int": (32, 0), "bigint": (64, 0), "float": (24, 0), "double": (53, 0)}
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            kind = f.dataType
            precision, scale = ((kind.precision, kind.scale) if isinstance(kind, T.DecimalType)
                                else digits.get(kind.simpleString(), (None, None)))
            length = kind.length if isinstance(kind, T.VarcharType | T.CharType) else f.metadata.get("max_length")
            default = f.metadata.get("default", f.metadata.get("CURRENT_DEFAULT"))
            rows.append((name, f.name, i + 1, f.nullable, precision, scale, default, length))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal_position int, nullable boolean, numeric_precision int, "
              "numeric_scale int, column_default string, max_length int")


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Per table, the bytes and the number of its files, from the file system's own summary."""
    rows = []
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where)
        rows.append((name, found.getLength(), found.getFileCount()))
    return spark.createDataFrame(rows, "table_name string, bytes long, files long")


def file_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Per name, the rows in the Parquet files of its path (a file or a folder at any depth), and the number and bytes of
    the files that have rows.

    One scan for any number of paths. It asks for no column, so rows are counted from the footers, and rows are told apart
    by the file they come from. A name without rows has zeros.
    """
    def plain(uri: Column) -> Column:  # file:/x and file:///x are one
        return F.regexp_replace(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")

    def qualified(path: str) -> str:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString().rstrip("/")

    roots = spark.createDataFrame([(name, qualified(path)) for name, path in paths.items()], "name string, uri string")
    scan = spark.read.schema("`no column` int").option("recursiveFileLookup", "true").parquet(*set(paths.values()))
    files = scan.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))
    parts = F.split("uri", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    under = files.select("rows", "bytes", plain(F.col("file_path")).alias("uri")).select("rows", "bytes", F.explode(above).alias("root"))
    named = under.join(F.broadcast(roots.select("name", plain(F.col("uri")).alias("root"))), "root")  # a row for each path given
    found = named.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    zero = F.lit(0).cast("long")
    return roots.select("name").join(F.broadcast(found), "name", "left").select(
        "name", F.coalesce("rows", zero).alias("row_count"), F.coalesce("files", zero).alias("files"),
        F.coalesce("bytes", zero).alias("bytes"))


def table_metadata(tables: Mapping[str, DataFrame], source_id: str, paths: Mapping[str, str] | None = None) -> DataFrame:
    """Per table: row count, column count and column list. With the tables' Parquet `paths`, one scan of footers counts all
    of them; else the plan has a branch for each table. No column is read either way."""
    return discover({source_id: ("", tables)}, {source_id: paths} if paths else None).drop("source_type")


def _counted(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """(source_id, table_name, row_count) of tables that are not files."""
    seen = reduce(DataFrame.unionByName, [df.select(F.lit(sid).alias("source_id"), F.lit(name).alias("table_name"))
                                          for (sid, name), df in tables.items()])
    return seen.groupBy("source_id", "table_name").agg(F.count(F.lit(1)).alias("row_count"))


def discover(sources: Mapping[str, tuple[str, Mapping[str, DataFrame]]],
             paths: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Every table of every source: source_id -> (source type, tables). A source that cannot
    be read raises; nothing is made up.

    `paths` gives, by source and table, where Parquet tables lie: those are counted in one scan of
    footers, however many they are. Tables without a path are counted in a branch each.
    """
    every = {(sid, name): df for sid, (_, tables) in sources.items() for name, df in tables.items()}
    spark = next(iter(every.values())).sparkSession
    known = spark.createDataFrame(
        [(sid, sources[sid][0], name, len(df.columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))
         for (sid, name), df in every.items()],
        "source_id string, source_type string, table_name string, column_count int, columns string")
    located = {(sid, name): path for sid, named in (paths or {}).items() for name, path in named.items() if (sid, name) in every}
    counts = []
    if located:
        numbered = {str(i): key for i, key in enumerate(located)}
        keys = spark.createDataFrame([(i, *key) for i, key in numbered.items()], "name string, source_id string, table_name string")
        found = file_counts(spark, {i: located[key] for i, key in numbered.items()})
        counts.append(keys.join(F.broadcast(found), "name").select("source_id", "table_name", "row_count"))
    if len(located) < len(every):
        counts.append(_counted({key: df for key, df in every.items() if key not in located}))
    # One row per table.
    return known.join(F.broadcast(reduce(DataFrame.union, counts)), ["source_id", "table_name"], "left").select(
        "source_id", "table_name", F.coalesce("row_count", F.lit(0)).alias("row_count"), "column_count", "columns", "source_type")


def discovery_summary(discovered: DataFrame) -> DataFrame:
    """Per source type: sources, tables and rows."""
    return discovered.groupBy("source_type").agg(
        F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("tables"),
        F.sum("row_count").alias("total_rows"))


def sample(df: DataFrame, n: int = 100, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """The first n rows, or an unbiased share of the rows."""
    return df.limit(n) if fraction is None else df.sample(fraction=fraction, seed=seed)
