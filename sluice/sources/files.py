"""Loading and saving tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import cut_number

# Formats by file name extension; anything else is CSV.
EXTENSIONS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
_OWN_OPTIONS = {"table_name"}


def detect_format(path: str) -> str:
    return EXTENSIONS.get(PurePosixPath(path).suffix.lower(), "csv")


def load(spark: SparkSession, path: str, file_format: str = "auto", options: Mapping[str, Any] | None = None,
         schema: T.StructType | str | None = None) -> DataFrame:
    """Read CSV (header, types inferred), JSON lines or Parquet. Options go to the reader;
    `table_name` registers the result instead. Give a schema to spare the inference pass."""
    fmt = detect_format(path) if file_format == "auto" else file_format
    if fmt not in EXTENSIONS.values():
        raise ValueError(f"unsupported format {fmt!r}")
    options = dict(options or {})
    defaults = {"header": True, "inferSchema": schema is None} if fmt == "csv" else {}
    reader = spark.read.format(fmt).options(**defaults, **{
        k: v for k, v in options.items() if k not in _OWN_OPTIONS and k not in defaults})
    for key in defaults:
        if key in options:
            reader = reader.option(key, options[key])
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if "table_name" in options:
        register(df, options["table_name"])
    return df


def register(df: DataFrame, name: str | None = None, keep: bool = False) -> str:
    """Make a frame known by name (`table_N` when none is given); `keep` saves it as a table."""
    spark = df.sparkSession
    if name is None:
        taken = {t.name for t in spark.catalog.listTables()}
        name = next(n for n in (f"table_{i}" for i in range(len(taken) + 1)) if n not in taken)
    if keep:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return name


def from_rows(spark: SparkSession, data: Any, schema: T.StructType | str | None = None) -> DataFrame:
    """A frame from a list of dicts, a dict of columns, or a pandas frame."""
    if isinstance(data, Mapping):
        names = list(data)
        data = [dict(zip(names, row)) for row in zip(*data.values(), strict=True)]
    return spark.createDataFrame(data, schema) if schema is not None else spark.createDataFrame(data)


def query(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None,
          tables: Mapping[str, str | DataFrame] | None = None) -> DataFrame:
    """Run SQL. `:name` parameters are bound as typed values; `{name}` or plain table names
    refer to `tables`, given as frames or as paths to load. Plain names are views only while the
    text is resolved; a session view of that name is put back."""
    frames = {n: t if isinstance(t, DataFrame) else load(spark, t) for n, t in (tables or {}).items()}
    used = {n: f for n, f in frames.items() if "{" + n + "}" in text}
    plain = {n: f for n, f in frames.items() if n not in used}
    hidden = {t.name: spark.table(t.name) for n in plain for t in spark.catalog.listTables(pattern=n)
              if t.isTemporary and t.name.lower() == n.lower()}
    try:
        for name, frame in plain.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text, args=dict(args) if args else None, **used)
    finally:
        for name in plain:
            spark.catalog.dropTempView(name)
        for name, frame in hidden.items():
            frame.createOrReplaceTempView(name)


def save(data: DataFrame | str, path: str, file_format: str = "auto", mode: str = "overwrite",
         options: Mapping[str, Any] | None = None, spark: SparkSession | None = None,
         partition_by: Sequence[str] = ()) -> Observation:
    """Write a frame, or a registered table by name. The rows are counted while they are
    written: `save(...).get["rows"]`."""
    df = data if isinstance(data, DataFrame) else (spark or SparkSession.active()).table(data)
    fmt = detect_format(path) if file_format == "auto" else file_format
    if fmt not in EXTENSIONS.values():
        raise ValueError(f"unsupported format {fmt!r}")
    written = Observation()
    defaults = {"header": True} if fmt == "csv" else {}
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    writer = writer.options(**{**defaults, **dict(options or {})})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return written


def optimize_table(spark: SparkSession, table: str, partition_columns: Sequence[str] = ()) -> DataFrame:
    """Cache a table (lazily) and register `{table}_optimized`, partitioned by the columns.
    Columns with few values do not spread; add a second one."""
    spark.catalog.cacheTable(table)
    df = spark.table(table)
    if partition_columns:
        df = df.repartition(*partition_columns)
        df.createOrReplaceTempView(f"{table}_optimized")
    return df


def release(spark: SparkSession, table: str) -> None:
    spark.catalog.uncacheTable(table)
    spark.catalog.dropTempView(f"{table}_optimized")


def lay_out(df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int = 8) -> None:
    """Store for fast lookup on low-cardinality columns: one folder per value, pruned on read.

    Rows are brought together by value first, so a folder has up to `files` files and not one
    from every task; a hot value is spread over as many tasks.
    """
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files)))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def bucket(df: DataFrame, table: str, columns: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Store as a table bucketed and sorted by key columns: joins and groupings on them need
    no shuffle. A task writes one bucket, so there is one file for each."""
    first, *rest = columns
    writer = df.repartition(buckets, *columns).write.mode("overwrite").format("parquet").bucketBy(buckets, first, *rest).sortBy(first, *rest)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


RANK_BITS = 8  # a column's place among the others is one of 2**8


def _sortable(df: DataFrame, column: str) -> Column:
    """A column as something quantiles exist of: text by its first seven bytes, as a number in the same order."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType | T.BinaryType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return c.cast("int") if isinstance(df.schema[column].dataType, T.BooleanType) else c


def cluster(df: DataFrame, path: str, columns: Sequence[str], files: int = 64, lookups: Sequence[str] = ()) -> None:
    """Store for ranges on several columns at once: rows that are near in all of them lie in the same files, so the minima
    and maxima that Parquet keeps rule out most files whichever of the columns a filter names.

    Quantiles turn each column into a rank of RANK_BITS bits, and the bits of all ranks taken in turn are one number (a Z
    curve) that files are ranges of. Ranks follow the data, so a column's skew does not matter, and rows equal in all
    columns are spread over files. Nulls go with the smallest values. At most seven columns. `lookups` get Bloom
    filters, which rule files out for single values.
    """
    columns = list(columns)
    if not 0 < len(columns) <= 7:
        raise ValueError("one to seven columns")
    points = [i / 2 ** RANK_BITS for i in range(1, 2 ** RANK_BITS)]
    found = df.select(*[F.array_distinct(F.percentile_approx(_sortable(df, c), points, 10 * 2 ** RANK_BITS)).alias(f"q{i}")
                        for i, c in enumerate(columns)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    ranked = df.select(row, *[_sortable(df, c).alias(f"v{i}") for i, c in enumerate(columns)],
                       *[F.coalesce(found.select(f"q{i}").scalar(), F.array()).alias(f"q{i}") for i in range(len(columns))])
    ranked = ranked.select("row", *[F.coalesce(cut_number(f"q{i}", F.col(f"v{i}"), len(points)), F.lit(0)).alias(f"r{i}")
                                    for i in range(len(columns))])
    curve = F.lit(0).cast("long")
    for bit in range(RANK_BITS):
        for i in range(len(columns)):
            one = F.shiftright(f"r{i}", bit).bitwiseAND(F.lit(1)).cast("long")
            curve = curve.bitwiseOR(F.shiftleft(one, bit * len(columns) + i))
    placed = ranked.select("row", curve.alias("curve"), F.monotonically_increasing_id().alias("spread"))
    writer = placed.repartitionByRange(files, "curve", "spread").sortWithinPartitions("curve").select(
        *[F.col("row")[c].alias(c) for c in df.columns]).write.mode("overwrite")
    for c in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
