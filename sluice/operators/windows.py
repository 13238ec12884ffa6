"""Window functions, with a split form for partitions too big for one task.

A plain window sorts each partition in one task. When one partition may hold a large
share of the table, pass `bucket="auto"`: rows are dealt out by ranges of partition columns, order
columns and a hash of the row, whose bounds follow the data, so their number per task is the
same at any size, also where many rows are equal in all order columns. Rank and row number are
then read off the places of rows in sorted files. Running values are the same for all rows that
are equal in partition and order columns, so these are first added up to one row each. Lag and
lead window each range on its own. `bucket` may also be an expression that never decreases along
the first order column (a day of a timestamp, a block of an id): each bucket is then windowed on
its own, and the small table of bucket totals supplies what came before it.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sluice.operators.aggregates import aggregate_column
from sluice.session import broadcast_if_small, scratch_path, written

RANKING = ("row_number", "rank")
SHIFTING = ("lag", "lead")
RUNNING = ("sum", "count", "min", "max")
ROWS_PER_RANGE = 1_000_000  # that one task sorts


def _order(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]


def window_spec(partition: Sequence[str], order: Sequence[str] = (), descending: bool = False,
                frame: tuple[str, int | None, int | None] | None = None) -> WindowSpec:
    """`frame` is ("rows" or "range", start, end); None as a bound means unbounded."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*_order(order, descending))
    if frame:
        kind, start, end = frame
        start = Window.unboundedPreceding if start is None else start
        end = Window.unboundedFollowing if end is None else end
        spec = spec.rowsBetween(start, end) if kind == "rows" else spec.rangeBetween(start, end)
    return spec


def window_column(fn: str, column: str | None = None, partition: Sequence[str] | str = (),
                  order: Sequence[str] | str = (), offset: int = 1, descending: bool = False,
                  frame: tuple[str, int | None, int | None] | None = None) -> Column:
    partition = [partition] if isinstance(partition, str) else list(partition)
    order = [order] if isinstance(order, str) else list(order)
    spec = window_spec(partition, order, descending, frame)
    if fn in RANKING + SHIFTING and not order:
        raise ValueError(f"{fn} needs an order")
    if fn in RANKING:
        return getattr(F, fn)().over(spec)
    if fn in SHIFTING:
        return getattr(F, fn)(column, offset).over(spec)
    return aggregate_column(fn, column).over(spec)


def window(df: DataFrame, fn: str, alias: str, column: str | None = None, partition: Sequence[str] = (),
           order: Sequence[str] = (), offset: int = 1, descending: bool = False,
           frame: tuple[str, int | None, int | None] | None = None, bucket: Column | str | None = None,
           few_groups: bool = False) -> DataFrame:
    """Add a window column. Ties in `order` need a tie-breaker, or results are not repeatable.

    A window without partition is split by the data where its function can be; where it cannot,
    a warning says that one task sorts the whole table. `few_groups` is for callers who know that
    the number of partitions is bounded (a status, a flag): totals over whole partitions are then
    broadcast if their size is small, and the rows are not shuffled.
    """
    if bucket is None and order and not partition:
        if frame is None and fn in RANKING + SHIFTING + RUNNING:
            bucket = "auto"
        else:
            warnings.warn(f"{fn} without partition: one task sorts the whole table", stacklevel=2)
    if isinstance(bucket, str) and bucket == "auto":
        if not order:
            raise ValueError("buckets follow an order")
        if frame is not None:
            raise ValueError("a bucketed window takes the default frame")
        return _by_ranges(df, fn, alias, column, list(partition), list(order), offset, descending)
    if isinstance(bucket, str):
        bucket = F.expr(bucket)
    if bucket is not None and order:
        if frame is not None:
            raise ValueError("a bucketed window takes the default frame")
        return _split_window(df, fn, alias, column, list(partition), list(order), offset, descending, bucket)
    if not order and fn not in RANKING + SHIFTING and frame is None:
        return _whole_partition(df, fn, alias, column, list(partition), few_groups)
    return df.withColumn(alias, window_column(fn, column, partition, order, offset, descending, frame))


def _key(keys: Sequence[str]) -> Column:
    """Columns as one key. Structs with equal nulls are equal, so null keys meet in a join."""
    return F.struct(*keys)


def _whole_partition(df: DataFrame, fn: str, alias: str, column: str | None, partition: list[str],
                     few_groups: bool) -> DataFrame:
    """An aggregate over the whole partition: combined before the shuffle and joined back,
    so no task holds a partition."""
    totals = df.groupBy(*partition).agg(aggregate_column(fn, column).alias(alias))
    if not partition:
        return df.crossJoin(F.broadcast(totals))  # one row
    if few_groups:
        totals = written(totals, "totals")
    side = totals.select(_key(partition).alias("_g"), alias)
    return df.withColumn("_g", _key(partition)).join(broadcast_if_small(side) if few_groups else side, "_g", "left").drop("_g")


def _by_ranges(df: DataFrame, fn: str, alias: str, column: str | None, partition: list[str], order: list[str], offset: int,
               descending: bool) -> DataFrame:
    """Rows equal in all order columns are taken in the order of a hash of the row, so only rows equal
    in all columns share a range."""
    if fn in RUNNING:
        return _by_value(df, fn, alias, column, partition, order, descending)
    if fn not in RANKING + SHIFTING:
        raise ValueError(f"{fn} has no bucketed form")
    df = df.withColumn("_tie", _row_hash(df))
    if fn in RANKING:
        return _by_place(df, fn, alias, partition, order, descending)
    out = _split_window(_ranged(df, partition, [*order, "_tie"], descending), fn, alias, column, partition, [*order, "_tie"],
                        offset, descending, F.col("_range"))
    return out.drop("_range", "_tie")


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash (maps it cannot)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def _ranged(df: DataFrame, partition: list[str], order: list[str], descending: bool, ordered: bool = False) -> DataFrame:
    """The rows, written, with `_range`, which never decreases along the order within a partition. Rows
    that are equal in all of these columns have the same range. `ordered` sorts the rows of a file. The
    rows are counted, so that a range has as many at any number of shuffle partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    along = [*[F.col(p) for p in partition], *_order(order, descending)]
    ranges = -(-df.count() // ROWS_PER_RANGE)
    # Where the shuffle partitions are enough, Spark joins small ones; a stated number it keeps.
    few = ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(*along) if few else df.repartitionByRange(ranges, *along)
    if ordered:
        dealt = dealt.sortWithinPartitions(*along)
    number = F.spark_partition_id()
    dealt = dealt.withColumn("_range", -number if descending else number)
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _by_place(df: DataFrame, fn: str, alias: str, partition: list[str], order: list[str], descending: bool) -> DataFrame:
    """Rank and row number from the place of a row among all rows: rows in the files before its file, and
    its place in the file. The row number counts from the first place of its partition, the rank is
    that of the first row with its order values. One row per file is broadcast: a file is what one
    task of the exchange wrote."""
    files = _ranged(df, partition, [*order, "_tie"], descending, ordered=True)
    files = files.select("*", F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_name").alias("_file"))
    earlier = Window.orderBy(F.abs("_range"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("_range", "_file").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", "_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = files.join(F.broadcast(before), ["_range", "_file"]).withColumn("_at", F.col("_before") + F.col("_row")).drop(
        "_range", "_file", "_row", "_before", "_tie")
    number = F.col("_at") + 1
    # First places are written, so that their size is known: few are broadcast, and no task reads all rows of a value.
    if fn == "rank":
        keys = list(dict.fromkeys([*partition, *order]))
        firsts = written(placed.groupBy(*keys).agg(F.min("_at").alias("_first")), "firsts")
        placed = placed.withColumn("_g", _key(keys)).join(broadcast_if_small(firsts.select(_key(keys).alias("_g"), "_first")), "_g")
        number = F.col("_first") + 1
        starts = firsts.groupBy(*partition).agg(F.min("_first").alias("_start"))
    else:
        starts = placed.groupBy(*partition).agg(F.min("_at").alias("_start"))
    if partition:
        side = written(starts, "starts").select(_key(partition).alias("_p"), "_start")
        placed = placed.withColumn("_p", _key(partition)).join(broadcast_if_small(side), "_p")
        number = number - F.col("_start")
    return placed.withColumn(alias, number.cast("int")).drop("_g", "_p", "_at", "_start", "_first")


def _by_value(df: DataFrame, fn: str, alias: str, column: str | None, partition: list[str], order: list[str],
              descending: bool) -> DataFrame:
    """A running value, from totals of the rows that are equal in partition and order columns. The frame is
    read twice, so it must give the same rows again."""
    keys = list(dict.fromkeys([*partition, *order]))
    totals = df.groupBy(*keys).agg(aggregate_column(fn, column).alias("_total_here"))
    run = _split_window(_ranged(totals, partition, order, descending), "sum" if fn == "count" else fn, "_run", "_total_here",
                        partition, order, 1, descending, F.col("_range"))
    run = written(run.select(*keys, F.col("_run").cast(totals.schema["_total_here"].dataType).alias("_run")), "running")
    side = broadcast_if_small(run.select(_key(keys).alias("_g"), "_run"))
    return df.withColumn("_g", _key(keys)).join(side, "_g", "left").withColumn(alias, F.col("_run")).drop("_g", "_run")


def _split_window(df: DataFrame, fn: str, alias: str, column: str | None, partition: list[str],
                  order: list[str], offset: int, descending: bool, bucket: Column) -> DataFrame:
    if fn == "lead":  # the same as lag in the opposite order
        return _split_lag(df, alias, column, partition, order, offset, not descending, bucket, True)
    if fn == "lag":
        return _split_lag(df, alias, column, partition, order, offset, descending, bucket, False)
    if fn not in RANKING + RUNNING:
        raise ValueError(f"{fn} has no bucketed form")

    # One key column serves the local window, the totals and the join, so the rows are
    # shuffled once.
    df = df.withColumn("_bucket", bucket).withColumn("_g", _key([*partition, "_bucket"])).drop("_bucket")
    local = window_spec(["_g"], order, descending)
    earlier = _bucket_order(partition, descending).rowsBetween(Window.unboundedPreceding, -1)
    if fn in RANKING:
        totals = df.groupBy("_g").agg(F.count(F.lit(1)).alias("_total"))
        here, before = getattr(F, fn)().over(local), F.sum("_total").over(earlier)
    else:
        totals = df.groupBy("_g").agg(aggregate_column(fn, column).alias("_total"))
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[fn]
        here, before = aggregate_column(fn, column).over(local), merge("_total").over(earlier)
    out = df.withColumn("_here", here).join(totals.select("_g", before.alias("_before")), "_g", "left")
    if fn in ("min", "max"):
        value = (F.least if fn == "min" else F.greatest)("_here", "_before")  # both skip nulls
    elif fn == "sum":  # null until the first non-null value
        value = F.when(F.col("_here").isNull(), F.col("_before")).otherwise(
            F.col("_here") + F.coalesce(F.col("_before"), F.lit(0)))
    else:
        value = (F.col("_here") + F.coalesce(F.col("_before"), F.lit(0))).cast("int" if fn in RANKING else "long")
    return out.withColumn(alias, value).drop("_g", "_here", "_before")


def _bucket_order(partition: list[str], descending: bool) -> WindowSpec:
    """Buckets of a partition in order, from the key column."""
    b = F.col("_g._bucket")
    spec = Window.partitionBy(*[F.col(f"_g.`{p}`") for p in partition])
    return spec.orderBy(b.desc_nulls_last() if descending else b.asc_nulls_last())


def _split_lag(df: DataFrame, alias: str, column: str, partition: list[str], order: list[str], offset: int,
               descending: bool, bucket: Column, nulls_first: bool) -> DataFrame:
    """Only the first `offset` rows of a bucket look across its edge. What they look for is among
    the last `offset` rows of each of as many earlier buckets, which the bucket totals carry."""
    def ordered(c: Column, down: bool, first: bool) -> Column:
        return getattr(c, f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")()

    df = df.withColumn("_bucket", bucket).withColumn("_g", _key([*partition, "_bucket"])).drop("_bucket")
    group = Window.partitionBy("_g")
    forward = group.orderBy(*[ordered(F.col(c), descending, nulls_first) for c in order])
    backward = group.orderBy(*[ordered(F.col(c), not descending, not nulls_first) for c in order])
    across = Window.partitionBy(*[F.col(f"_g.`{p}`") for p in partition]).orderBy(
        ordered(F.col("_g._bucket"), descending, nulls_first)).rowsBetween(-offset, -1)
    # Nearest row first: at most `offset` values of a bucket, and `offset` buckets.
    last = df.select("_g", F.row_number().over(backward).alias("_back"), F.col(column).alias("_value")).filter(
        F.col("_back") <= offset).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_back", "_value"))).alias("_last"))
    carried = last.select("_g", F.slice(F.flatten(F.reverse(F.collect_list("_last").over(across))), 1, offset).alias("_carried"))
    placed = df.withColumn("_pos", F.row_number().over(forward)).withColumn("_here", F.lag(column, offset).over(forward))
    across_edge = F.get("_carried", F.lit(offset) - F.col("_pos"))["_value"]
    return placed.join(carried, "_g", "left").withColumn(
        alias, F.when(F.col("_pos") > offset, F.col("_here")).otherwise(across_edge)).drop("_g", "_pos", "_here", "_carried")
