"""Grouped and global aggregation, pivot, unpivot and daily summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import order_of
from sluice.operators.ranks import median

# The function names a caller may use and the name each one stands for.
FUNCTIONS = {
    "sum": "sum", "avg": "avg", "mean": "avg", "count": "count", "min": "min", "max": "max",
    "count_distinct": "count_distinct", "nunique": "count_distinct",
    "approx_count_distinct": "approx_count_distinct",
    "std": "stddev_samp", "stddev": "stddev_samp", "stddev_samp": "stddev_samp",
    "var": "var_samp", "variance": "var_samp", "var_samp": "var_samp",
    "median": "median", "first": "first", "last": "last",
}
_NUMBERS_ONLY = {"sum", "avg", "stddev_samp", "var_samp", "median"}


def resolve_function(name: str) -> str:
    found = FUNCTIONS.get(name.lower())
    if found is None:
        raise ValueError(f"unknown aggregate function {name!r}; one of {sorted(FUNCTIONS)}")
    return found


def aggregate_column(name: str, column: str | Column, order: Sequence[str] = (), df: DataFrame | None = None) -> Column:
    """The aggregate expression for a function name (all but `median`). With `df`, whose types it
    looks at, first and last need no sort where the order is of times or integers."""
    fn = resolve_function(name)
    c = F.col(column) if isinstance(column, str) else column
    if fn in ("first", "last"):
        if not order:
            raise ValueError(f"{fn} needs an order column to be repeatable")
        by = F.struct(*[F.col(o) for o in order]) if df is None else order_of(df, order)
        return F.min_by(c, by) if fn == "first" else F.max_by(c, by)
    if fn == "median":
        raise ValueError("median is not a plain expression here; use aggregate()")
    return getattr(F, fn)(c)


def aggregate(df: DataFrame, columns: Sequence[str] = (), function: str | None = None,
              group_by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One function over some columns. Without columns: the row count as `total_count`.
    Without keys: one global row. Null keys form a group."""
    if not columns:
        if function is not None and resolve_function(function) != "count":
            raise ValueError(f"{function} needs columns")
        return df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("total_count"))
    return multi_aggregate(df, [(c, function or "sum") for c in columns], group_by, order)


def multi_aggregate(df: DataFrame, measures: Sequence[tuple[str, str]], group_by: Sequence[str] = (),
                    order: Sequence[str] = ()) -> DataFrame:
    """Several (column, function) pairs in one pass, named `{column}_{function}`; keys first.
    The column `*` with `count` is `total_count`."""
    keys, plain, medians, names = list(group_by), [], [], []
    for column, name in measures:
        fn = resolve_function(name)
        alias = "total_count" if column == "*" else f"{column}_{name.lower()}"
        names.append(alias)
        if column == "*":
            if fn != "count":
                raise ValueError(f"{name} needs a column")
            plain.append(F.count(F.lit(1)).alias(alias))
            continue
        if fn in _NUMBERS_ONLY and not isinstance(df.schema[column].dataType, T.NumericType):
            raise ValueError(f"{name} needs a number; {column} is {df.schema[column].dataType.simpleString()}")
        if fn == "median":
            medians.append((column, alias))
        else:
            plain.append(aggregate_column(fn, column, order, df).alias(alias))
    out = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    for column, alias in medians:
        out = _join_groups(out, median(df, keys, column, alias), keys)
    return out.select(*keys, *names)


def _join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on group keys, where null keys are equal."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), "left")  # one row
    side = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(side, same, "left").drop(*[f"_k_{k}" for k in keys])


def group_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct key groups."""
    return df.select(*keys).distinct()


def pivot(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[object],
          measures: Mapping[str, str]) -> DataFrame:
    """Spread `on` over columns. The values are given, so no extra job looks for them."""
    aggs = [aggregate_column(fn, c).alias(f"{c}_{fn}") for c, fn in measures.items()]
    out = df.groupBy(*keys).pivot(on, list(values)).agg(*aggs)
    if len(aggs) == 1:  # Spark names the columns after the values alone
        ((c, fn),) = measures.items()
        out = out.withColumnsRenamed({str(v): f"{v}_{c}_{fn}" for v in values})
    return out


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def daily_summary(df: DataFrame, ts: str, measures: Sequence[tuple[str, str]],
                  group_by: Sequence[str] = ()) -> DataFrame:
    """Aggregates per calendar day (column `day`) and further keys."""
    return multi_aggregate(df.withColumn("day", F.to_date(ts)), measures, ["day", *group_by])
