"""Projection, filtering, derived columns, ordering, limits and union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import cleaning


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns) if columns else df


def where(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.filter(F.expr(condition) if isinstance(condition, str) else condition)


def derive(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Add or replace columns; every expression sees the input columns."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def cast(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Change column types. A value that does not fit becomes null, or fails when strict."""
    how = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    return df.withColumns({c: how(c, t) for c, t in types.items()})


def cast_failures(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row per column: how many non-null values a cast would lose."""
    lost = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(t).alias("target_type"),
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias("failed_records"),
        )
        for c, t in types.items()
    ]
    return df.agg(F.array(*lost).alias("r")).select(F.inline("r"))


def case_when(df: DataFrame, name: str, branches: Sequence[tuple[str, object]],
              otherwise: object = None) -> DataFrame:
    """`branches` are (condition text, value) pairs, first match wins."""
    (first, value), *rest = branches
    expr = F.when(F.expr(first), F.lit(value))
    for condition, v in rest:
        expr = expr.when(F.expr(condition), F.lit(v))
    return df.withColumn(name, expr.otherwise(F.lit(otherwise)))


def format_columns(df: DataFrame, formats: Mapping[str, object]) -> DataFrame:
    """Dates take a date pattern, numbers a digit count, anything else a printf pattern."""
    out = {}
    for c, fmt in formats.items():
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = cleaning.format_date(c, str(fmt))
        elif isinstance(kind, T.NumericType) and isinstance(fmt, int):
            out[c] = cleaning.format_number(c, fmt)
        else:
            out[c] = cleaning.format_text(c, str(fmt))
    return df.withColumns(out)


def clean(df: DataFrame, steps: Mapping[str, Sequence[str | tuple[str, dict]]]) -> DataFrame:
    """Apply named cleaning templates to many columns in one projection, in the given order."""
    out = {}
    for name, chain in steps.items():
        expr = F.col(name)
        for step in chain:
            template, params = (step, {}) if isinstance(step, str) else step
            expr = cleaning.template(template, column=expr, **params)
        out[name] = expr
    return df.withColumns(out)


_STEP = {"day": "make_dt_interval({n})", "week": "make_dt_interval(7 * {n})",
         "month": "make_ym_interval(0, {n})"}


def keep_last(df: DataFrame, ts: str, n: int, unit: str, until: datetime | str | None = None) -> DataFrame:
    """Rows from the last n days, weeks or months before `until`, or before the newest row.

    A given date is a literal and reaches the file scan; the newest row is a scalar
    subquery, so the table is read for its maximum first and nothing is joined.
    """
    unit = unit.lower().rstrip("s")
    if unit not in _STEP:
        raise ValueError(f"unit must be day, week or month, not {unit!r}")
    step = F.expr(_STEP[unit].format(n=int(n)))
    if until is not None:
        kind = df.schema[ts].dataType
        end = F.lit(until).cast(kind)
        return df.filter((F.col(ts) >= end - step) & (F.col(ts) <= end))
    return df.filter(F.col(ts) >= df.agg((F.max(ts) - step).alias("bound")).scalar())


def ordering(columns: Sequence[str], ascending: bool | Sequence[bool] = True, nulls: str = "last") -> list[Column]:
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    if nulls not in ("first", "last"):
        raise ValueError("nulls must be 'first' or 'last'")
    return [getattr(F.col(c), f"{'asc' if up else 'desc'}_nulls_{nulls}")() for c, up in zip(columns, flags, strict=True)]


def sort(df: DataFrame, columns: Sequence[str], ascending: bool | Sequence[bool] = True,
         nulls: str = "last") -> DataFrame:
    return df.orderBy(*ordering(columns, ascending, nulls))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, k: int, columns: Sequence[str], ascending: bool | Sequence[bool] = False) -> DataFrame:
    """Sort and limit together, which Spark runs as one bounded heap per task."""
    return sort(df, columns, ascending).limit(k)


def union(frames: Sequence[DataFrame], distinct: bool = False, allow_missing: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
    return out.distinct() if distinct else out
