"""Applying a mapping to data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import cleaning
from sluice.mapping.types import spark_type


@dataclass(frozen=True)
class TargetColumn:
    """A column of the target table; `source` is the matched source column, if any."""

    name: str
    data_type: str = "string"
    source: str | None = None
    nullable: bool = True
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    default: object = None


def apply_mapping(df: DataFrame, columns: Sequence[TargetColumn], strict: bool = False) -> DataFrame:
    """One projection: rename, cast, cut to length, fill nulls, add missing columns as null
    (or their default)."""
    out = []
    for c in columns:
        kind = spark_type(c.data_type, c.precision, c.scale)
        if c.source is None:
            out.append(F.lit(c.default).cast(kind).alias(c.name))
            continue
        expr = F.col(c.source).cast(kind) if strict else F.col(c.source).try_cast(kind)
        if c.max_length is not None and kind == "string":
            expr = cleaning.truncate(expr, c.max_length)
        if c.default is not None and not c.nullable:
            expr = F.coalesce(expr, F.lit(c.default).cast(kind))
        out.append(expr.alias(c.name))
    return df.select(*out)


def truncated_rows(df: DataFrame, columns: Sequence[TargetColumn]) -> DataFrame:
    """One row per length-limited column: how many values would be cut."""
    limited = [c for c in columns if c.source is not None and c.max_length is not None]
    counts = [F.struct(F.lit(c.name).alias("column_name"), F.lit(c.max_length).alias("max_length"),
                       F.count_if(cleaning.is_truncated(F.col(c.source).cast("string"), c.max_length))
                       .alias("truncated_records"))
              for c in limited]
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def from_match(mapped: DataFrame, defaults: Mapping[str, object] | None = None) -> list[TargetColumn]:
    """Target columns of one table pair's mapping. One row per column of a schema, so it may
    come to the driver."""
    rows = mapped.select("t.*", F.col("s.column_name").alias("source")).orderBy("ordinal_position").collect()
    defaults = defaults or {}
    return [TargetColumn(r.column_name, r.data_type, r.source, r.nullable, r.max_length, r.precision, r.scale,
                         defaults.get(r.column_name)) for r in rows]
