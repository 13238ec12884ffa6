"""Removal of repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import whole_number
from sluice.quality.rules import value_key


_LEAST = -(1 << 63)  # where nulls stand among integers


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by `order`, then by every remaining column; nulls come first.

    The column that decides first (a time or an integer) and a digest of the row are all that hash aggregates need to find
    the smallest per key, combined before the shuffle; the rows that have it are found by a hash join, and copies of a row
    collapse. Nothing is sorted. Both the aggregate and the join spread the rows of a key by that column, so a key held by a
    third of the rows does not meet in one task, and a join that is still skewed is split. The smallest and the largest digest tell
    whether different rows tie; only the rows of such ties are compared as a whole. Text keys are grouped and joined as
    digests where they are long.

    Where another type decides first, all rows are compared as a whole: a minimum of structs, for which Spark sorts the
    rows of each task by key.
    """
    keys = list(keys)
    order = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order + rest:
        return df.select(*keys).distinct().select(*df.columns)
    named = [value_key(df, c).alias(f"k{i}") if isinstance(df.schema[c].dataType, T.StringType | T.BinaryType)
             else F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]
    group = F.struct(*named).alias("_group")  # structs with equal nulls are equal, so null keys meet in a join
    columns = [*order, *rest, *keys]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    number = whole_number(columns[0], df.schema[columns[0]].dataType)
    if number is None:
        return _smallest(df.select(group, row)).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])

    place = F.coalesce(number.cast("long"), F.lit(_LEAST)).alias("_place")
    marked = df.select(group, place, F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_digest"), row)
    places = marked.groupBy("_group", "_place").agg(F.min("_digest").alias("low"), F.max("_digest").alias("high"))
    best = places.groupBy("_group").agg(F.min("_place").alias("_place"), F.min_by("low", "_place").alias("low"),
                                        F.min_by("high", "_place").alias("high"))

    def first_rows(groups: DataFrame, digest: Column) -> DataFrame:
        side = groups.withColumnsRenamed({"_group": "g", "_place": "p"}).hint("shuffle_hash")
        at = (F.col("_group") == F.col("g")) & (F.col("_place") == F.col("p"))
        return marked.join(side, at & digest, "left_semi").select("_group", "_place", "_row")

    # Both take the same columns of the rows, so these are shuffled once.
    alone = first_rows(best.where("low = high"), F.col("_digest") == F.col("low"))
    ties = first_rows(best.where("low <> high"), F.col("_digest") >= F.col("low")).select("_group", "_row")
    found = alone.distinct().select("_row").union(_smallest(ties))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def _smallest(rows: DataFrame) -> DataFrame:
    """The smallest `_row` of each `_group`."""
    return rows.groupBy("_group").agg(F.min("_row").alias("_row")).select("_row")
