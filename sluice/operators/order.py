"""An order over one or two columns as one number, which a hash aggregate can hold.

`max_by(value, struct(ts, id))` makes Spark sort the whole input, since a struct does not fit the
fixed-width buffers of a hash aggregate. A decimal does.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOWEST = Decimal(-9_300_000_000_000_000_000)  # below every bigint: the place of null
_WIDTH = Decimal(10) ** 19                     # more than twice that


def whole_number(column: str, kind: T.DataType) -> Column | None:
    """A time or integer as an integer in the same order; None for a column of another type."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return c
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), c)
    return None


def order_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """What to order by: one decimal where the columns are at most two times or integers, else a
    struct. Nulls come first."""
    parts = [whole_number(c, df.schema[c].dataType) for c in columns]
    if len(parts) > 2 or any(p is None for p in parts):
        return F.struct(*[F.col(f"`{c}`") for c in columns])
    wide = [F.coalesce(p.cast("decimal(38,0)"), F.lit(_LOWEST).cast("decimal(38,0)")) for p in parts]
    if len(wide) == 1:
        return wide[0]
    # 10**19 times a bigint, plus a bigint, has 38 digits.
    return (wide[0].cast("decimal(19,0)") * F.lit(_WIDTH).cast("decimal(20,0)") + wide[1].cast("decimal(19,0)")).cast("decimal(38,0)")


def cut_number(cuts: str, value: Column, most: int) -> Column:
    """How many of the ascending values in the array column `cuts`, which are at most `most`, are not above a value: halved
    until it is found, so a lookup takes as many comparisons as `most` has bits. Null for null."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(1, most.bit_length())))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0))
    return F.when(value.isNotNull(), found)
