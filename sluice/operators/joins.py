"""Joins by shared columns, by a condition over the aliases `l` and `r`, or by a range.

A condition without an equality makes Spark compare every row with every row. Where it says that a value
of the left side lies in a range given by the right side, `range_join` turns it into an equality of
cell numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.order import cut_number
from sluice.session import broadcast_if_small, written

# The names a join type goes by.
JOIN_TYPES = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right",
    "full": "full", "outer": "full", "full_outer": "full", "left_semi": "left_semi", "semi": "left_semi",
    "left_anti": "left_anti", "anti": "left_anti", "cross": "cross",
}


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | str | Column | None = None, how: str = "inner",
         suffix: str = "_right", small: str | None = None, skewed: bool = False) -> DataFrame:
    """Join two frames.

    `on` is a list of shared key columns, or a condition (text or Column) over `l.` and `r.`.
    Keys appear once; other columns both sides share get `suffix` on the right side.
    `small` ("left"/"right") allows a broadcast of that side, if its size estimate permits.
    A skewed key is left to AQE, which splits the hot partition; it cannot in a full join, so
    `skewed` makes that a left join plus the unmatched right rows, at the price of reading both
    sides twice.
    """
    how = JOIN_TYPES.get(how.lower())
    if how is None:
        raise ValueError(f"join type must be one of {sorted(JOIN_TYPES)}")
    if small not in (None, "left", "right"):
        raise ValueError("small must be 'left' or 'right'")
    keys = list(on) if isinstance(on, (list, tuple)) else []
    if how == "cross" and on is None:
        condition = F.lit(True)
    elif on is None:
        raise ValueError("a join needs key columns or a condition")

    if how not in ("left_semi", "left_anti"):
        taken = {c.lower() for c in left.columns}
        lowered_keys = {k.lower() for k in keys}
        clash = {c: c + suffix for c in right.columns if c.lower() in taken and c.lower() not in lowered_keys}
        # A condition names columns before the suffix is added, so rename after the join.
        if keys and clash:
            right = right.withColumnsRenamed(clash)
    else:
        clash = {}

    l, r = left.alias("l"), right.alias("r")
    if small == "right":
        r = broadcast_if_small(r)
    if small == "left":
        l = broadcast_if_small(l)

    if keys:
        if how == "full" and skewed:
            return _full(left, right, keys)
        return l.join(r, keys, how)
    if on is not None:
        condition = F.expr(on) if isinstance(on, str) else on
    out = l.join(r, condition, "inner" if how == "cross" else how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select(
        *[F.col(f"l.`{c}`") for c in left.columns],
        *[F.col(f"r.`{c}`").alias(clash.get(c, c)) for c in right.columns],
    )


def _full(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full join as left join plus the unmatched right rows.

    AQE cannot split a hot partition of a full outer join; it can split the left join and
    the anti join.
    """
    matched = left.join(right, keys, "left")
    only_right = right.join(left.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(only_right, allowMissingColumns=True)


BUCKETS_PER_PARTITION = 4
MOST_BUCKETS = 1024
ROWS_PER_CELL = 256  # of both sides together, on average
MOST_CELLS = 1023    # that a bucket is cut into
MOST_COPIES = 8      # of a range, on average, for which buckets are cut into cells


def range_join(left: DataFrame, right: DataFrame, value: str, low: str | None = None, high: str | None = None,
               low_open: bool = False, high_open: bool = False, how: str = "inner", condition: str | None = None,
               suffix: str = "_right", buckets: int | None = None) -> DataFrame:
    """Rows of `left` whose `value` lies between `low` and `high` of a row of `right`.

    `value` is an expression over `l`, `low` and `high` are expressions over `r`; one of the two may be left out, for a
    comparison such as `l.a > r.b`. A bound belongs to the range unless it is `open`. `condition` (over `l` and `r`) must
    hold as well. Nulls are in no range. Join types: inner, left, left_semi, left_anti.

    Quantiles of the values and bounds of both sides cut them into buckets of about equal size, and quantiles inside each
    bucket into cells of about ROWS_PER_CELL rows, so rows that meet stay few however large the tables are. A left row is
    in one cell, a right row is repeated in each cell that its range meets, so both sides meet by an equi-join, each pair
    once, and the exact comparison follows. Ranges beyond all values of the left side are left out. A range that covers
    many cells pairs with all the left rows in between; where ranges are wide, buckets are cut into fewer cells or none,
    so that copies stay few. A value held by a third of the rows makes one large cell, which skew handling splits. The
    number of buckets follows the session's shuffle partitions. The cuts are written to the scratch folder.
    """
    how = JOIN_TYPES.get(how.lower())
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a range join is inner, left, left_semi or left_anti; swap the sides for others")
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    placed, ranges = _in_cells(left.alias("l"), right.alias("r"), value, low, high, buckets)
    holds = placed["_bucket"] == ranges["_bucket"]
    if low is not None:
        holds &= (F.col("_v") > F.col("_low")) if low_open else (F.col("_v") >= F.col("_low"))
    if high is not None:
        holds &= (F.col("_v") < F.col("_high")) if high_open else (F.col("_v") <= F.col("_high"))
    if condition is not None:
        holds &= F.expr(condition)
    out = placed.join(ranges, holds, how)
    ours = [F.col("l")[c].alias(c) for c in left.columns]
    if how in ("left_semi", "left_anti"):
        return out.select(*ours)
    taken = {c.lower() for c in left.columns}
    return out.select(*ours, *[F.col("r")[c].alias(c + suffix if c.lower() in taken else c) for c in right.columns])


def _in_cells(l: DataFrame, r: DataFrame, value: str, low: str | None, high: str | None, buckets: int | None
              ) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of a cell: rows of `l` once, as (l, _v, _bucket), rows of `r` in each cell that their
    range meets, as (r, _low, _high, _bucket)."""
    if buckets is None:
        buckets = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = l.select(F.expr(value).alias("_v"))
    kind = values.schema["_v"].dataType.simpleString()
    places = values.select("_v", F.lit(True).alias("_ours")).unionAll(
        r.select(F.expr(f"try_cast({high if low is None else low} AS {kind})").alias("_v"), F.lit(False)))
    places = places.filter("_v IS NOT NULL")
    ours = F.when(F.col("_ours"), F.col("_v"))
    known = written(places.agg(
        F.coalesce(*([_quantiles("_v", buckets)] if buckets > 1 else []), F.array().cast(f"array<{kind}>")).alias("_cuts"),
        F.min(ours).alias("_least"), F.max(ours).alias("_most"), F.count(F.lit(1)).alias("_rows")), "cuts")

    def with_bucket(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.withColumn("_cuts", known.select("_cuts").scalar()).withColumn(
            name, cut_number("_cuts", F.col(of), buckets - 1)).drop("_cuts")

    placed = with_bucket(l.select(F.struct("l.*").alias("l"), F.expr(value).alias("_v")), "_v", "_bucket")
    ranges = r.select(F.struct("r.*").alias("r"),
                      *(F.expr(e).alias(n) for n, e in (("_low", low), ("_high", high)) if e is not None))
    if low is not None:
        ranges = with_bucket(ranges.filter(F.col("_low") <= known.select("_most").scalar()), "_low", "_first")
    if high is not None:
        ranges = with_bucket(ranges.filter(F.col("_high") >= known.select("_least").scalar()), "_high", "_last")
    first = F.lit(0) if low is None else F.col("_first")
    last = known.select(F.size("_cuts")).scalar() if high is None else F.col("_last")
    cells = int(min(MOST_CELLS, known.first()["_rows"] / buckets / ROWS_PER_CELL))
    if cells > 1:
        crossed = ranges.agg(F.avg(F.greatest(last - first, F.lit(0)))).first()[0] or 0.0
        cells = int(min(cells, MOST_COPIES / max(crossed, 1e-9)))
    if cells > 1:
        inner = written(with_bucket(places, "_v", "_bucket").groupBy("_bucket").agg(_quantiles("_v", cells).alias("_inner")), "cuts")

        def with_cell(df: DataFrame, of: str, name: str) -> DataFrame:
            side = F.broadcast(inner.withColumnRenamed("_bucket", name))  # a row for each bucket
            within = F.coalesce(cut_number("_inner", F.col(of), cells - 1), F.lit(0))
            return df.join(side, name, "left").withColumn(name, F.col(name) * cells + within).drop("_inner")

        placed = with_cell(placed, "_v", "_bucket")
        if low is not None:
            ranges = with_cell(ranges, "_low", "_first")
        if high is not None:
            ranges = with_cell(ranges, "_high", "_last")
        last = (last + 1) * cells - 1 if high is None else last
    met = F.explode(F.when(first <= last, F.sequence(first, last)))
    return placed, ranges.withColumn("_bucket", met).drop("_first", "_last")


def _quantiles(column: str, parts: int) -> Column:
    """The different ones of the values that cut a column into so many parts, two or more, of about equal size; null where
    there are none."""
    return F.array_distinct(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts))
