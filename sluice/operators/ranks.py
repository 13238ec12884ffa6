"""Exact values by rank (median, percentiles) without sorting or collecting a group.

Spark's exact `percentile` keeps every distinct value of a group in one buffer, so a hot
group does not fit. Here a quantile sketch of a sample brackets the wanted rank, and one pass
counts the rows below and inside the bracket. When a bracket misses, the counts show it and it
is widened. While a bracket holds more than RANKED_ROWS rows besides its ends, a sketch of
those rows narrows it, so what one task ranks is bounded whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import broadcast_if_small, scratch_path

ACCURACY = 10_000  # of the sketch
SHARE = 1 / 16  # of the rows that go into it
LEVELS = (0.0005, 0.0015, 0.005, 0.015, 0.05)  # half widths of the bracket, as shares of the group
RANKED_ROWS = 200_000  # rows inside a group's bracket that are ranked without narrowing it
STEPS = 1000  # quantiles of the sketch that narrows a bracket


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, fraction: float, ranks: Mapping[str, str],
                  few_groups: bool = False) -> DataFrame:
    """One row per group: the keys, `n` (non-null values) and one column per entry of `ranks`.

    `ranks` maps an output name to a 0-based rank, as an expression over `n`. The ranks must
    lie near `fraction` of the count; if they do not, the result is still right but brackets
    are narrowed more often. Brackets are broadcast while their size is small. `few_groups` is for
    callers that know the number of groups is bounded by their code: the first brackets are then
    broadcast as they are, and not written first to learn their size.

    Three scans of two columns, and two more for each time a bracket is narrowed; only the
    rows inside the brackets are shuffled by value. The larger a group, the narrower its
    bracket: five standard errors of the sample. Sketches and brackets, one row
    per group, are written to the scratch folder, as their sizes decide how to join and whether to go on.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    points = [max(0.0, fraction - w) for w in LEVELS] + [min(1.0, fraction + w) for w in LEVELS]
    need = f"{3 / ACCURACY}D + 2.5D / sqrt(n * {SHARE}D)"

    def side(offset: int, extreme: str) -> str:
        cases = " ".join(f"WHEN {need} <= {w}D THEN _q[{offset + i}]" for i, w in enumerate(LEVELS))
        return f"coalesce(CASE {cases} END, {extreme})"

    sampled = data.selectExpr("*", f"if(rand(11) < {SHARE}D, _v, NULL) AS _s")
    sketch = sampled.groupBy(*keys).agg(
        F.expr("count(1) AS n"), F.expr("min(_v) AS _min"), F.expr("max(_v) AS _max"),
        F.expr(f"percentile_approx(_s, array({', '.join(f'{p}D' for p in points)}), {ACCURACY}) AS _q"))
    named = [f"`{k}`" for k in keys]
    if keys and not few_groups:  # written, so that its size is known and the rows need no shuffle where it is small
        path = scratch_path(df.sparkSession, "sketches")
        sketch.write.parquet(path)
        sketch = df.sparkSession.read.schema(sketch.schema).parquet(path)
    bracket = sketch.selectExpr(*named, "n", "_min", "_max", f"{side(0, '_min')} AS _lo",
                                f"{side(len(LEVELS), '_max')} AS _hi")

    counted = _with_side(data, F.broadcast(bracket) if few_groups else bracket, keys).groupBy(*keys, "n", "_min", "_max", "_lo", "_hi").agg(
        F.expr("count_if(_v < _lo) AS _below"), F.expr("count_if(_v <= _hi) AS _upto"))
    low, high = f"least({', '.join(ranks.values())}, n)", f"greatest({', '.join(ranks.values())}, 0)"
    bounds = counted.selectExpr(
        *named, "n", f"if({low} < _below, _min, _lo) AS _lo", f"if({high} >= _upto, _max, _hi) AS _hi",
        f"if({low} < _below, 0L, _below) AS _before")
    bounds, left = _sized(data, bounds, keys)
    before = left + 1
    while 0 < left < before:  # as long as any large bracket shrinks; ranks that are far apart cannot be brought together
        before = left
        bounds, left = _sized(data, _narrowed(data, bounds, keys, low, high), keys)

    inside = _with_side(data, bounds, keys).filter("_v >= _lo AND _v <= _hi")
    counts = inside.groupBy(*keys, "n", "_before", "_v").agg(F.expr("count(1) AS _c"))
    running = Window.partitionBy(*keys).orderBy("_v")
    ranked = counts.withColumn("_cum", F.col("_before") + F.sum("_c").over(running))
    return ranked.groupBy(*keys, "n").agg(
        *[F.expr(f"min(if(_cum > {at}, _v, NULL)) AS `{name}`") for name, at in ranks.items()])


def _sized(data: DataFrame, bounds: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The brackets with `_between`, the rows strictly inside, and their sum over the brackets that hold too many. Rows
    at the ends are one row per task before they are shuffled, however many they are."""
    path = scratch_path(data.sparkSession, "brackets")
    _with_side(data, bounds, keys).groupBy(*keys, "n", "_lo", "_hi", "_before").agg(
        F.expr("count_if(_v > _lo AND _v < _hi) AS _between")).write.parquet(path)
    sized = data.sparkSession.read.parquet(path)
    return sized, sized.where(F.col("_between") > RANKED_ROWS).agg(F.sum("_between")).first()[0] or 0


def _narrowed(data: DataFrame, bounds: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Brackets of a few of the STEPS quantiles of the rows strictly inside; small ones stay."""
    named = [f"`{k}`" for k in keys]
    large = bounds.filter(F.col("_between") > RANKED_ROWS)
    points = f"CAST(split('{' '.join(str(i / STEPS) for i in range(STEPS + 1))}', ' ') AS array<double>)"
    fields = [*named, "n", "_lo", "_hi", "_before"]
    sketch = _with_side(data, large, keys).groupBy(*keys, "n", "_lo", "_hi", "_before", "_between").agg(
        F.expr(f"percentile_approx(if(_v > _lo AND _v < _hi, _v, NULL), {points}, {ACCURACY}) AS _q"),
        F.expr("count_if(_v = _lo) AS _first"))
    at = "int(floor(({} - _before - _first) * {}D / _between))"
    # A rank before or behind the rows strictly inside is that of an end.
    ends = sketch.selectExpr(
        *fields, f"coalesce(get(_q, {at.format(low, STEPS)} - 2), _lo) AS _a", f"coalesce(get(_q, {at.format(high, STEPS)} + 3), _hi) AS _b")
    counted = _with_side(data, ends, keys).groupBy(*keys, "n", "_lo", "_hi", "_before", "_a", "_b").agg(
        F.expr("count_if(_v >= _lo AND _v < _a) AS _skipped"), F.expr("count_if(_v >= _lo AND _v <= _b) AS _reached"))
    misses = f"{low} < _before + _skipped OR {high} >= _before + _reached"
    closer = counted.selectExpr(
        *named, "n", f"if({misses}, _lo, _a) AS _lo", f"if({misses}, _hi, _b) AS _hi",
        f"if({misses}, _before, _before + _skipped) AS _before")
    small = bounds.filter(F.col("_between") <= RANKED_ROWS).selectExpr(*fields)
    return closer.unionByName(small)


def _with_side(data: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return data.crossJoin(F.broadcast(side))  # one row
    side = side.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = " AND ".join(f"`{k}` <=> `_k_{k}`" for k in keys)
    return data.join(broadcast_if_small(side), F.expr(same)).drop(*[f"_k_{k}" for k in keys])


def _wide(kind: T.DataType) -> str:
    """A type that holds the sum of two values, and half of it, exactly where `kind` is exact."""
    if isinstance(kind, T.DecimalType):
        scale = min(kind.scale + 1, 37)
        return f"decimal({min(38, max(kind.precision - kind.scale + 2 + scale, scale + 1))},{scale})"
    return "decimal(21,1)" if isinstance(kind, T.LongType) else "double"


def median(df: DataFrame, keys: Sequence[str], value: str, alias: str, few_groups: bool = False,
           exact: bool = False) -> DataFrame:
    """Exact median per group (mean of the two middle values), one row per key group that
    has a value.

    The middle values are widened before they are added, so no type overflows. The result is
    a double; with `exact` it is a decimal for bigint and decimal values, where a double could
    not hold it.
    """
    middle = value_at_rank(df, keys, value, 0.5, {"_low": "floor((n - 1) / 2)", "_high": "floor(n / 2)"}, few_groups)
    wide = _wide(df.schema[value].dataType)
    half = f"CAST((CAST(_low AS {wide}) + CAST(_high AS {wide})) / 2 AS {wide})"
    kept = isinstance(df.schema[value].dataType, T.DecimalType) or exact
    return middle.selectExpr(*[f"`{k}`" for k in keys], f"{half if kept else f'CAST({half} AS DOUBLE)'} AS `{alias}`")


def _families(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The columns by the type their values are stacked as, which holds each of them exactly."""
    out: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        name = (f"DECIMAL(38,{kind.scale})" if isinstance(kind, T.DecimalType)
                else "BIGINT" if isinstance(kind, T.IntegralType) else "DOUBLE")
        out.setdefault(name, []).append(c)
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians and distinct counts of many numeric columns: one row (column_name,
    median_value, median_exact, unique_count) each. `median_exact` is the median as text for
    integers and decimals, else null.

    One scan for each kind of number. Values are counted before they are shuffled, dealt out by
    ranges of (column, value) and written; the totals of the ranges, a row for each column and
    partition, say which range holds the middle, and only that one is ranked.
    """
    parts = []
    for kind, chosen in _families(df, columns).items():
        pairs = ", ".join(f"{i}, CAST(`{c}` AS {kind})" for i, c in enumerate(chosen))
        counts = df.selectExpr(f"stack({len(chosen)}, {pairs}) AS (i, v)").filter("v IS NOT NULL").groupBy("i", "v").count()
        path = scratch_path(df.sparkSession, "counts")
        counts.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
        ranged = df.sparkSession.read.parquet(path)

        totals = ranged.groupBy("i", "part").agg(F.sum("count").alias("own"), F.count("*").alias("values"))
        column = Window.partitionBy("i")
        upto = column.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = totals.select(
            "i", "part", "own", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("before"),
            F.sum("own").over(column).alias("n"), F.sum("values").over(column).alias("unique_count"))
        middle = placed.filter("floor((n - 1) / 2) < before + own AND floor(n / 2) >= before")
        # At most two ranges for each column.
        inside = ranged.join(F.broadcast(middle), ["i", "part"])
        upto = Window.partitionBy("i", "part").orderBy("v")
        ranked = inside.withColumn("cum", F.col("before") + F.sum("count").over(upto))
        found = ranked.groupBy("i", "unique_count").agg(
            F.expr("min(if(cum > floor((n - 1) / 2), v, NULL)) AS low"), F.expr("min(if(cum > floor(n / 2), v, NULL)) AS high"))
        wide = _wide(df.sparkSession.range(0).selectExpr(f"CAST(NULL AS {kind}) AS v").schema["v"].dataType)
        half = F.expr(f"CAST((CAST(low AS {wide}) + CAST(high AS {wide})) / 2 AS {wide})")
        text = F.lit(None).cast("string") if kind == "DOUBLE" else plain_text(half)
        names = F.array(*[F.lit(c) for c in chosen])
        parts.append(found.select(names[F.col("i")].alias("column_name"), half.cast("double").alias("median_value"),
                                  text.alias("median_exact"), "unique_count"))
    return reduce(DataFrame.unionByName, parts)


def plain_text(number: Column) -> Column:
    """An integer or decimal as text without zeros behind the point."""
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percentile: float, alias: str,
                 few_groups: bool = False) -> DataFrame:
    """The sorted value at 0-based index `min(int(n * p / 100), n - 1)`.

    For 1..100 and p = 95 this is 96, one rank above `percentile_disc`.
    """
    at = {alias: f"least(floor(n * {percentile}D / 100), n - 1)"}
    return value_at_rank(df, keys, value, percentile / 100, at, few_groups).drop("n")
