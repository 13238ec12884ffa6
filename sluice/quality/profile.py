"""Column profiles and the rules they suggest."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.cleaning import EMAIL
from sluice.operators.ranks import medians, plain_text
from sluice.quality.rules import Rule, group_key

# Text shapes a suggested validity rule may ask for.
KNOWN_PATTERNS = {
    "email": EMAIL,
    "iso_date": r"\d{4}-\d{2}-\d{2}$",
    "phone": r"\+?[0-9][0-9 ()\-]{7,}$",
    "url": r"https?://\S+$",
    "code": r"[A-Za-z]+#\d+$",
    "integer": r"[+\-]?\d+$",
}


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: total, nulls, distinct non-null values, type, and for numbers
    min, max, mean, median and sample standard deviation (0 for a single value).

    min_exact, max_exact and median_exact are text for integers and decimals, which a double
    may round. One wide aggregate gives all but the distinct counts and medians; these come
    from one scan for each kind of number, and one grouping for each other column.
    `approximate` keeps it to the one wide pass, with median_exact null.
    """
    fields = df.schema.fields
    rows = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        null = F.lit(None).cast("double")
        number = _is_number(f.dataType)
        exact = isinstance(f.dataType, T.IntegralType | T.DecimalType)
        nothing = F.lit(None).cast("string")
        d = c.cast("double")
        entry = [
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.lit(1)).alias("total_values"),
            (F.count(F.lit(1)) - F.count(c)).alias("null_count"),
            (F.min(c).cast("double") if number else null).alias("min_value"),
            (F.max(c).cast("double") if number else null).alias("max_value"),
            (plain_text(F.min(c)) if exact else nothing).alias("min_exact"),
            (plain_text(F.max(c)) if exact else nothing).alias("max_exact"),
            (F.avg(d) if number else null).alias("mean_value"),
            (F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(d), F.lit(0.0))) if number else null).alias("std_dev"),
        ]
        if approximate:
            entry.append(F.approx_count_distinct(group_key(df, f.name)).alias("unique_count"))
            entry.append((F.percentile_approx(d, 0.5) if number else null).alias("median_value"))
            entry.append(nothing.alias("median_exact"))
        rows.append(F.struct(*entry))
    wide = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    if approximate:
        return wide

    # Other columns: one grouping each, so a scan reads its own column only, the keys keep
    # their types, and the counts are combined before the shuffle.
    found = [
        df.select(group_key(df, f.name).alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.lit(1).alias("one"))
        .agg(F.count("one").alias("unique_count")).select(
            F.lit(f.name).alias("column_name"), F.lit(None).cast("double").alias("median_value"),
            F.lit(None).cast("string").alias("median_exact"), "unique_count")
        for f in fields if not _is_number(f.dataType)
    ]
    numbers = [f.name for f in fields if _is_number(f.dataType)]
    if numbers:
        found.append(medians(df, numbers))
    out = _attach(wide, reduce(DataFrame.unionByName, found))
    return out.withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))


def _attach(df: DataFrame, side: DataFrame) -> DataFrame:
    """`side` has at most one row per column of the table, so it may be broadcast."""
    return df.join(F.broadcast(side), "column_name", "left")


def quality_summary(profiled: DataFrame, low: float = 0.95) -> DataFrame:
    """One row over a profile: mean completeness, columns below `low`, and the issue texts."""
    share = F.when(F.col("total_values") > 0,
                   (F.col("total_values") - F.col("null_count")) / F.col("total_values")).otherwise(F.lit(0.0))
    issue = F.when(share < low, F.format_string("Column '%s' has low completeness: %.2f%%", "column_name", share * 100))
    return profiled.agg(
        F.coalesce(F.avg(share), F.lit(0.0)).alias("overall_completeness"),
        F.array_sort(F.collect_list(issue)).alias("quality_issues"),
        F.count(issue).alias("columns_with_issues"),
        F.count(F.lit(1)).alias("total_columns"),
    )


def suggest_rules(df: DataFrame, profiled: DataFrame | None = None, share: float = 0.95) -> DataFrame:
    """Rules a table seems to follow: rule_id, rule_type, column_name, pattern, min_value, max_value,
    and the bounds of integers and decimals as text (min_exact, max_exact), which `to_rules` takes.

    No nulls -> completeness; all values distinct -> uniqueness; numbers -> their range;
    text of a known shape in at least `share` of its values -> validity.
    """
    profiled = profile(df) if profiled is None else profiled
    none = F.lit(None)
    filled = F.col("total_values") > 0
    from_profile = profiled.select("column_name", "min_value", "max_value", "min_exact", "max_exact", F.array_compact(F.array(
        F.when(filled & (F.col("null_count") == 0), F.lit("completeness")),
        F.when(filled & (F.col("null_count") == 0) & (F.col("unique_count") == F.col("total_values")),
               F.lit("uniqueness")),
        F.when(F.col("min_value").isNotNull(), F.lit("range")),
    )).alias("kinds")).select(
        F.explode("kinds").alias("rule_type"), "column_name", none.cast("string").alias("pattern"),
        F.when(F.col("rule_type") == "range", F.col("min_value")).alias("min_value"),
        F.when(F.col("rule_type") == "range", F.col("max_value")).alias("max_value"),
        F.when(F.col("rule_type") == "range", F.col("min_exact")).alias("min_exact"),
        F.when(F.col("rule_type") == "range", F.col("max_exact")).alias("max_exact"),
    )
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = from_profile
    if texts:
        shares = []
        for name in texts:
            c = F.col(f"`{name}`")
            best = F.array_compact(F.array(*[
                F.when(F.count_if(c.rlike(r"\A(?:" + p + ")")) >= F.count(c) * share, F.lit(p))
                for p in KNOWN_PATTERNS.values()
            ]))
            shares.append(F.struct(F.lit(name).alias("column_name"),
                                   F.when(F.count(c) > 0, F.try_element_at(best, F.lit(1))).alias("pattern")))
        shapes = df.agg(F.array(*shares).alias("r")).select(F.inline("r")).filter("pattern IS NOT NULL")
        found = from_profile.unionByName(shapes.select(
            F.lit("validity").alias("rule_type"), "column_name", "pattern",
            none.cast("double").alias("min_value"), none.cast("double").alias("max_value"),
            none.cast("string").alias("min_exact"), none.cast("string").alias("max_exact")))
    return found.select(F.concat_ws("_", "column_name", "rule_type").alias("rule_id"), "*")


def to_rules(suggested: DataFrame) -> list[Rule]:
    """The suggestions as rules. There are at most four per column, so they may come to the driver."""
    out = []
    for row in suggested.collect():
        params = {k: row[k] for k in ("pattern", "min_value", "max_value") if row[k] is not None}
        # Python's integers and decimals hold what a double rounds.
        params |= {f"{k}_value": Decimal(row[f"{k}_exact"]) for k in ("min", "max") if row[f"{k}_exact"] is not None}
        out.append(Rule(row["rule_id"], row["rule_type"], row["column_name"], params))
    return out
