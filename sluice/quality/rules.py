"""Quality rules and their evaluation.

All row-wise rules of a rule set become one aggregate over one scan. Uniqueness and
referential integrity work on counts per value, so a value that fills a third of the
table is one row after the map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rule types and the share of good records each one asks for by default.
DEFAULT_THRESHOLDS = {
    "completeness": 0.95,
    "uniqueness": 0.99,
    "validity": 0.90,
    "range": 0.95,
    "consistency": 0.90,
    "referential_integrity": 0.95,
    "custom": 0.90,
}


@dataclass(frozen=True)
class Rule:
    """`parameters` by type: threshold (all); pattern (validity); min_value, max_value (range);
    related_columns, consistency_rule (consistency); reference_table, reference_column
    (referential_integrity); predicate (custom: SQL text, or a function from the frame to a Column)."""

    rule_id: str
    rule_type: str
    column: str | None = None
    parameters: Mapping[str, Any] = field(default_factory=dict)
    rule_name: str = "Custom Rule"
    description: str = "Custom quality rule"
    is_active: bool = True

    def __post_init__(self) -> None:
        if self.rule_type not in DEFAULT_THRESHOLDS:
            raise ValueError(f"rule type must be one of {sorted(DEFAULT_THRESHOLDS)}, not {self.rule_type!r}")

    @property
    def threshold(self) -> float:
        return float(self.parameters.get("threshold", DEFAULT_THRESHOLDS[self.rule_type]))


class RuleBook:
    """Rules by id. Starts with the two default rules; an unknown id is an error."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self._rules: dict[str, Rule] = {}
        self.add(Rule("default_completeness", "completeness", None, {"threshold": 0.95},
                      "Default Completeness Check", "Check that required fields are not null"))
        self.add(Rule("default_uniqueness", "uniqueness", None, {"threshold": 0.99},
                      "Default Uniqueness Check", "Check for duplicate values in key columns"))
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule | Mapping[str, Any]) -> Rule:
        if not isinstance(rule, Rule):
            rule = Rule(**{"rule_type": "custom", **rule})
        self._rules[rule.rule_id] = rule
        return rule

    def get(self, rule_ids: Sequence[str] | None = None) -> list[Rule]:
        if rule_ids is None:
            return [r for r in self._rules.values() if r.is_active]
        unknown = [r for r in rule_ids if r not in self._rules]
        if unknown:
            raise KeyError(f"unknown quality rules: {unknown}")
        return [self._rules[r] for r in rule_ids if self._rules[r].is_active]


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or empty text."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.StringType, T.VarcharType, T.CharType)):
        return c.isNull() | (c == "")
    return c.isNull()


def value_key(df: DataFrame, column: str) -> Column:
    """A short text that is equal exactly when the values are; null stays null.

    Text of 64 characters and more is replaced by its SHA-256 (64 characters), so long
    documents are never shuffled, and no shorter text can equal a digest.
    """
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0).cast(kind)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(kind, T.StringType):
        return F.when(F.length(c) >= 64, F.sha2(c, 256)).otherwise(c)
    if isinstance(kind, T.BinaryType):
        return F.sha2(c, 256)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        return F.when(c.isNotNull(), F.sha2(text, 256))
    return c.cast("string")


def group_key(df: DataFrame, column: str) -> Column:
    """What to group a column by: the value itself where it is small, else its value key."""
    small = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.col(f"`{column}`") if isinstance(df.schema[column].dataType, small) else value_key(df, column)


def violation(df: DataFrame, rule: Rule) -> Column | None:
    """True where a row breaks a row-wise rule, null where the rule does not look at the
    row; None for rules that need other rows or another table."""
    p = rule.parameters
    c = F.col(f"`{rule.column}`") if rule.column else None
    if rule.rule_type == "completeness":
        return is_missing(df, rule.column) if rule.column else None
    if rule.rule_type == "validity":
        if c is None:
            return F.lit(True)
        return ~c.cast("string").rlike(r"\A(?:" + p.get("pattern", ".*") + ")")
    if rule.rule_type == "range":
        low, high = p.get("min_value"), p.get("max_value")
        if c is None or (low is None and high is None):
            return F.lit(True)
        kind = df.schema[rule.column].dataType
        if isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif not isinstance(kind, T.NumericType):
            return F.lit(None).cast("boolean")
        tests = ([c < F.lit(low)] if low is not None else []) + ([c > F.lit(high)] if high is not None else [])
        bad = reduce(lambda a, b: a | b, tests)
        if isinstance(kind, (T.FloatType, T.DoubleType)):  # Spark puts NaN above every number
            bad = F.when(F.isnan(c), F.lit(False)).otherwise(bad)
        return bad
    if rule.rule_type == "consistency":
        if unknown := [x for x in p.get("related_columns") or () if x not in df.columns]:
            raise ValueError(f"rule {rule.rule_id}: no columns {unknown}")
        return ~F.coalesce(F.expr(p["consistency_rule"]), F.lit(False))
    if rule.rule_type == "custom":
        predicate = p["predicate"]
        good = predicate(df) if isinstance(predicate, Callable) else F.expr(predicate)
        return ~F.coalesce(good, F.lit(False))
    return None


def _measure(rule: Rule, checked: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.column).cast("string").alias("column_name"),
        F.lit(rule.threshold).alias("threshold"),
        checked.cast("long").alias("total_records"),
        failed.cast("long").alias("failed_records"),
    )


def _row_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    n = F.count(F.lit(1))
    measures = []
    for rule in rules:
        if rule.rule_type == "completeness" and not rule.column:
            missing = reduce(lambda a, b: a + b, [F.count_if(is_missing(df, c)) for c in df.columns])
            measures.append(_measure(rule, n * len(df.columns), missing))
        else:
            bad = violation(df, rule)
            measures.append(_measure(rule, F.count(bad), F.count_if(bad)))
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def _uniqueness(df: DataFrame, rule: Rule) -> DataFrame:
    if rule.column:
        keyed = df.select(group_key(df, rule.column).alias("k")).filter("k IS NOT NULL")
        counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    else:
        keys = [group_key(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
        keyed = df.select(*keys)
        counts = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("c"))
    total = F.coalesce(F.sum("c"), F.lit(0))
    return counts.agg(_measure(rule, total, total - F.count(F.lit(1))).alias("m")).select("m.*")


def _references(df: DataFrame, rule: Rule, refs: Mapping[str, DataFrame]) -> DataFrame:
    table, column = rule.parameters["reference_table"], rule.parameters["reference_column"]
    if table not in refs:
        raise KeyError(f"rule {rule.rule_id}: reference table {table!r} was not given")
    counts = (
        df.select(F.col(f"`{rule.column}`").alias("k")).filter("k IS NOT NULL")
        .groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    )
    known = refs[table].select(F.col(f"`{column}`").alias("k")).distinct().withColumn("found", F.lit(True))
    matched = counts.join(known, "k", "left")
    total = F.coalesce(F.sum("c"), F.lit(0))
    lost = F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("c"))), F.lit(0))
    return matched.agg(_measure(rule, total, lost).alias("m")).select("m.*")


def assess(df: DataFrame, rules: Sequence[Rule], refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row per rule: rule_id, rule_type, column_name, threshold, total_records,
    failed_records, score, passed, success_rate, details.

    With nothing to check, completeness fails with score 0 and the others pass with 1.
    """
    if not rules:
        raise ValueError("no rules given")
    parts = []
    row_rules = [r for r in rules if r.rule_type not in ("uniqueness", "referential_integrity")]
    if row_rules:
        parts.append(_row_rules(df, row_rules))
    for rule in rules:
        if rule.rule_type == "uniqueness":
            parts.append(_uniqueness(df, rule))
        elif rule.rule_type == "referential_integrity":
            parts.append(_references(df, rule, refs or {}))
    measured = reduce(DataFrame.unionByName, parts)

    # A rule that cannot look at anything (no column, no bounds) fails whatever its threshold.
    unusable = [r.rule_id for r in rules if
                (r.rule_type in ("validity", "range") and not r.column)
                or (r.rule_type == "range" and r.parameters.get("min_value") is None
                    and r.parameters.get("max_value") is None)]
    total, failed = F.col("total_records"), F.col("failed_records")
    share = F.when(total > 0, (total - failed) / total)
    score = F.coalesce(share, F.when(F.col("rule_type") == "completeness", F.lit(0.0)).otherwise(F.lit(1.0)))
    passed = F.when(total == 0, F.col("rule_type") != "completeness").when(
        F.col("rule_id").isin(unusable), F.lit(False)).otherwise(F.col("score") >= F.col("threshold"))
    details = _details(rules)
    return (
        measured.withColumn("score", score)
        .withColumn("passed", passed)
        .withColumn("success_rate", F.coalesce(share, F.lit(0.0)))
        .withColumn("details", details[F.col("rule_id")])
    )


def _details(rules: Sequence[Rule]) -> Column:
    """rule_id -> map of the rule's own parameters as text."""
    entries = []
    for rule in rules:
        shown = {k: v for k, v in rule.parameters.items() if not callable(v)}
        shown["threshold"] = rule.threshold
        inner = [x for k, v in sorted(shown.items()) for x in (F.lit(k), F.lit(str(v)))]
        entries += [F.lit(rule.rule_id), F.create_map(*inner)]
    return F.create_map(*entries)


def mark_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each row with the ids of the row-wise rules it breaks, in `_violations`."""
    ids = []
    for rule in rules:
        if rule.rule_type == "completeness" and not rule.column:
            bad = reduce(lambda a, b: a | b, [is_missing(df, c) for c in df.columns])
        else:
            bad = violation(df, rule)
        if bad is None:
            raise ValueError(f"rule {rule.rule_id} ({rule.rule_type}) is not a row-wise rule")
        ids.append(F.when(bad, F.lit(rule.rule_id)))
    return df.withColumn("_violations", F.array_compact(F.array(*ids)))


def split_rows(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with `_violations`)."""
    marked = mark_rows(df, rules)
    return (marked.filter(F.size("_violations") == 0).drop("_violations"),
            marked.filter(F.size("_violations") > 0))
