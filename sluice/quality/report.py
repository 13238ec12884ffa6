"""Verdicts, reports and quality over time, from rule results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.quality.rules import Rule, violation

# The quality dimensions and the mean score each one asks for.
DIMENSION_THRESHOLDS = {
    "completeness": 0.95,
    "accuracy": 0.90,
    "consistency": 0.95,
    "validity": 0.90,
    "uniqueness": 0.99,
}
# Our choice: the dimension each rule type speaks for.
DIMENSION_OF = {
    "completeness": "completeness", "uniqueness": "uniqueness", "validity": "validity", "range": "accuracy",
    "custom": "accuracy", "consistency": "consistency", "referential_integrity": "consistency",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def validate(results: DataFrame) -> DataFrame:
    """One row: did every rule pass?"""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("data_passed"))


def overall_score(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score"))


def dimension_verdicts(results: DataFrame) -> DataFrame:
    return (
        results.withColumn("dimension", _lookup(DIMENSION_OF, F.col("rule_type")))
        .groupBy("dimension")
        .agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("rules"))
        .withColumn("threshold", _lookup(DIMENSION_THRESHOLDS, F.col("dimension")))
        .withColumn("met", F.col("score") >= F.col("threshold"))
    )


# The advice for a failed rule by what its id contains, the advice for others, what
# follows each, and the sentence when nothing failed.
ADVICE = {
    "completeness": "Improve data completeness",
    "uniqueness": "Address duplicate values",
    "validity": "Fix data format issues",
}
OTHER_ADVICE = "Address quality issues"
ADVICE_END = " for %s (current: %.2f%%)"
ALL_PASSED = "Data quality looks good! Continue monitoring."


def recommendation() -> Column:
    """The advice for a failed rule, worded by what its id contains; null when it passed."""
    def advice(words: str) -> Column:
        return F.format_string(words + ADVICE_END, F.col("rule_id"), F.col("score") * 100)

    name = F.lower("rule_id")
    worded = [F.when(name.contains(part), advice(words)) for part, words in ADVICE.items()]
    return F.when(~F.col("passed"), F.coalesce(*worded, advice(OTHER_ADVICE)))


def report(results: DataFrame) -> DataFrame:
    """One row: rules run, passed, failed, overall score and recommendations."""
    advice = F.array_sort(F.collect_list(recommendation()))
    return results.agg(
        F.count(F.lit(1)).alias("total_rules_executed"),
        F.count_if("passed").alias("passed_rules"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score"),
        F.when(F.count_if(~F.col("passed")) == 0, F.array(F.lit(ALL_PASSED)))
        .otherwise(advice).alias("recommendations"),
    )


def score_over_time(df: DataFrame, ts: str, rules: Sequence[Rule], metric: str = "data_quality_score") -> DataFrame:
    """Metric rows (metric_name, ts, value): per day, the mean score of the row-wise rules."""
    scores = []
    for rule in rules:
        bad = violation(df, rule)
        if bad is None:
            raise ValueError(f"rule {rule.rule_id} ({rule.rule_type}) is not a row-wise rule")
        share = 1 - F.try_divide(F.count_if(bad), F.count(bad))
        scores.append(F.coalesce(share, F.lit(0.0 if rule.rule_type == "completeness" else 1.0)))
    mean = sum(scores[1:], scores[0]) / len(scores)
    return df.groupBy(F.date_trunc("day", F.col(ts)).alias("ts")).agg(mean.alias("value")).select(
        F.lit(metric).alias("metric_name"), "ts", "value")
