"""Metrics in batch. A metric table has the columns metric_name, ts, value and id (a
tie-breaker for equal times). Every function takes `as_of`, never the clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.order import order_of
from sluice.operators.ranks import nearest_rank
from sluice.session import broadcast_if_small

# The default metrics and their types.
METRIC_TYPES = {
    "pipeline_execution_time": "performance",
    "pipeline_success_rate": "performance",
    "data_quality_score": "quality",
    "cpu_usage": "resource",
    "memory_usage": "resource",
    "disk_usage": "resource",
    "task_failure_rate": "system",
    "api_response_time": "system",
    "records_processed": "business",
    "error_count": "system",
}

KEEP_VALUES = 1000  # fixed value: values kept per metric
KEEP_ALERTS = 500  # fixed value: alerts kept

CONDITIONS = ("greater_than", "less_than", "equals", "not_equals", "in_range", "out_of_range")
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class MonitoringRule:
    rule_id: str
    metric_name: str
    condition: str = "greater_than"
    threshold: float | Mapping[str, float] = 0.0
    severity: str = "medium"
    rule_name: str = "Custom Rule"
    description: str = ""
    enabled: bool = True


# The default rules.
DEFAULT_RULES = [
    MonitoringRule("high_execution_time", "pipeline_execution_time", "greater_than", 300.0, "medium",
                   "High Pipeline Execution Time", "Pipeline execution time is above acceptable threshold"),
    MonitoringRule("low_success_rate", "pipeline_success_rate", "less_than", 0.95, "high",
                   "Low Pipeline Success Rate", "Pipeline success rate has dropped below acceptable level"),
    MonitoringRule("poor_data_quality", "data_quality_score", "less_than", 0.90, "high",
                   "Poor Data Quality Score", "Data quality score is below acceptable threshold"),
    MonitoringRule("high_cpu_usage", "cpu_usage", "greater_than", 0.80, "medium",
                   "High CPU Usage", "CPU usage is above acceptable threshold"),
    MonitoringRule("high_memory_usage", "memory_usage", "greater_than", 0.85, "medium",
                   "High Memory Usage", "Memory usage is above acceptable threshold"),
    MonitoringRule("high_error_count", "error_count", "greater_than", 10.0, "high",
                   "High Error Count", "Error count is above acceptable threshold"),
]

RULE_SCHEMA = ("position int, rule_id string, metric_name string, condition string, threshold double, "
               "min_value double, max_value double, severity string, rule_name string, description string, "
               "enabled boolean")


def rules_frame(spark: SparkSession, rules: Sequence[MonitoringRule]) -> DataFrame:
    """Rules as a table, in their order. A number fills `threshold`, a range fills
    min_value and max_value (a missing bound is infinite)."""
    rows = []
    for i, r in enumerate(rules):
        if r.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")
        span = isinstance(r.threshold, Mapping)
        rows.append((
            i, r.rule_id, r.metric_name, r.condition, None if span else float(r.threshold),
            float(r.threshold.get("min", "-inf")) if span else None,
            float(r.threshold.get("max", "inf")) if span else None,
            r.severity, r.rule_name, r.description, r.enabled))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def with_types(metrics: DataFrame, types: Mapping[str, str] = METRIC_TYPES) -> DataFrame:
    """Add metric_type; an unknown name is `system`."""
    known = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return metrics.withColumn("metric_type", F.coalesce(known[F.col("metric_name")], F.lit("system")))


def latest(metrics: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The newest value per metric, up to `as_of` if given: the greatest (ts, id)."""
    if as_of is not None:
        metrics = metrics.filter(F.col("ts") <= F.lit(as_of).cast(metrics.schema["ts"].dataType))
    return metrics.groupBy("metric_name").agg(F.max_by("value", order_of(metrics, ["ts", "id"])).alias("current_value"))


def recent(metrics: DataFrame, as_of: datetime, minutes: float) -> DataFrame:
    """Rows from the last minutes up to `as_of`; both bounds are literals and reach the scan."""
    kind = metrics.schema["ts"].dataType
    return metrics.filter((F.col("ts") >= F.lit(as_of - timedelta(minutes=minutes)).cast(kind))
                          & (F.col("ts") <= F.lit(as_of).cast(kind)))


def average(metrics: DataFrame, as_of: datetime, minutes: float = 5) -> DataFrame:
    return recent(metrics, as_of, minutes).groupBy("metric_name").agg(F.avg("value").alias("average"))


def percentile(metrics: DataFrame, as_of: datetime, p: float, minutes: float = 5) -> DataFrame:
    return nearest_rank(recent(metrics, as_of, minutes), ["metric_name"], "value", p, "percentile")


def snapshot(metrics: DataFrame, as_of: datetime, minutes: float = 5, p: float = 95) -> DataFrame:
    """Per metric: newest value, mean and percentile of the last minutes, type."""
    out = latest(metrics, as_of).join(average(metrics, as_of, minutes), "metric_name", "left")
    out = out.join(percentile(metrics, as_of, p, minutes), "metric_name", "left")
    return with_types(out)


def fires(value: Column) -> Column:
    """Does a rule (columns condition, threshold, min_value, max_value, enabled) hold for a
    value? Disabled rules and rules with the wrong kind of threshold never do."""
    c, number, low, high = F.col("condition"), F.col("threshold"), F.col("min_value"), F.col("max_value")
    hit = (
        F.when(c == "greater_than", value > number)
        .when(c == "less_than", value < number)
        .when(c == "equals", value == number)
        .when(c == "not_equals", value != number)
        .when(c == "in_range", (value >= low) & (value <= high))
        .when(c == "out_of_range", (value < low) | (value > high))
    )
    return F.col("enabled") & F.coalesce(hit, F.lit(False))


def evaluate(values: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """Each metric row with each rule on its metric, and `triggered`. `rules` is broadcast while
    its size estimate allows; a table made in code (rules_frame) always is."""
    return values.join(broadcast_if_small(rules), "metric_name").withColumn("triggered", fires(F.col(value)))


def current_alerts(alerts: DataFrame, as_of: datetime, severity: str | None = None) -> DataFrame:
    """Alerts that are active or were raised in the last 24 hours, with the flags
    `is_active` and `is_recent`."""
    kind = alerts.schema["created_at"].dataType
    out = alerts.withColumn("is_active", F.col("resolved_at").isNull()).withColumn(
        "is_recent", F.col("created_at") >= F.lit(as_of - timedelta(hours=24)).cast(kind))
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return out.filter("is_active OR is_recent")


def alert_totals(alerts: DataFrame, as_of: datetime, severity: str | None = None) -> DataFrame:
    return current_alerts(alerts, as_of, severity).agg(
        F.count_if("is_active").alias("total_active"), F.count_if("is_recent").alias("total_recent"))


def acknowledge(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Set `acknowledged` from a table of alert ids; only active alerts can be acknowledged."""
    known = acknowledgements.select("alert_id").distinct().withColumn("_ack", F.lit(True))
    return alerts.join(known, "alert_id", "left").withColumn(
        "acknowledged", F.coalesce(F.col("_ack"), F.lit(False)) & F.col("resolved_at").isNull()).drop("_ack")


def metrics_report(metrics: DataFrame, as_of: datetime, minutes: float) -> DataFrame:
    """Per metric over a time range: count, mean, min, max and sample standard deviation
    (0 for a single value)."""
    return recent(metrics, as_of, minutes).groupBy("metric_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("average"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"))


def alerts_report(alerts: DataFrame, as_of: datetime, minutes: float) -> DataFrame:
    """One row over a time range: alerts, by severity, resolved, acknowledged, and
    `degraded` when any is critical."""
    kind = alerts.schema["created_at"].dataType
    window = alerts.filter(F.col("created_at") >= F.lit(as_of - timedelta(minutes=minutes)).cast(kind))
    by_severity = [F.count_if(F.col("severity") == s).alias(f"{s}_alerts") for s in SEVERITIES]
    return window.agg(
        F.count(F.lit(1)).alias("total_alerts"), *by_severity,
        F.count_if(F.col("resolved_at").isNotNull()).alias("resolved_alerts"),
        F.count_if("acknowledged").alias("acknowledged_alerts"),
        F.when(F.count_if(F.col("severity") == "critical") > 0, "degraded").otherwise("healthy")
        .alias("monitoring_health"))


# The sentences of the monitoring advice.
MANY_ALERTS = "High alert volume detected. Consider reviewing alert thresholds to reduce noise."
CRITICAL_ALERTS = "You have %d critical alerts that need immediate attention."
UNSTEADY = "Metric '%s' shows high variability. Consider investigating the cause."
BUSY_CPU = "High average CPU usage detected. Consider scaling resources or optimizing processes."
FULL_MEMORY = "High average memory usage detected. Consider increasing memory allocation or optimizing memory usage."
ALL_CALM = "System monitoring looks healthy. Continue regular monitoring."


def recommendations(metric_report: DataFrame, alert_report: DataFrame) -> DataFrame:
    """One row per piece of advice over the two reports; one reassuring row when there is none."""
    alerts = alert_report.select(F.explode(F.array_compact(F.array(
        F.when(F.col("total_alerts") > 50, MANY_ALERTS),
        F.when(F.col("critical_alerts") > 0, F.format_string(CRITICAL_ALERTS, "critical_alerts")),
    ))).alias("recommendation"))
    busy = lambda name: (F.col("metric_name") == name) & (F.col("average") > 0.8)
    metrics = metric_report.select(F.explode(F.array_compact(F.array(
        F.when(F.col("std_dev") > F.col("average"), F.format_string(UNSTEADY, "metric_name")),
        F.when(busy("cpu_usage"), BUSY_CPU),
        F.when(busy("memory_usage"), FULL_MEMORY),
    ))).alias("recommendation"))
    found = alerts.unionByName(metrics)
    calm = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(ALL_CALM).alias("recommendation"))
    return found.unionByName(calm)


def health(metrics: DataFrame, alerts: DataFrame, rules: DataFrame, monitoring_active: bool) -> DataFrame:
    """Status per component; the row `overall` has the worst one. The order from worst to
    best is critical, unhealthy, warning, healthy."""
    spark = metrics.sparkSession
    status = lambda test, bad: F.when(test, "healthy").otherwise(bad).alias("status")
    named = lambda name: F.lit(name).alias("component")
    loop = spark.range(1).select(named("monitoring"), status(F.lit(monitoring_active), "unhealthy"))
    parts = [
        loop,
        metrics.agg(F.count("value").alias("n")).select(named("metrics"), status(F.col("n") > 0, "warning")),
        alerts.filter("resolved_at IS NULL").agg(F.count_if(F.col("severity") == "critical").alias("n")).select(
            named("alerts"), status(F.col("n") == 0, "critical")),
        rules.agg(F.count_if("enabled").alias("n")).select(named("rules"), status(F.col("n") > 0, "warning")),
    ]
    components = reduce(DataFrame.unionByName, parts)
    badness = F.create_map(*[F.lit(x) for pair in
                             {"healthy": 0, "warning": 1, "unhealthy": 2, "critical": 3}.items() for x in pair])
    overall = components.agg(F.max_by("status", badness[F.col("status")]).alias("status")).select(
        named("overall"), "status")
    return components.unionByName(overall)


def retain_values(metrics: DataFrame, keep: int = KEEP_VALUES) -> DataFrame:
    """The last values of each metric. Spark cuts each task's groups to `keep` rows before
    the shuffle (WindowGroupLimit), so a hot metric stays small."""
    newest = Window.partitionBy("metric_name").orderBy(F.col("ts").desc(), F.col("id").desc())
    return metrics.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")


def retain_alerts(alerts: DataFrame, keep: int = KEEP_ALERTS) -> DataFrame:
    return alerts.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(keep)
