"""Metrics, rules, alerts and their streams (area K). Events are the metric rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.metrics import alerts, batch
from sluice.metrics.batch import MonitoringRule
from sluice.queries.registry import Tables, query
from sluice.session import scratch_path
from sluice.sources import files
from sluice.streaming import metrics as stream

AS_OF = datetime(2024, 1, 20, 12)
_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"
# Event types named like metrics, so that types, rules and advice apply.
_NAME = """CASE event_type WHEN 'error' THEN 'error_count' WHEN 'click' THEN 'api_response_time'
  WHEN 'purchase' THEN 'records_processed' WHEN 'view' THEN 'cpu_usage' ELSE event_type END"""
_METRICS = f"m AS (SELECT {_NAME} AS metric_name, ts, value, event_id AS id FROM events)"

RULES = [
    MonitoringRule("many_errors", "error_count", "greater_than", 120.0, "high", "Many errors", "Too many errors"),
    MonitoringRule("no_errors", "error_count", "less_than", 6.0, "low", "Few errors", "Suspiciously few errors"),
    MonitoringRule("odd_cpu", "cpu_usage", "out_of_range", {"min": 8.0, "max": 110.0}, "critical", "Odd CPU", "CPU is odd"),
    MonitoringRule("records", "records_processed", "in_range", {"min": 100.0}, "medium", "Large batch", "Batch is large"),
    MonitoringRule("slow_off", "api_response_time", "greater_than", 1.0, "high", "Slow", "Slow API", enabled=False),
    MonitoringRule("slow", "api_response_time", "greater_than", 150.0, "medium", "Slow", "Slow API"),
    MonitoringRule("mistyped", "signup", "in_range", 5.0, "low", "Mistyped", "A number is no range"),
    MonitoringRule("exact", "signup", "equals", 50.0, "low", "Exact", "Exactly fifty"),
]
_RULES_SQL = """rules(position, rule_id, metric_name, condition, threshold, min_value, max_value, severity, enabled) AS (VALUES
  (0, 'many_errors', 'error_count', 'greater_than', 120.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'high', true),
  (1, 'no_errors', 'error_count', 'less_than', 6.0, NULL, NULL, 'low', true),
  (2, 'odd_cpu', 'cpu_usage', 'out_of_range', NULL, 8.0, 110.0, 'critical', true),
  (3, 'records', 'records_processed', 'in_range', NULL, 100.0, 'inf'::DOUBLE, 'medium', true),
  (4, 'slow_off', 'api_response_time', 'greater_than', 1.0, NULL, NULL, 'high', false),
  (5, 'slow', 'api_response_time', 'greater_than', 150.0, NULL, NULL, 'medium', true),
  (6, 'mistyped', 'signup', 'in_range', 5.0, NULL, NULL, 'low', true),
  (7, 'exact', 'signup', 'equals', 50.0, NULL, NULL, 'low', true))"""
_FIRES = """(enabled AND coalesce(CASE condition WHEN 'greater_than' THEN value > threshold WHEN 'less_than' THEN value < threshold
  WHEN 'equals' THEN value = threshold WHEN 'not_equals' THEN value <> threshold
  WHEN 'in_range' THEN value BETWEEN min_value AND max_value
  WHEN 'out_of_range' THEN value < min_value OR value > max_value END, false))"""


def _metrics(t: Tables) -> DataFrame:
    return t("events").select(F.expr(_NAME).alias("metric_name"), "ts", "value", F.col("event_id").alias("id"))


_TYPE = """CASE WHEN metric_name IN ('cpu_usage') THEN 'resource' WHEN metric_name = 'records_processed' THEN 'business'
  ELSE 'system' END"""


@query("k1_collect", f"WITH {_METRICS} SELECT *, {_TYPE} AS metric_type FROM m")
def _(t: Tables) -> DataFrame:
    return batch.with_types(_metrics(t))


@query("k2_latest", f"WITH {_METRICS} SELECT metric_name, arg_max(value, (ts, id)) AS current_value FROM m GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return batch.latest(_metrics(t))


_RECENT = f"""r AS (SELECT * FROM m WHERE ts >= {_AS_OF} - INTERVAL 1440 MINUTE AND ts <= {_AS_OF})"""


@query("k3_average", f"WITH {_METRICS}, {_RECENT} SELECT metric_name, round(avg(value), 7) AS average FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return batch.average(_metrics(t), AS_OF, 1440).withColumn("average", F.round("average", 7))


_P95 = "list_sort(list(value))[least(floor(count(*) * 95 / 100)::BIGINT, count(*) - 1) + 1]"


@query("k4_percentile", f"WITH {_METRICS}, {_RECENT} SELECT metric_name, {_P95} AS percentile FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return batch.percentile(_metrics(t), AS_OF, 95, 1440)


@query("k4_percentile_all_time", f"WITH {_METRICS} SELECT metric_name, {_P95} AS percentile FROM m GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return batch.nearest_rank(_metrics(t), ["metric_name"], "value", 95, "percentile")


@query("k5_snapshot", f"""WITH {_METRICS}, {_RECENT},
  l AS (SELECT metric_name, arg_max(value, (ts, id)) AS current_value FROM m WHERE ts <= {_AS_OF} GROUP BY ALL),
  a AS (SELECT metric_name, round(avg(value), 7) AS average, {_P95} AS percentile FROM r GROUP BY ALL)
SELECT *, {_TYPE} AS metric_type FROM l LEFT JOIN a USING (metric_name)""")
def _(t: Tables) -> DataFrame:
    return batch.snapshot(_metrics(t), AS_OF, 1440).withColumn("average", F.round("average", 7))


@query("k6_evaluate", f"""WITH {_METRICS}, {_RULES_SQL}
SELECT id, rule_id, value, {_FIRES} AS triggered FROM m JOIN rules USING (metric_name)""")
def _(t: Tables) -> DataFrame:
    return batch.evaluate(_metrics(t), batch.rules_frame(t.spark, RULES)).select("id", "rule_id", "value", "triggered")


@query("k7_default_rules", f"""WITH {_METRICS}
SELECT metric_name, CASE metric_name WHEN 'cpu_usage' THEN 'high_cpu_usage' ELSE 'high_error_count' END AS rule_id,
  count(*) FILTER (value > CASE metric_name WHEN 'cpu_usage' THEN 0.8 ELSE 10.0 END) AS triggered
FROM m WHERE metric_name IN ('cpu_usage', 'error_count') GROUP BY metric_name""")
def _(t: Tables) -> DataFrame:
    judged = batch.evaluate(_metrics(t), batch.rules_frame(t.spark, batch.DEFAULT_RULES))
    return judged.groupBy("metric_name", "rule_id").agg(F.count_if("triggered").alias("triggered"))


# Alerts: the SQL walks every metric's ticks one by one. Half-hour ticks keep that walk short;
# the data is the whole table.
_TICK = 1800


def _alerts_sql(until: str, keep: str = "true") -> str:
    """Common tables up to `s`, one row per metric and tick with what was raised or resolved."""
    return f"""WITH RECURSIVE {_METRICS}, {_RULES_SQL},
  tk AS (SELECT metric_name, (floor(epoch(ts) / {_TICK}) * {_TICK} + {_TICK})::BIGINT AS tick, arg_max(value, (ts, id)) AS value
         FROM m GROUP BY ALL),
  tks AS (SELECT * FROM tk WHERE tick <= {until} AND {keep}),
  span AS (SELECT metric_name, min(tick) AS lo, max(tick) AS hi FROM tks GROUP BY ALL),
  grid AS (SELECT metric_name, unnest(range(lo, {{end}} + 1, {_TICK})) AS tick FROM span),
  v AS (SELECT grid.metric_name, grid.tick, tks.value FROM grid ASOF JOIN tks
        ON grid.metric_name = tks.metric_name AND grid.tick >= tks.tick),
  j AS (SELECT v.metric_name, tick, value, coalesce(min(CASE WHEN {_FIRES} THEN position END), -1) AS fired,
          arg_min({_FIRES}, position) AS holds FROM v JOIN rules USING (metric_name) GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY tick) AS rn FROM j),
  s AS (SELECT DISTINCT metric_name, 0::BIGINT AS rn, NULL::BIGINT AS tick, NULL::BIGINT AS active, NULL::BIGINT AS raised,
          NULL::BIGINT AS resolved, NULL::INT AS position, NULL::DOUBLE AS value FROM n
        UNION ALL
        SELECT n.metric_name, n.rn, n.tick,
          CASE WHEN NOT n.holds AND s.active + 3600 < n.tick THEN NULL
               WHEN s.active IS NULL AND n.fired >= 0 THEN n.tick ELSE s.active END,
          CASE WHEN s.active IS NULL AND n.fired >= 0 THEN n.tick END,
          CASE WHEN NOT n.holds AND s.active + 3600 < n.tick THEN s.active END, n.fired, n.value
        FROM s JOIN n ON n.metric_name = s.metric_name AND n.rn = s.rn + 1),
  a AS (SELECT r.metric_name, r.raised AS created, r.position, r.value AS current_value, x.tick AS resolved
        FROM s r LEFT JOIN s x ON x.metric_name = r.metric_name AND x.resolved = r.raised WHERE r.raised IS NOT NULL),
  alerts AS (SELECT concat(rule_id, '_', created) AS alert_id, rule_id, severity, a.metric_name, current_value,
               make_timestamp(created * 1000000) AS created_at, make_timestamp(resolved * 1000000) AS resolved_at
             FROM a JOIN rules USING (position))"""


_UNTIL = "epoch(" + _AS_OF + ")::BIGINT"
_ALERTS = _alerts_sql(_UNTIL).replace("{end}", _UNTIL)
_SHOWN = ["alert_id", "rule_id", "severity", "metric_name", "current_value", "created_at", "resolved_at"]


def _alerts(t: Tables) -> DataFrame:
    return alerts.alerts(_metrics(t), RULES, AS_OF, seconds=_TICK)


@query("k8_k9_alerts", f"{_ALERTS} SELECT {', '.join(_SHOWN)} FROM alerts")
def _(t: Tables) -> DataFrame:
    return _alerts(t).select(*_SHOWN)


_ACK = "acks AS (SELECT DISTINCT alert_id FROM alerts WHERE severity IN ('high', 'critical'))"
_ACKED = f"""{_ALERTS}, {_ACK}, acked AS (SELECT *, resolved_at IS NULL AND alert_id IN (SELECT alert_id FROM acks)
  AS acknowledged FROM alerts)"""


def _acknowledged(t: Tables) -> DataFrame:
    found = _alerts(t)
    return batch.acknowledge(found, found.filter(F.col("severity").isin("high", "critical")))


@query("k10_current_alerts", f"""{_ALERTS}
SELECT alert_id, severity, resolved_at IS NULL AS is_active, created_at >= {_AS_OF} - INTERVAL 24 HOUR AS is_recent
FROM alerts WHERE resolved_at IS NULL OR created_at >= {_AS_OF} - INTERVAL 24 HOUR""")
def _(t: Tables) -> DataFrame:
    return batch.current_alerts(_alerts(t), AS_OF).select("alert_id", "severity", "is_active", "is_recent")


@query("k10_alert_totals", f"""{_ALERTS}
SELECT count(*) FILTER (resolved_at IS NULL) AS total_active,
  count(*) FILTER (created_at >= {_AS_OF} - INTERVAL 24 HOUR) AS total_recent FROM alerts WHERE severity = 'high'""")
def _(t: Tables) -> DataFrame:
    return batch.alert_totals(_alerts(t), AS_OF, "high")


@query("k11_acknowledge", f"{_ACKED} SELECT alert_id, acknowledged FROM acked")
def _(t: Tables) -> DataFrame:
    return _acknowledged(t).select("alert_id", "acknowledged")


_METRIC_REPORT = """SELECT metric_name, count(value) AS count, round(avg(value), 7) AS average, min(value) AS min_value,
  max(value) AS max_value, round(coalesce(stddev_samp(value), 0), 7) AS std_dev FROM r GROUP BY metric_name"""


@query("k12_metrics_report", f"WITH {_METRICS}, {_RECENT} {_METRIC_REPORT}")
def _(t: Tables) -> DataFrame:
    out = batch.metrics_report(_metrics(t), AS_OF, 1440)
    return out.withColumns({"average": F.round("average", 7), "std_dev": F.round("std_dev", 7)})


_ALERT_REPORT = f"""SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'low') AS low_alerts,
  count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'high') AS high_alerts,
  count(*) FILTER (severity = 'critical') AS critical_alerts, count(resolved_at) AS resolved_alerts,
  count(*) FILTER (acknowledged) AS acknowledged_alerts,
  CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'degraded' ELSE 'healthy' END AS monitoring_health
FROM acked WHERE created_at >= {_AS_OF} - INTERVAL 14400 MINUTE"""


@query("k12_alerts_report", f"{_ACKED} {_ALERT_REPORT}")
def _(t: Tables) -> DataFrame:
    return batch.alerts_report(_acknowledged(t), AS_OF, 14400)


@query("k13_recommendations", f"""{_ACKED}, {_RECENT}, mr AS ({_METRIC_REPORT}), ar AS ({_ALERT_REPORT}),
  found AS (
  SELECT 'High alert volume detected. Consider reviewing alert thresholds to reduce noise.' AS recommendation FROM ar
    WHERE total_alerts > 50
  UNION ALL SELECT 'You have ' || critical_alerts || ' critical alerts that need immediate attention.' FROM ar
    WHERE critical_alerts > 0
  UNION ALL SELECT 'Metric ''' || metric_name || ''' shows high variability. Consider investigating the cause.' FROM mr
    WHERE std_dev > average
  UNION ALL SELECT 'High average CPU usage detected. Consider scaling resources or optimizing processes.' FROM mr
    WHERE metric_name = 'cpu_usage' AND average > 0.8
  UNION ALL SELECT 'High average memory usage detected. Consider increasing memory allocation or optimizing memory usage.'
    FROM mr WHERE metric_name = 'memory_usage' AND average > 0.8)
SELECT * FROM found UNION ALL SELECT 'System monitoring looks healthy. Continue regular monitoring.'
  WHERE NOT EXISTS (FROM found)""")
def _(t: Tables) -> DataFrame:
    return batch.recommendations(batch.metrics_report(_metrics(t), AS_OF, 1440),
                                 batch.alerts_report(_acknowledged(t), AS_OF, 14400))


@query("k14_health", f"""{_ALERTS}, c AS (
  SELECT 'monitoring' AS component, 'healthy' AS status
  UNION ALL SELECT 'metrics', CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'warning' END FROM m
  UNION ALL SELECT 'alerts', CASE WHEN count(*) > 0 THEN 'critical' ELSE 'healthy' END FROM alerts
    WHERE resolved_at IS NULL AND severity = 'critical'
  UNION ALL SELECT 'rules', CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'warning' END FROM rules WHERE enabled)
SELECT * FROM c UNION ALL SELECT 'overall', arg_max(status, CASE status WHEN 'critical' THEN 3 WHEN 'unhealthy' THEN 2
  WHEN 'warning' THEN 1 ELSE 0 END) FROM c""")
def _(t: Tables) -> DataFrame:
    return batch.health(_metrics(t), _alerts(t), batch.rules_frame(t.spark, RULES), True)


@query("k15_retain_values", f"""WITH {_METRICS}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, id DESC) AS rn FROM m)
WHERE rn <= 1000""")
def _(t: Tables) -> DataFrame:
    return batch.retain_values(_metrics(t))


@query("k15_stream_retain", f"""WITH {_METRICS}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, id DESC) AS rn FROM m)
WHERE rn <= 1000""")
def _(t: Tables) -> DataFrame:
    events, checkpoint = _event_stream(t), scratch_path(t.spark, "retained")
    for _ in range(2):  # the second run goes on from the first one's state
        stream.retain(events, checkpoint).awaitTermination()
    return stream.retained(t.spark, checkpoint, events.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k15_retain_alerts", f"{_ALERTS} SELECT alert_id FROM alerts ORDER BY created_at DESC, alert_id DESC LIMIT 500")
def _(t: Tables) -> DataFrame:
    return batch.retain_alerts(_alerts(t)).select("alert_id")


# ---------------------------------------------------------------- streams
# Each stream reads the events folder to its end, writes to a new shared folder, and the
# query reads that folder back.


def _event_stream(t: Tables) -> DataFrame:
    # A stream reads folders; the pattern in the name lets it read a single file as well.
    raw = stream.read_stream(t.spark, f"{t.folder.rstrip('/')}/events.parque[t]", t("events").schema)
    named = raw.withColumn("metric_name", F.expr(_NAME))
    return stream.as_metrics(named, "metric_name", "ts", "value", "event_id")


def _finish(t: Tables, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(t.spark, label)
    stream.write_stream(df, path, path + "-checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


@query("k1_stream_collect", f"WITH {_METRICS} SELECT *, {_TYPE} AS metric_type FROM m")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "metrics")
    stream.collect(_event_stream(t), path, path + "-checkpoint").awaitTermination()
    return t.spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k2_stream_latest", f"""WITH {_METRICS}
SELECT metric_name, arg_max(value, (ts, id)) AS current_value FROM m GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "latest")
    stream.replace_stream(stream.latest(_event_stream(t)), path, path + "-checkpoint").awaitTermination()
    return stream.replaced(t.spark, path)


@query("k3_k17_stream_windows", f"""WITH {_METRICS}, w AS (
  SELECT metric_name, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(avg(value), 7) AS average, count(*) AS count
  FROM m GROUP BY ALL)
SELECT *, window_start + INTERVAL 1 HOUR AS window_end FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM m)""")
def _(t: Tables) -> DataFrame:
    out = _finish(t, stream.window_average(_event_stream(t), "1 hour", late="10 minutes"), "windows")
    return out.withColumns({"average": F.round("average", 7),
                            "window_start": F.col("window_start").cast("timestamp_ntz"),
                            "window_end": F.col("window_end").cast("timestamp_ntz")})


@query("k6_stream_evaluate", f"""WITH {_METRICS}, {_RULES_SQL}
SELECT id, rule_id, value FROM m JOIN rules USING (metric_name) WHERE {_FIRES}""")
def _(t: Tables) -> DataFrame:
    judged = batch.evaluate(_event_stream(t), batch.rules_frame(t.spark, RULES)).filter("triggered")
    return _finish(t, judged.select("id", "rule_id", "value"), "triggered")


_SEEN = "tick <= (SELECT epoch(date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE) FROM m)"


@query("k16_stream_ticks", f"""WITH {_METRICS}, tk AS (
  SELECT metric_name, (floor(epoch(ts) / 30) * 30 + 30)::BIGINT AS tick, arg_max(value, (ts, id)) AS value FROM m GROUP BY ALL)
SELECT * FROM tk WHERE {_SEEN}""")
def _(t: Tables) -> DataFrame:
    return _finish(t, stream.ticks(_event_stream(t)), "ticks")


@query("k8_k9_stream_alerts", _alerts_sql("9223372036854775807", _SEEN).replace("{end}", "(SELECT max(tick) FROM tks)")
       + f" SELECT {', '.join(_SHOWN)} FROM alerts")
def _(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "monitor")
    stream.monitor(_event_stream(t), RULES, folder, seconds=_TICK)
    return stream.monitored_alerts(t.spark, RULES, folder).select(*_SHOWN)


@query("k18_run_metrics", """
SELECT 'records_processed' AS metric_name, count(*)::DOUBLE AS value FROM lineitem WHERE l_quantity > 30
UNION ALL SELECT 'pipeline_success_rate', 1.0::DOUBLE""")
def _(t: Tables) -> DataFrame:
    """The metric rows of a run that writes part of a table; seconds are left out, as they differ."""
    written = files.save(t("lineitem").filter("l_quantity > 30"), f"{scratch_path(t.spark, 'run')}.parquet")
    rows = stream.run_metrics(t.spark, 1, datetime(2024, 1, 1), 0.0, written.get["rows"], True)
    return rows.filter("metric_name <> 'pipeline_execution_time'").select("metric_name", "value")
