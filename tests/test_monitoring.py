import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluice.metrics import alerts, batch
from sluice.metrics.batch import MonitoringRule
from sluice.session import scratch_path
from sluice.streaming import metrics as stream
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
SCHEMA = "metric_name string, ts timestamp_ntz, value double, id long"


def frame(spark, points, name="cpu"):
    return spark.createDataFrame([(name, T0 + timedelta(seconds=s), float(v), i) for i, (s, v) in enumerate(points)], SCHEMA)


HIGH = MonitoringRule("high", "cpu", "greater_than", 0.8, "critical", "High", "CPU is high")


def test_alert_life(spark):
    """Breach, still breached, normal after 59 and 61 minutes, breach again."""
    points = [(0, 0.9), (60, 0.95), (59 * 60, 0.1), (90 * 60, 0.9), (200 * 60, 0.2)]
    got = alerts.alerts(frame(spark, points), [HIGH], T0 + timedelta(hours=5)).orderBy("created_at").collect()
    at = lambda s: T0 + timedelta(seconds=s)
    assert [(r.created_at, r.resolved_at, r.current_value) for r in got] == [
        (at(30), at(3660), 0.9), (at(5430), at(12030), 0.9)]
    assert got[0].message == "CPU is high. Current value: 0.9, Threshold: 0.8"
    assert got[0].severity == "critical" and not got[0].acknowledged


def test_a_second_rule_raises_again(spark):
    """The second rule keeps firing while the first does not hold: raised, resolved after
    more than an hour, raised on the next tick."""
    rules = [MonitoringRule("odd", "cpu", "equals", 5.0), MonitoringRule("low", "cpu", "less_than", 1.0)]
    got = alerts.alerts(frame(spark, [(0, 0.5)]), rules, T0 + timedelta(hours=2, minutes=30)).orderBy("created_at")
    assert [(r.rule_id, r.created_at, r.resolved_at) for r in got.collect()] == [
        ("low", T0 + timedelta(seconds=30), T0 + timedelta(seconds=3660)),
        ("low", T0 + timedelta(seconds=3690), T0 + timedelta(seconds=7320)),
        ("low", T0 + timedelta(seconds=7350), None)]


def _walk(points, rules, until, step, limit):
    """Every tick, one by one."""
    out, active, fires = [], None, {
        "greater_than": lambda r, v: v > r.threshold, "less_than": lambda r, v: v < r.threshold,
        "equals": lambda r, v: v == r.threshold, "not_equals": lambda r, v: v != r.threshold,
        "in_range": lambda r, v: r.threshold["min"] <= v <= r.threshold["max"],
        "out_of_range": lambda r, v: not r.threshold["min"] <= v <= r.threshold["max"]}
    holds = lambda r, v: r.enabled and fires[r.condition](r, v)
    tick = (points[0][0] // step + 1) * step
    while tick <= until:
        value = [v for s, v in points if s < tick][-1]
        for r in rules:
            if active is None and holds(r, value):
                active = [r.rule_id, tick, None, value]
                out.append(active)
        if active is not None and active[1] < tick - limit and not holds(rules[0], value):
            active[2], active = tick, None
        tick += step
    return [tuple(a) for a in out]


@pytest.mark.parametrize("seed", range(6))
def test_alerts_by_brute_force(spark, seed):
    rng = random.Random(seed)
    points = sorted({rng.randrange(0, 40_000): rng.choice([1.0, 2.0, 5.0, 9.0]) for _ in range(rng.choice([4, 60]))}.items())
    rules = [
        MonitoringRule("a", "cpu", rng.choice(["greater_than", "less_than"]), 4.0, enabled=seed != 3),
        MonitoringRule("b", "cpu", "in_range", {"min": 1.5, "max": 6.0}),
        MonitoringRule("c", "cpu", "not_equals", 9.0, "high")][: rng.choice([2, 3])]
    until, limit = 50_000, rng.choice([600, 3600, 45])
    got = alerts.alerts(frame(spark, points), rules, T0 + timedelta(seconds=until), resolve_after=limit)
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) - int((T0 - datetime(1970, 1, 1)).total_seconds())
    found = got.select("rule_id", second("created_at"), second("resolved_at"), "current_value")
    assert rows(found) == sorted(_walk(points, rules, until, 30, limit), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_alerts_of_pieces_by_brute_force(spark, seed):
    """Short pieces, composed three at a time on several levels, with gaps longer than a piece."""
    rng = random.Random(seed)
    times = sorted(rng.sample(range(0, 120_000), 260) if seed % 2 else
                   [t + 40_000 * (t > 9000) + 30_000 * (t > 20_000) for t in range(0, 30_000, 100)])
    points = [(t, rng.choice([1.0, 2.0, 5.0, 9.0] if seed % 3 else [5.0, 9.0])) for t in times]
    rules = [MonitoringRule("a", "cpu", "in_range", {"min": 1.5, "max": 6.0}), MonitoringRule("b", "cpu", "greater_than", 4.0),
             MonitoringRule("c", "cpu", "not_equals", 9.0, "high")][:: rng.choice([1, -1])]
    until, limit = 130_000, rng.choice([600, 3600, 45])
    other = frame(spark, points[::3], "cpu").withColumn("metric_name", F.lit("spare"))
    events = alerts.alert_events(frame(spark, points).unionByName(other), rules, T0 + timedelta(seconds=until),
                                 resolve_after=limit, piece_ticks=20, group=3)
    found = alerts.alerts_from_events(events, rules)
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) - int((T0 - datetime(1970, 1, 1)).total_seconds())
    got = found.select("rule_id", second("created_at"), second("resolved_at"), "current_value")
    assert rows(got) == sorted(_walk(points, rules, until, 30, limit), key=repr)
    assert found.where("metric_name = 'spare'").count() == 0


def test_a_long_history_is_spread(spark):
    """A million ticks of one metric: every task gets pieces, and events equal one run over all of them."""
    ticks = 1_000_000
    start = int((T0 - datetime(1970, 1, 1)).total_seconds())
    data = spark.range(ticks).select(
        F.lit("cpu").alias("metric_name"), F.timestamp_seconds(F.col("id") * 30 + start).cast("timestamp_ntz").alias("ts"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(400)) == 0, 0.1).when(F.col("id") % 7000 < 300, 0.95).otherwise(0.5).alias("value"), "id")
    rules = [MonitoringRule("low", "cpu", "less_than", 0.2), MonitoringRule("high", "cpu", "greater_than", 0.9)]
    as_of = T0 + timedelta(seconds=30 * ticks + 30)
    events = alerts.alert_events(data, rules, as_of)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas [metric_name" in plan and not re.search(r"FlatMapGroupsInPandas \[metric_name#\d+\],", plan)
    active, want, until = None, [], start + 30 * ticks + 30
    judged = alerts.change_points(alerts.judge(alerts.ticks(data), rules).withColumn("piece", F.lit(0)))
    points = judged.orderBy("tick").collect()
    for p, end in zip(points, [*(p.tick for p in points[1:]), until + 1]):
        active, found = alerts.advance(active, p.tick, end, p.value, p.fired, p.holds, 30, 3600)
        want += [("cpu", *e) for e in found]
    assert len(want) > 1000
    assert rows(events) == sorted(want, key=repr)


def test_no_history(spark):
    none = frame(spark, [(0, 1.0)]).filter("false")
    assert alerts.alerts(none, [HIGH], T0).count() == 0


def test_streamed_alerts_equal_batch(spark, tmp_path):
    """Ticks arrive in several files; the state carries over."""
    rng = random.Random(3)
    points = [(i * 97, rng.choice([0.2, 0.9, 0.95])) for i in range(300)]
    data = frame(spark, points).withColumn("ts", F.col("ts").cast("timestamp"))
    ticked = alerts.judge(alerts.ticks(data), [HIGH]).select("metric_name", "tick", "value")
    cuts = [r.tick for r in ticked.orderBy("tick").collect()][::60]
    folder = str(tmp_path / "ticks")
    for lo, hi in zip(cuts, [*cuts[1:], 1 << 60]):
        ticked.filter((F.col("tick") >= lo) & (F.col("tick") < hi)).coalesce(1).write.mode("append").parquet(folder)
    events = stream.alert_events(stream.read_stream(spark, folder, ticked.schema, files_per_trigger=1), [HIGH])
    path = scratch_path(spark, "events")
    query = stream.write_stream(events, path, path + "-c")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(cuts)
    last = ticked.agg(F.max("tick")).first()[0]
    until = datetime(1970, 1, 1) + timedelta(seconds=last)
    want = alerts.alerts(data, [HIGH], until)
    got = alerts.alerts_from_events(spark.read.schema(events.schema).parquet(path), [HIGH])
    assert rows(got) == rows(want)
    assert got.count() > 2
    measured = stream.progress_metrics(spark, query)
    assert measured.filter("metric_name = 'records_processed'").agg(F.sum("value")).first()[0] == ticked.count()


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "metric_name string, ts timestamp, value double, id long"
    for i, rows_ in enumerate([[(0, 1.0), (3600, 2.0)], [(7200, 3.0)], [(7300, 5.0)], [(10, 100.0)], [(90_000, 0.0)]]):
        spark.createDataFrame([("m", T0 + timedelta(seconds=s), v, i * 10 + j) for j, (s, v) in enumerate(rows_)],
                              schema).coalesce(1).write.mode("append").parquet(folder)
    source = stream.read_stream(spark, folder, schema, files_per_trigger=1)
    path = scratch_path(spark, "late")
    stream.write_stream(stream.window_average(source, "1 hour", late="10 minutes"), path, path + "-c").awaitTermination()
    got = {r.window_start: (r.average, r["count"]) for r in spark.read.parquet(path).collect()}
    assert got == {T0: (1.0, 1), T0 + timedelta(hours=1): (2.0, 1), T0 + timedelta(hours=2): (4.0, 2)}


@pytest.mark.parametrize(("condition", "threshold", "values"), [
    ("greater_than", 5.0, [6]), ("less_than", 5.0, [4]), ("equals", 5.0, [5]), ("not_equals", 5.0, [4, 6]),
    ("in_range", {"min": 5, "max": 6}, [5, 6]), ("in_range", {"max": 5}, [4, 5]), ("out_of_range", {"min": 5}, [4]),
    ("in_range", 5.0, []), ("greater_than", {"min": 5}, []), ("nonsense", 5.0, [])])
def test_conditions(spark, condition, threshold, values):
    rule = MonitoringRule("r", "cpu", condition, threshold)
    data = frame(spark, [(i, v) for i, v in enumerate([4, 5, 6])])
    judged = batch.evaluate(data, batch.rules_frame(spark, [rule, MonitoringRule("off", "cpu", "less_than", 99.0, enabled=False)]))
    assert sorted(r.value for r in judged.filter("triggered").collect()) == values
    assert sorted(r.value for r in data.filter(alerts.rule_holds(rule)).collect()) == values


def test_snapshot(spark):
    data = frame(spark, [(i, i + 1) for i in range(100)], "cpu_usage").unionByName(frame(spark, [(0, 4.0)], "mine"))
    as_of = T0 + timedelta(seconds=100)
    got = {r.metric_name: (r.current_value, r.average, r.percentile, r.metric_type)
           for r in batch.snapshot(data, as_of).collect()}
    assert got == {"cpu_usage": (100.0, 50.5, 96.0, "resource"), "mine": (4.0, 4.0, 4.0, "system")}
    later = batch.snapshot(data, as_of + timedelta(hours=1)).filter("metric_name = 'mine'").first()
    assert (later.current_value, later.average, later.percentile) == (4.0, None, None)


def test_default_rules_and_types(spark):
    assert len(batch.DEFAULT_RULES) == 6 and len(batch.METRIC_TYPES) == 10
    hot = frame(spark, [(0, 0.9)], "cpu_usage")
    got = batch.evaluate(hot, batch.rules_frame(spark, batch.DEFAULT_RULES)).filter("triggered")
    assert [r.rule_id for r in got.collect()] == ["high_cpu_usage"]
    with pytest.raises(ValueError, match="severity"):
        batch.rules_frame(spark, [MonitoringRule("r", "m", severity="dire")])


def test_report_and_health(spark):
    data = frame(spark, [(i, 0.9) for i in range(5)], "cpu_usage").unionByName(frame(spark, [(0, 0.1), (1, 9.0)], "jumpy"))
    as_of = T0 + timedelta(minutes=4)
    rule = MonitoringRule("hot", "cpu_usage", "greater_than", 0.8, "critical", "Hot", "Hot")
    raised = alerts.alerts(data, [rule], as_of)
    metric_report, alert_report = batch.metrics_report(data, as_of, 5), batch.alerts_report(raised, as_of, 5)
    assert alert_report.first().monitoring_health == "degraded"
    assert {r.recommendation for r in batch.recommendations(metric_report, alert_report).collect()} == {
        "You have 1 critical alerts that need immediate attention.",
        "Metric 'jumpy' shows high variability. Consider investigating the cause.",
        "High average CPU usage detected. Consider scaling resources or optimizing processes."}
    none = raised.filter("false")
    calm = batch.recommendations(metric_report.filter("false"), batch.alerts_report(none, as_of, 5))
    assert rows(calm) == [("System monitoring looks healthy. Continue regular monitoring.",)]
    table = batch.rules_frame(spark, [rule])
    assert dict(rows(batch.health(data, raised, table, True)))["overall"] == "critical"
    assert dict(rows(batch.health(data, none, table, False)))["overall"] == "unhealthy"
    assert dict(rows(batch.health(data.filter("false"), none, table, True)))["overall"] == "warning"
    acked = batch.acknowledge(raised, raised.select("alert_id"))
    assert [r.acknowledged for r in acked.collect()] == [True]
    assert batch.alert_totals(raised, as_of + timedelta(days=3)).first() == (1, 0)


def test_retention(spark):
    data = frame(spark, [(i, i) for i in range(50)])
    assert sorted(r.value for r in batch.retain_values(data, 3).collect()) == [47, 48, 49]


def test_streamed_retention_over_restarts(spark, tmp_path):
    """Rows that come late, in several files and runs; nulls and repeated times; the state stays bounded."""
    source, checkpoint = str(tmp_path / "in"), scratch_path(spark, "kept")
    schema = "metric_name string, ts timestamp, value double, id long"
    rng, data = random.Random(1), []
    for run in range(3):
        for _ in range(2):
            new = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, T0 + timedelta(seconds=rng.randrange(500))]),
                    rng.choice([None, float(rng.randrange(9))]), len(data) + i) for i in range(60)]
            data += new
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)
        rows_in = stream.read_stream(spark, source, schema, files_per_trigger=1)
        stream.retain(rows_in, checkpoint, keep=5).awaitTermination()
        got = stream.retained(spark, checkpoint, rows_in.schema, keep=5)
        assert got.columns == ["metric_name", "ts", "value", "id"]
        want = batch.retain_values(spark.createDataFrame(data, schema), 5)
        assert rows(got) == rows(want)
    held = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 5


def test_old_results_are_deleted(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "metric_name string, ts timestamp, value double, id long"
    for i in range(stream.KEPT_RESULTS + 4):
        spark.createDataFrame([("cpu", T0 + timedelta(seconds=i), float(i), i)], schema).coalesce(1).write.mode("append").parquet(source)
    latest = stream.latest(stream.read_stream(spark, source, schema, files_per_trigger=1))
    stream.replace_stream(latest, path, path + "-checkpoint").awaitTermination()
    assert rows(stream.replaced(spark, path)) == [("cpu", float(stream.KEPT_RESULTS + 3))]
    assert len(list((tmp_path / "out").glob("batch=*"))) == stream.KEPT_RESULTS


def test_run_metrics(spark):
    got = stream.run_metrics(spark, 7, T0, 12.5, 100, True)
    assert rows(got.select("metric_name", "value", "metric_type")) == [
        ("pipeline_execution_time", 12.5, "performance"), ("pipeline_success_rate", 1.0, "performance"),
        ("records_processed", 100.0, "business")]


def test_monitor_keeps_running(spark, tmp_path):
    """Rows that arrive while the loop runs reach the alerts; stopping leaves them readable."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "metric_name string, ts timestamp, value double, id long"

    def arrive(points):
        spark.createDataFrame([("cpu", T0 + timedelta(seconds=s), v, s) for s, v in points], schema).coalesce(1).write.mode(
            "append").parquet(source)

    arrive([(0, 0.9), (600, 0.9)])
    queries = stream.monitor(stream.read_stream(spark, source, schema), [HIGH], folder, every="1 second")
    try:
        arrive([(5000, 0.1), (9000, 0.95), (20_000, 0.1)])
        deadline = time.monotonic() + 120
        while time.monotonic() < deadline:
            assert all(q.isActive for q in queries)
            try:
                if stream.monitored_alerts(spark, [HIGH], folder).count() == 2:
                    break
            except AnalysisException:  # nothing written yet
                pass
            time.sleep(1)
        health = dict(rows(batch.health(spark.read.parquet(source), stream.monitored_alerts(spark, [HIGH], folder),
                                        batch.rules_frame(spark, [HIGH]), all(q.isActive for q in queries))))
        assert health["monitoring"] == "healthy"
    finally:
        for q in queries:
            q.stop()
    got = stream.monitored_alerts(spark, [HIGH], folder).orderBy("created_at").collect()
    assert [(r.created_at - T0).total_seconds() for r in got] == [30, 9030]
    assert (got[0].resolved_at - T0).total_seconds() == 5010
