"""Metric streams: collection, newest values, sliding means, ticks, alerts, run metrics.

A metric stream has the columns metric_name, ts (timestamp), value and id. Sinks are
folders, or the state store itself; nothing is kept in driver memory. Trigger `availableNow`
processes what is there and stops; pass `every` for a stream that keeps running.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from datetime import datetime
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sluice.metrics import alerts
from sluice.metrics.batch import KEEP_VALUES, MonitoringRule, retain_values, with_types
from sluice.operators.order import order_of


def read_stream(spark: SparkSession, path: str, schema, file_format: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def as_metrics(stream: DataFrame, name: str, ts: str, value: str, row_id: str) -> DataFrame:
    """Rename to the metric columns. A watermark needs a `timestamp`, so `timestamp_ntz` is cast."""
    return stream.select(F.col(name).alias("metric_name"), F.col(ts).cast("timestamp").alias("ts"),
                         F.col(value).alias("value"), F.col(row_id).alias("id"))


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


KEPT_RESULTS = 10  # complete results that stay, so that a reader may be that many triggers late
PARTS = 8  # tasks that share one metric's retained values
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replace_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the whole result again at each trigger (complete mode): for small results only.

    Every batch has a folder of its own; `replaced` reads the newest one that is complete, and
    folders before the last few are deleted.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        for old in _complete(spark, path)[:-KEPT_RESULTS]:
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    writer = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _complete(spark: SparkSession, path: str) -> list[str]:
    """The complete batch folders, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    return sorted(f.getPath().getParent().toString() for f in found or [])


def replaced(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result that `replace_stream` has written."""
    complete = _complete(spark, path)
    if not complete:
        raise FileNotFoundError(f"no complete batch in {path}")
    return spark.read.parquet(complete[-1])


class _Newest(StatefulProcessor):
    """Keeps the newest rows of a key in list state: by the first column, then by the second, nulls oldest."""

    def __init__(self, keep: int, schema: T.StructType) -> None:
        self.keep, self.schema = keep, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key: Row, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        def age(row: tuple) -> tuple:
            return tuple((v is not None, v) for v in row[:2])

        held = (tuple(r) for r in self.kept.get()) if self.kept.exists() else ()
        new = (tuple(r[n] for n in self.schema.names) for r in rows)
        self.kept.put(heapq.nlargest(self.keep, chain(held, new), key=age))
        return iter([])

    def close(self) -> None:
        pass


def _stored(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    """The columns of a metric row beside its name, order columns first; times as microseconds."""
    names = ["ts", "id", *(f.name for f in schema.fields if f.name not in ("metric_name", "ts", "id"))]
    return [(n, T.LongType() if isinstance(schema[n].dataType, T.TimestampType) else schema[n].dataType) for n in names]


def retain(stream: DataFrame, checkpoint: str, keep: int = KEEP_VALUES, every: str | None = None) -> StreamingQuery:
    """Keep the last `keep` values of each metric, in the state of the query: list state on RocksDB, read by `retained`.

    Nothing is written besides the state, which Spark retires by itself, so a stream may run for any time. A metric is
    dealt out over PARTS keys that keep `keep` values each, so a hot one is shared by as many tasks; that is also the
    bound on the state. A query that starts again on its checkpoint goes on where it was.
    """
    spark, stored = stream.sparkSession, _stored(stream.schema)
    columns = [F.unix_micros(n).alias(n) if isinstance(stream.schema[n].dataType, T.TimestampType) else F.col(n) for n, _ in stored]
    dealt = stream.select("metric_name", F.pmod(F.xxhash64("ts", "id"), F.lit(PARTS)).cast("int").alias("part"), *columns)
    newest = _Newest(keep, T.StructType([T.StructField(n, kind) for n, kind in stored]))
    state = dealt.groupBy("metric_name", "part").transformWithState(newest, "metric_name string", "Append", "None")
    writer = state.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)  # a query takes its settings with it when it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def retained(spark: SparkSession, checkpoint: str, schema: T.StructType, keep: int = KEEP_VALUES) -> DataFrame:
    """The values that `retain` keeps, as of its last finished trigger. `schema` is that of its stream."""
    state = spark.read.format("statestore").option("stateVarName", "kept").load(checkpoint)
    named = [F.timestamp_micros(f"list_element.{f.name}").alias(f.name) if isinstance(f.dataType, T.TimestampType)
             else F.col("key.metric_name") if f.name == "metric_name" else F.col(f"list_element.{f.name}") for f in schema.fields]
    return retain_values(state.select(*named), keep)


def collect(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append metric rows, with their type, to the metric table."""
    return write_stream(with_types(stream), path, checkpoint, every)


def latest(stream: DataFrame) -> DataFrame:
    """The newest value per metric so far; the state is one row per metric."""
    return stream.groupBy("metric_name").agg(F.max_by("value", order_of(stream, ["ts", "id"])).alias("current_value"))


def window_average(stream: DataFrame, length: str = "5 minutes", slide: str | None = None,
                   late: str = "10 minutes") -> DataFrame:
    """Mean and count per metric and window. Rows later than `late` are dropped, and a
    window is emitted and forgotten once the watermark passes its end."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = stream.withWatermark("ts", late).groupBy("metric_name", w.alias("w")).agg(
        F.avg("value").alias("average"), F.count("value").alias("count"))
    return out.select("metric_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "average", "count")


def ticks(stream: DataFrame, seconds: int = alerts.TICK_SECONDS, late: str = "1 minute") -> DataFrame:
    """The newest value per metric and tick, emitted when the watermark passes the tick."""
    out = stream.withWatermark("ts", late).groupBy("metric_name", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.max_by("value", order_of(stream, ["ts", "id"])).alias("value"))
    return out.select("metric_name", F.unix_seconds("w.end").alias("tick"), "value")


def alert_events(tick_stream: DataFrame, rules: Sequence[MonitoringRule], seconds: int = alerts.TICK_SECONDS,
                 resolve_after: int = alerts.RESOLVE_AFTER) -> DataFrame:
    """Raised and resolved events from a stream of ticks (the folder `ticks` is written to).
    The state machine is the only stateful operator of the query. The newest tick of any metric
    is the time for all of them, so an alert on a metric without new values is resolved too."""
    judged = alerts.judge(tick_stream, rules).withColumn("at", F.timestamp_seconds("tick")).withWatermark("at", "0 seconds")
    return judged.groupBy("metric_name").applyInPandasWithState(
        alerts.stateful(seconds, resolve_after), alerts.EVENT_SCHEMA, alerts.STATE_SCHEMA, "append", "EventTimeTimeout")


def monitor(stream: DataFrame, rules: Sequence[MonitoringRule], folder: str, every: str | None = None,
            seconds: int = alerts.TICK_SECONDS, late: str = "1 minute") -> list[StreamingQuery]:
    """The monitoring loop: one query writes ticks to `folder/ticks`, a second one reads them
    and writes events to `folder/alert-events`. With `every` ("30 seconds") both keep running;
    without it, what is there is processed to the end."""
    spark, tick_path = stream.sparkSession, f"{folder}/ticks"
    ticked = ticks(stream, seconds, late)
    first = write_stream(ticked, tick_path, f"{folder}/ticks-checkpoint", every)
    if every is None:
        first.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(tick_path)  # a stream reads only folders that exist
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    events = alert_events(read_stream(spark, tick_path, ticked.schema), rules, seconds)
    second = write_stream(events, f"{folder}/alert-events", f"{folder}/alert-events-checkpoint", every)
    if every is None:
        second.awaitTermination()
    return [first, second]


def monitored_alerts(spark: SparkSession, rules: Sequence[MonitoringRule], folder: str) -> DataFrame:
    """The alerts a monitoring loop has written so far."""
    events = spark.read.schema(alerts.EVENT_SCHEMA).parquet(f"{folder}/alert-events")
    return alerts.alerts_from_events(events, rules)


def progress_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Metric rows from a query's recent triggers: rows, rows per second and seconds."""
    rows = []
    for p in query.recentProgress:
        ts = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00"))
        batch = int(p["batchId"])
        rows += [
            ("records_processed", ts, float(p["numInputRows"]), batch),
            ("pipeline_execution_time", ts, p["durationMs"].get("triggerExecution", 0) / 1000, batch),
        ]
    return with_types(spark.createDataFrame(rows, "metric_name string, ts timestamp, value double, id long"))


def run_metrics(spark: SparkSession, run_id: int, ended: datetime, seconds: float, rows: int, success: bool) -> DataFrame:
    """Metric rows of one finished batch run."""
    data = [
        ("pipeline_execution_time", ended, float(seconds), run_id),
        ("records_processed", ended, float(rows), run_id),
        ("pipeline_success_rate", ended, 1.0 if success else 0.0, run_id),
    ]
    return with_types(spark.createDataFrame(data, "metric_name string, ts timestamp_ntz, value double, id long"))
