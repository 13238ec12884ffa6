"""Raising and resolving alerts as a state machine per metric.

Every tick looks at the newest value of a metric: the first rule that fires raises an
alert unless one is active for the metric; then an alert older than the limit is resolved
if the first rule on the metric does not hold. Between ticks with data the newest value
stays, so such a stretch is skipped in one step.

Spark reduces the metric rows to one row per tick, then to the ticks where something
changes; only these reach Python. The history of a metric is cut into pieces of time, and a
task runs a piece, not a metric (`histories`): however long the history of one metric is, it
is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.metrics import histories
from sluice.metrics.batch import MonitoringRule, rules_frame
from sluice.operators.order import order_of
from sluice.operators.windows import window
from sluice.session import scratch_path

TICK_SECONDS = 30  # fixed value: length of a monitoring tick
RESOLVE_AFTER = 3600  # fixed value: an alert must be older than this to be resolved
PIECE_TICKS = 4096  # length of the pieces that a history is cut into

# tick and created are seconds since the epoch
EVENT_SCHEMA = "metric_name string, action string, tick long, created long, position int, current_value double"


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def tick_of(ts: Column, seconds: int = TICK_SECONDS) -> Column:
    """The first tick after a time, in epoch seconds."""
    return (F.floor(epoch(ts) / seconds) * seconds + seconds).cast("long")


def ticks(metrics: DataFrame, seconds: int = TICK_SECONDS) -> DataFrame:
    """The newest value per metric and tick, combined before the shuffle."""
    return metrics.groupBy("metric_name", tick_of(F.col("ts"), seconds).alias("tick")).agg(
        F.max_by("value", order_of(metrics, ["ts", "id"])).alias("value"))


def rule_holds(rule: MonitoringRule) -> Column:
    """Whether a rule holds for the column `value`; never for a disabled or mistyped rule."""
    v, limit = F.col("value"), rule.threshold
    hit = None
    if isinstance(limit, Mapping):
        inside = (v >= float(limit.get("min", "-inf"))) & (v <= float(limit.get("max", "inf")))
        hit = {"in_range": inside, "out_of_range": ~inside}.get(rule.condition)
    else:
        hit = {"greater_than": v > limit, "less_than": v < limit, "equals": v == limit,
               "not_equals": v != limit}.get(rule.condition)
    return hit if rule.enabled and hit is not None else F.lit(False)


def judge(ticked: DataFrame, rules: Sequence[MonitoringRule]) -> DataFrame:
    """Per tick: `fired`, the position of the first rule that fires (-1 for none), and
    `holds`, whether the first rule on the metric holds. Metrics without a rule are left
    out. Row-wise, so it serves batches and streams alike."""
    fired, holds = F.lit(-1), F.lit(None).cast("boolean")
    for position, rule in reversed(list(enumerate(rules))):  # the first rule is tested first
        mine = F.col("metric_name") == rule.metric_name
        fired = F.when(mine & rule_holds(rule), F.lit(position)).otherwise(fired)
        holds = F.when(mine, rule_holds(rule)).otherwise(holds)
    named = sorted({r.metric_name for r in rules})
    return ticked.filter(F.col("metric_name").isin(named)).select(
        "metric_name", "tick", "value", fired.alias("fired"), holds.alias("holds"))


def change_points(judged: DataFrame) -> DataFrame:
    """Ticks that can matter: where the verdict changes, those that fire without the first
    rule (an alert may be raised anew there, with the value of that tick), and the first one
    of every piece. A piece is compared in itself, so no window holds more than a piece."""
    w = Window.partitionBy("metric_name", "piece").orderBy("tick")
    same = (F.lag("fired").over(w) == F.col("fired")) & (F.lag("holds").over(w) == F.col("holds"))
    kept = judged.withColumn("_same", F.coalesce(same, F.lit(False)))
    return kept.filter(~F.col("_same") | ((F.col("fired") >= 0) & ~F.col("holds"))).drop("_same")


def advance(active: int | None, start: int, end: int, value: float, fired: int, holds: bool,
            step: int, resolve_after: int) -> tuple[int | None, list[tuple]]:
    """Run the ticks start, start + step, ... before `end`, over which the verdict stays.
    `active` is the creation tick of the active alert. Returns it and the events."""
    events, t = [], start
    while t < end:
        if active is None:
            if fired < 0:
                break
            active = t
            events.append(("raised", t, t, fired, value))
        if holds:
            break
        due = active + (resolve_after // step + 1) * step  # the first tick past the limit
        t = max(t, due)
        if t >= end:
            break
        events.append(("resolved", t, active, -1, value))
        active, t = None, t + step
    return active, events


def _stretches(rows: pd.DataFrame) -> list[tuple]:
    """(start, end, value, fired, holds) of a piece, in order; the last one ends where the next piece begins."""
    rows = rows.sort_values("tick")
    starts = [int(t) for t in rows["tick"]]
    return [(start, end, float(value), int(fired), bool(holds)) for start, end, value, fired, holds in zip(
        starts, [*starts[1:], int(rows["end"].iloc[0])], rows["value"], rows["fired"], rows["holds"])]


def _mapped(delays: histories.Delays, resolve_after: int):
    """A piece as a map. All cases run at once; those that have come to the same go on as one."""
    def per_piece(rows: pd.DataFrame) -> pd.DataFrame:
        stretches = _stretches(rows)
        first = stretches[0][0]
        cases = delays.examples(first)
        live = dict.fromkeys(cases)
        now = {a: a for a in cases}  # what each of the examples has become
        for start, end, *verdict in stretches:
            if verdict[2] and (verdict[1] < 0 or None not in live):
                continue  # nothing is resolved, and nothing raised
            moved = {a: advance(a, start, end, *verdict, delays.step, resolve_after)[0] for a in live}
            if any(a != b for a, b in moved.items()):
                now = {a: moved[b] for a, b in now.items()}
                live = dict.fromkeys(moved.values())
        return pd.DataFrame({"metric_name": [rows["metric_name"].iloc[0]], "piece": [int(rows["piece"].iloc[0])],
                             "first": [first], "outcome": [delays.codes(first, [now[a] for a in cases])]})

    return per_piece


def _replayed(step: int, resolve_after: int):
    def per_piece(rows: pd.DataFrame) -> pd.DataFrame:
        active, out = rows["active"].iloc[0], []
        active = None if pd.isna(active) else int(active)
        for start, end, *verdict in _stretches(rows):
            active, events = advance(active, start, end, *verdict, step, resolve_after)
            out += events
        frame = pd.DataFrame(out, columns=["action", "tick", "created", "position", "current_value"])
        frame.insert(0, "metric_name", rows["metric_name"].iloc[0])
        return frame

    return per_piece


def alert_events(metrics: DataFrame, rules: Sequence[MonitoringRule], as_of: datetime, seconds: int = TICK_SECONDS,
                 resolve_after: int = RESOLVE_AFTER, piece_ticks: int = PIECE_TICKS, group: int = histories.GROUP) -> DataFrame:
    """`raised` and `resolved` events of every metric up to `as_of`.

    The ticks that matter are written to the scratch folder when this is called. Pieces have
    `piece_ticks` ticks, or as many as an alert must be old to be resolved, if these are more;
    `group` pieces are composed at a time. Neither changes the events.
    """
    until = int((as_of - datetime(1970, 1, 1)).total_seconds())
    delays = histories.Delays(seconds, resolve_after // seconds + 1)
    length = max(piece_ticks, delays.cases) * seconds
    spark, path = metrics.sparkSession, scratch_path(metrics.sparkSession, "alert-ticks")
    upto = judge(ticks(metrics, seconds).filter(F.col("tick") <= until), rules)
    points = change_points(upto.withColumn("piece", F.floor(F.col("tick") / length)))
    points.write.parquet(path)
    points = spark.read.schema(points.schema).parquet(path)

    key = ["metric_name", "piece"]
    low, high = points.agg(F.min("piece"), F.max("piece")).first()
    points = points.withColumn("piece", F.col("piece") - F.lit(low or 0))
    count = 1 + (high or 0) - (low or 0)
    firsts = points.groupBy(*key).agg(F.min("tick").alias("first"))
    ends = window(firsts, "lead", "end", "first", ["metric_name"], ["piece"],
                  bucket=F.floor(F.col("piece") / group) if count > group else None)
    pieces = points.join(ends.select(*key, F.coalesce("end", F.lit(until + 1)).alias("end")), key)
    if count == 1:  # nothing comes into any piece
        entered = pieces.withColumn("active", F.lit(None).cast("long"))
    else:
        maps = pieces.groupBy(*key).applyInPandas(_mapped(delays, resolve_after), histories.MAP)
        entered = pieces.join(histories.entering(maps, count, delays, group), key)
    return entered.groupBy(*key).applyInPandas(_replayed(seconds, resolve_after), EVENT_SCHEMA)


def alerts_from_events(events: DataFrame, rules: Sequence[MonitoringRule]) -> DataFrame:
    """One row per alert, with the rule's name, severity and message."""
    def at(seconds: Column) -> Column:
        return F.timestamp_seconds(seconds).cast("timestamp_ntz")

    raised = F.col("action") == "raised"
    folded = events.where("action <> 'late'").groupBy("metric_name", "created").agg(
        F.max(F.when(raised, F.col("position"))).alias("position"),
        F.max(F.when(raised, F.col("current_value"))).alias("current_value"),
        F.max(F.when(~raised, F.col("tick"))).alias("resolved"),
    )
    shown = F.when(F.col("threshold").isNotNull(), F.col("threshold").cast("string")).otherwise(
        F.format_string("{'min': %s, 'max': %s}", F.col("min_value").cast("string"), F.col("max_value").cast("string")))
    table = rules_frame(events.sparkSession, rules).drop("metric_name")  # made in code: small
    return folded.join(F.broadcast(table), "position").select(
        F.concat_ws("_", "rule_id", F.col("created").cast("string")).alias("alert_id"),
        "rule_id", F.col("rule_name").alias("alert_name"), "severity", "metric_name",
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "current_value",
        F.concat("description", F.lit(". Current value: "), F.col("current_value").cast("string"),
                 F.lit(", Threshold: "), shown).alias("message"),
        at(F.col("created")).alias("created_at"), at(F.col("resolved")).alias("resolved_at"),
        F.lit(False).alias("acknowledged"),
    )


def alerts(metrics: DataFrame, rules: Sequence[MonitoringRule], as_of: datetime, seconds: int = TICK_SECONDS,
           resolve_after: int = RESOLVE_AFTER) -> DataFrame:
    """One row per alert raised up to `as_of`; resolved_at is null while it is active."""
    return alerts_from_events(alert_events(metrics, rules, as_of, seconds, resolve_after), rules)


STATE_SCHEMA = "active long, next_tick long, value double, fired int, holds boolean"


def stateful(step: int = TICK_SECONDS, resolve_after: int = RESOLVE_AFTER):
    """The same machine for applyInPandasWithState: the state is the active alert and the
    last verdict, which holds until the next tick with data. While an alert is active or due, a
    timer on the watermark runs the ticks of a metric that has fallen silent. A tick behind the
    state gives a `late` event and changes nothing."""
    def per_metric(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [] if state.hasTimedOut else pd.concat(list(batches)).sort_values("tick").itertuples(index=False)
        active = last = None
        if state.exists:
            created, next_tick, *verdict = state.get
            active, last = (None if created < 0 else created), (next_tick, *verdict)
        out = []
        for row in rows:
            tick = int(row.tick)
            if last is not None:
                if tick < last[0]:
                    out.append(("late", tick, -1, -1, float(row.value)))
                    continue
                active, events = advance(active, last[0], tick, *last[1:], step, resolve_after)
                out += events
            verdict = (float(row.value), int(row.fired), bool(row.holds))
            active, events = advance(active, tick, tick + step, *verdict, step, resolve_after)
            out += events
            last = (tick + step, *verdict)
        now = state.getCurrentWatermarkMs() // 1000
        if last[0] <= now:
            following = last[0] + ((now - last[0]) // step + 1) * step
            active, events = advance(active, last[0], following, *last[1:], step, resolve_after)
            out += events
            last = (following, *last[1:])
        if active is not None or last[2] >= 0:
            state.setTimeoutTimestamp(last[0] * 1000)
        state.update((-1 if active is None else active, *last))
        if out:
            frame = pd.DataFrame(out, columns=["action", "tick", "created", "position", "current_value"])
            frame.insert(0, "metric_name", key[0])
            yield frame

    return per_metric
