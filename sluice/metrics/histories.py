"""A state machine over histories of any length: pieces become maps, maps are composed, pieces are replayed.

The history of a metric is cut by time into pieces. What a piece does depends on what comes in only through a bounded
number of cases (no alert; an alert that is due at the first tick of the piece, one tick later, ... or after the limit),
so a piece is a map from cases to outcomes, and the maps of neighbouring pieces compose to a map. Maps are composed in
groups, groups of groups, and so on; on the way back each piece learns what comes in, and then all pieces run at once.
No task ever holds the history of a metric, nor a row for each of its pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 256  # maps that one task composes at a time

# What a map says besides the creation tick of a new alert: no alert is active, or the one that came in still is.
NOBODY, SAME = -(1 << 62), -(1 << 62) + 1


@dataclass(frozen=True)
class Delays:
    """Ticks of `step` seconds; an alert can be resolved `cases` ticks after its creation, or later."""
    step: int
    cases: int

    def case(self, active: int | None, first: int) -> int:
        """The case of what comes into a piece that begins at `first`."""
        return self.cases if active is None else max(0, (active - first) // self.step + self.cases)

    def examples(self, first: int) -> list[int | None]:
        """For each case, something that falls under it. Creation ticks are before `first`."""
        return [first + (c - self.cases) * self.step for c in range(self.cases)] + [None]

    def map_of(self, first: int, run: Callable[[int | None], int | None]) -> list[int]:
        """The map of a piece from what it makes of the examples."""
        return self.codes(first, [run(a) for a in self.examples(first)])

    @staticmethod
    def codes(first: int, outcomes: Iterable[int | None]) -> list[int]:
        return [NOBODY if a is None else SAME if a < first else a for a in outcomes]

    def apply(self, outcome: Sequence[int], first: int, active: int | None) -> int | None:
        code = int(outcome[self.case(active, first)])
        return None if code == NOBODY else active if code == SAME else code


MAP = "metric_name string, piece long, first long, outcome array<long>"


def _upper(level: DataFrame, delays: Delays, group: int) -> DataFrame:
    """One map for every `group` neighbouring pieces."""
    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        first, parts = int(rows["first"].iloc[0]), list(zip(rows["first"], rows["outcome"]))

        def through(active: int | None) -> int | None:
            for begin, outcome in parts:
                active = delays.apply(outcome, int(begin), active)
            return active

        return pd.DataFrame({"metric_name": [rows["metric_name"].iloc[0]], "piece": [int(rows["piece"].iloc[0]) // group],
                             "first": [first], "outcome": [delays.map_of(first, through)]})

    return level.groupBy("metric_name", F.floor(F.col("piece") / group)).applyInPandas(compose, MAP)


def _entered(level: DataFrame, above: DataFrame | None, delays: Delays, group: int) -> DataFrame:
    """(metric_name, piece, active): what comes into each piece, from what comes into each group of pieces."""
    over = level.withColumn("over", F.floor(F.col("piece") / group))
    if above is None:
        over = over.withColumn("active", F.lit(None).cast("long"))
    else:
        over = over.join(above.withColumnRenamed("piece", "over"), ["metric_name", "over"])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        active, out = rows["active"].iloc[0], []
        active = None if pd.isna(active) else int(active)
        for first, outcome in zip(rows["first"], rows["outcome"]):
            out.append(active)
            active = delays.apply(outcome, int(first), active)
        return pd.DataFrame({"metric_name": rows["metric_name"], "piece": rows["piece"],
                             "active": pd.array(out, dtype="Int64")})

    return over.groupBy("metric_name", "over").applyInPandas(walk, "metric_name string, piece long, active long")


def entering(maps: DataFrame, pieces: int, delays: Delays, group: int = GROUP) -> DataFrame:
    """(metric_name, piece, active): the alert that is active where each piece begins, null for none.

    `maps` has (metric_name, piece, first, outcome), and pieces are numbered below `pieces`. Nothing comes into the first
    piece of a metric.
    """
    levels = [maps]
    while pieces > group:
        levels.append(_upper(levels[-1], delays, group))
        pieces = -(-pieces // group)
    active = None
    for level in reversed(levels):
        active = _entered(level, active, delays, group)
    return active
