"""An ordered list of operations as one lazy plan.

An operation is {type, source_columns, target_columns, config}. They run in list order: a
filter after an aggregate acts on groups. Catalyst reorders what it safely can.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import cleaning
from sluice.operators import aggregates, joins, rows, windows
from sluice.quality.dedup import drop_duplicates
from sluice.quality.rules import Rule, mark_rows

Operation = Mapping[str, Any]
Tables = Mapping[str, DataFrame]


def _join(df: DataFrame, cols: list[str], c: dict, tables: Tables) -> DataFrame:
    if c["right_table"] not in tables:
        raise KeyError(f"join: table {c['right_table']!r} was not given")
    on = c.get("on") or cols or c.get("condition")
    return joins.join(df, tables[c["right_table"]], on, c.get("join_type", "inner"), small=c.get("small"))


def _aggregate(df: DataFrame, cols: list[str], c: dict, tables: Tables) -> DataFrame:
    if "measures" in c:
        return aggregates.multi_aggregate(df, [tuple(m) for m in c["measures"]], c.get("group_by", []),
                                          c.get("order", []))
    return aggregates.aggregate(df, cols, c.get("function"), c.get("group_by", []), c.get("order", []))


def _window(df: DataFrame, cols: list[str], c: dict, tables: Tables) -> DataFrame:
    bucket = c.get("bucket") or None  # "auto", or an expression
    frame = tuple(c["frame"]) if c.get("frame") else None
    return windows.window(df, c.get("function", "rank"), c["alias"], cols[0] if cols else None, c.get("partition", []),
                          c.get("order", []), c.get("offset", 1), c.get("descending", False), frame, bucket,
                          c.get("few_groups", False))


def _union(df: DataFrame, cols: list[str], c: dict, tables: Tables) -> DataFrame:
    return rows.union([df, *[tables[t] for t in c["tables"]]], c.get("distinct", False), c.get("allow_missing", False))


def _clean(df: DataFrame, cols: list[str], c: dict, tables: Tables) -> DataFrame:
    steps = [s if isinstance(s, str) else (s[0], s[1]) for s in c.get("steps", ["trim_whitespace"])]
    return rows.clean(df, {col: steps for col in cols})


OPERATIONS: dict[str, Callable[[DataFrame, list[str], dict, Tables], DataFrame]] = {
    "select": lambda df, cols, c, t: rows.select(df, cols),
    "filter": lambda df, cols, c, t: rows.where(df, c["condition"]),
    "derive": lambda df, cols, c, t: rows.derive(df, c["columns"]),
    "cast": lambda df, cols, c, t: rows.cast(df, c["types"], c.get("strict", False)),
    "case_when": lambda df, cols, c, t: rows.case_when(df, c["name"], c["branches"], c.get("otherwise")),
    "format": lambda df, cols, c, t: rows.format_columns(df, c["formats"]),
    "clean": _clean,
    "validate": lambda df, cols, c, t: mark_rows(df, [r if isinstance(r, Rule) else Rule(**r) for r in c["rules"]]),
    "keep_last": lambda df, cols, c, t: rows.keep_last(df, cols[0], c["n"], c["unit"], c.get("until")),
    "join": _join,
    "aggregate": _aggregate,
    "group": lambda df, cols, c, t: aggregates.group_keys(df, cols),
    "pivot": lambda df, cols, c, t: aggregates.pivot(df, cols, c["on"], c["values"], c["measures"]),
    "unpivot": lambda df, cols, c, t: aggregates.unpivot(df, c["ids"], cols, c.get("name", "variable"),
                                                         c.get("value", "value")),
    "window": _window,
    "rank": lambda df, cols, c, t: _window(df, cols, {"function": "rank", "alias": "rank", **c}, t),
    "sort": lambda df, cols, c, t: rows.sort(df, cols, c.get("ascending", True), c.get("nulls", "last")),
    "limit": lambda df, cols, c, t: rows.limit(df, c["n"]),
    "union": _union,
    "phone_cleanup": lambda df, cols, c, t: df.withColumns({x: cleaning.clean_phone(x) for x in cols}),
    "deduplication": lambda df, cols, c, t: drop_duplicates(df, cols, c.get("order", [])),
}


def run_spec(df: DataFrame, operations: Sequence[Operation], tables: Tables | None = None) -> DataFrame:
    """Apply the operations in order. A `group` sets the keys of an `aggregate` right after it."""
    tables, keys = tables or {}, None
    for i, op in enumerate(operations):
        kind, config = op["type"], dict(op.get("config", {}))
        if kind not in OPERATIONS:
            raise ValueError(f"unknown operation {kind!r}; one of {sorted(OPERATIONS)}")
        following = operations[i + 1]["type"] if i + 1 < len(operations) else None
        if kind == "group" and following == "aggregate":
            keys = list(op["source_columns"])
            continue
        if kind == "aggregate" and keys:
            config.setdefault("group_by", keys)
        keys = None
        df = OPERATIONS[kind](df, list(op.get("source_columns", [])), config, tables)
        if op.get("target_columns") and kind == "select":
            df = df.toDF(*op["target_columns"])
    return df


def check_spec(df: DataFrame, operations: Sequence[Operation], tables: Tables | None = None) -> list[dict[str, Any]]:
    """Resolve the plan step by step, without running it: one entry per operation with
    `ok`, the resulting columns, or the error (unknown columns, wrong types)."""
    report = []
    for i, op in enumerate(operations):
        entry = {"position": i, "type": op.get("type"), "ok": True, "columns": [], "error": None}
        try:
            entry["columns"] = run_spec(df, operations[: i + 1], tables).columns
        except (AnalysisException, ValueError, KeyError) as e:
            entry |= {"ok": False, "error": str(e)}
        report.append(entry)
        if not entry["ok"]:
            break
    return report
