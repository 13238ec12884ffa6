"""Steps over tables: chained steps, steps with named inputs, and spec files.

Steps only build plans; Spark does the running when a result is written or read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.spec import run_spec
from sluice.quality.report import report
from sluice.quality.rules import Rule, assess
from sluice.session import scratch_path
from sluice.sources.files import load, query, save


@dataclass
class StepResult:
    step: str
    success: bool
    rows_processed: int = 0
    execution_time: float = 0.0
    error: str | None = None


@dataclass
class RunResult:
    success: bool
    results: list[StepResult] = field(default_factory=list)
    execution_time: float = 0.0

    @property
    def steps_completed(self) -> int:
        return sum(r.success for r in self.results)

    @property
    def total_rows_processed(self) -> int:
        return sum(r.rows_processed for r in self.results)


def chain(df: DataFrame, steps: Sequence[Mapping[str, Any]], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Steps {name, operations} one after the other, as one lazy plan."""
    for step in steps:
        df = run_spec(df, step["operations"], tables)
    return df


def run_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]], path: str,
              tables: Mapping[str, DataFrame] | None = None, per_step: bool = False, **save_options: Any) -> RunResult:
    """Chain the steps, write the result, stop at the first failure and report each step.

    All steps run as one plan and the rows written are the last step's. With `per_step`
    every step but the last is written to the shared scratch folder and the next one reads
    it: rows and seconds are then known for each step, a failure names its step, and a lost
    executor costs at most one step. (Counting inside one plan would be wrong: a sort
    samples its input first, and a recomputed shuffle stage counts its rows again.)
    """
    started, results = time.monotonic(), []
    for i, step in enumerate(steps):
        began, last = time.monotonic(), i == len(steps) - 1
        result = StepResult(step.get("name", f"step_{i}"), True)
        results.append(result)
        try:
            df = run_spec(df, step["operations"], tables)
            if last:
                result.rows_processed = save(df, path, **save_options).get["rows"]
            elif per_step:
                between = scratch_path(df.sparkSession, "step")
                result.rows_processed = save(df, between, "parquet").get["rows"]
                df = df.sparkSession.read.schema(df.schema).parquet(between)
        except Exception as e:  # noqa: BLE001 - reported as the step's result
            result.success, result.error = False, str(e)
        result.execution_time = time.monotonic() - began
        if not result.success:
            break
    return RunResult(all(r.success for r in results), results, time.monotonic() - started)


def run_task(spark: SparkSession, task: Mapping[str, Any]) -> tuple[DataFrame | None, StepResult]:
    """One data task {type, data}: sql_query, data_load or data_transformation. The frame is
    lazy; the result row tells whether it could be planned and how long that took."""
    started, kind, data = time.monotonic(), task["type"], task["data"]
    try:
        if kind == "sql_query":
            df = query(spark, data["query"], data.get("parameters"), data.get("tables"))
        elif kind == "data_load":
            df = load(spark, data["source"], data.get("format", "auto"), data.get("options"))
        elif kind == "data_transformation":
            df = run_spec(data["source_data"], data["transformation"]["operations"], data.get("tables"))
        else:
            raise ValueError(f"unknown task type {kind!r}")
    except Exception as e:  # noqa: BLE001 - reported as the task's result
        return None, StepResult(kind, False, 0, time.monotonic() - started, str(e))
    return df, StepResult(kind, True, 0, time.monotonic() - started)


def run_graph(steps: Sequence[Mapping[str, Any]], inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Steps {name, input, operations} where `input` (and the tables an operation joins or
    unions) are names of inputs or of other steps. Returns every step's lazy frame; a cycle
    or an unknown name is an error. A step used by several others is planned once per use,
    and Spark reuses the shared exchanges."""
    by_name = {s["name"]: s for s in steps}

    def needs(step: Mapping[str, Any]) -> set[str]:
        named = {step["input"]}
        for op in step["operations"]:
            config = op.get("config", {})
            named |= {config["right_table"]} if "right_table" in config else set(config.get("tables", []))
        return named

    graph = {name: needs(s) for name, s in by_name.items()}
    unknown = set().union(*graph.values()) - set(by_name) - set(inputs)
    if unknown:
        raise KeyError(f"unknown inputs: {sorted(unknown)}")
    frames = dict(inputs)
    for name in TopologicalSorter(graph).static_order():  # raises CycleError
        if name in by_name:
            step = by_name[name]
            frames[name] = run_spec(frames[step["input"]], step["operations"], frames)
    return {name: frames[name] for name in by_name}


def read_spec_file(path: str) -> dict[str, Any]:
    """A JSON or YAML spec file (YAML needs PyYAML)."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def run_file_spec(spark: SparkSession, spec: Mapping[str, Any]) -> tuple[RunResult, DataFrame | None]:
    """Load -> transform -> check -> save, from {name, source, target, tables, transformations,
    quality_rules}. `source` and `target` are {path, format, options}; a transformation may
    also be written flat, as {type, column | key_columns}. Returns the run and the quality
    report over the saved result."""
    source, target = spec["source"], spec["target"]
    df = load(spark, source["path"], source.get("format", "auto"), source.get("options"))
    tables = {n: load(spark, p) for n, p in spec.get("tables", {}).items()}
    operations = []
    for t in spec.get("transformations", []):
        columns = t.get("source_columns") or t.get("key_columns") or ([t["column"]] if "column" in t else [])
        operations.append({**t, "source_columns": columns})
    result = run_steps(df, [{"name": spec.get("name", "transform"), "operations": operations}], target["path"], tables,
                       file_format=target.get("format", "auto"), options=target.get("options"))
    rules = [r if isinstance(r, Rule) else Rule(**r) for r in spec.get("quality_rules", [])]
    if not (result.success and rules):
        return result, None
    saved = load(spark, target["path"], target.get("format", "auto"))
    return result, report(assess(saved, rules, tables))
