import json
import random
import re
import time
from graphlib import CycleError

import pytest

from sluice.plans.requests import (COLUMN_PATTERNS, CONDITION_PATTERNS, OPERATION_PATTERNS, SOURCE_PATTERNS, TIME_WORDS,
                                   count_by_kind, tag_requests)
from sluice.plans.steps import read_spec_file, run_file_spec, run_graph, run_steps, run_task
from tests.conftest import rows


def op(condition):
    return {"type": "filter", "config": {"condition": condition}}


def test_rows_per_step_survive_a_sort(spark, tmp_path):
    """A sort samples its input first; the rows must not be counted twice."""
    steps = [{"name": "half", "operations": [op("id % 2 = 0")]},
             {"name": "sorted", "operations": [{"type": "sort", "source_columns": ["id"], "config": {"ascending": False}}]},
             {"operations": [op("id > 10")]}]
    run = run_steps(spark.range(1000).repartition(6), steps, str(tmp_path / "o.parquet"), per_step=True)
    assert run.success and [(r.step, r.rows_processed) for r in run.results] == [
        ("half", 500), ("sorted", 500), ("step_2", 494)]
    assert (run.steps_completed, run.total_rows_processed) == (3, 1494)
    run = run_steps(spark.range(1000).repartition(6), steps, str(tmp_path / "p.parquet"))
    assert run.total_rows_processed == 494 == spark.read.parquet(str(tmp_path / "p.parquet")).count()


def test_stops_at_the_first_failure(spark, tmp_path):
    steps = [{"name": "ok", "operations": [op("id > 1")]}, {"name": "bad", "operations": [op("missing > 1")]},
             {"name": "never", "operations": []}]
    run = run_steps(spark.range(10), steps, str(tmp_path / "o.parquet"))
    assert not run.success and [(r.step, r.success) for r in run.results] == [("ok", True), ("bad", False)]
    assert "missing" in run.results[1].error


def test_runtime_failure_is_reported(spark, tmp_path):
    steps = [{"name": "boom", "operations": [{"type": "derive", "config": {"columns": {"x": "raise_error('boom')"}}}]}]
    run = run_steps(spark.range(10), steps, str(tmp_path / "o.parquet"))
    assert not run.success and "boom" in run.results[0].error and run.steps_completed == 0


def test_tasks(spark, sf):
    df, result = run_task(spark, {"type": "sql_query", "data": {
        "query": "SELECT count(*) AS n FROM regions WHERE r_regionkey < :k", "parameters": {"k": 3},
        "tables": {"regions": f"{sf}/region.parquet"}}})
    assert result.success and rows(df) == [(3,)]
    df, result = run_task(spark, {"type": "data_load", "data": {"source": f"{sf}/nation.parquet"}})
    assert df.count() == 25
    df, result = run_task(spark, {"type": "data_transformation", "data": {
        "source_data": df, "transformation": {"operations": [op("n_regionkey = 1")]}}})
    assert df.count() == 5
    df, result = run_task(spark, {"type": "sql_query", "data": {"query": "SELECT nothing"}})
    assert df is None and not result.success and "nothing" in result.error


def test_graph(spark):
    frames = {"a": spark.range(10), "b": spark.range(5, 20)}
    steps = [{"name": "z", "input": "y", "operations": [{"type": "join", "source_columns": ["id"],
                                                         "config": {"right_table": "x"}}]},
             {"name": "x", "input": "a", "operations": [op("id > 3")]},
             {"name": "y", "input": "b", "operations": [op("id < 9")]}]
    assert rows(run_graph(steps, frames)["z"]) == [(5,), (6,), (7,), (8,)]
    with pytest.raises(CycleError):
        run_graph([{"name": "p", "input": "q", "operations": []}, {"name": "q", "input": "p", "operations": []}], {})
    with pytest.raises(KeyError, match="unknown inputs"):
        run_graph([{"name": "p", "input": "nowhere", "operations": []}], {})


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_spec_file(spark, tmp_path, kind):
    (tmp_path / "in.csv").write_text(
        "customer_id,email,phone_number\n1,a@b.com,(555) 123-4567\n1,a@b.com,(555) 123-4567\n2,c@d.com,12\n")
    spec = {
        "name": "sample", "source": {"path": str(tmp_path / "in.csv")}, "target": {"path": str(tmp_path / "out.parquet")},
        "transformations": [{"type": "phone_cleanup", "column": "phone_number"},
                            {"type": "deduplication", "key_columns": ["email", "customer_id"]}],
        "quality_rules": [{"rule_id": "phone_completeness", "rule_type": "completeness", "column": "phone_number"}],
        "schedule": "manual"}
    path = tmp_path / f"spec.{kind}"
    if kind == "json":
        path.write_text(json.dumps(spec))
    else:
        path.write_text(pytest.importorskip("yaml").safe_dump(spec))
    run, checked = run_file_spec(spark, read_spec_file(str(path)))
    assert run.success and run.total_rows_processed == 2
    assert checked.first().recommendations == [
        "Improve data completeness for phone_completeness (current: 50.00%)"]
    assert rows(spark.read.parquet(spec["target"]["path"]).select("customer_id", "phone_number")) == [
        (1, "+15551234567"), (2, None)]


REQUESTS = [
    ("Move customer data from MySQL to Snowflake", ["extract"], ["mysql", "snowflake"], [], [], "medium"),
    ("extract customers from mysql_db", ["extract"], ["mysql_db"], [], [], "simple"),
    ("clean phone_numbers and normalize addresses", ["transform"], [], ["phone_numbers", "addresses"], [], "simple"),
    ("run daily customer report", ["schedule"], [], [], [], "simple"),
    ("Move last 30 days of customer orders from MySQL to Snowflake, clean the phone numbers, and create a daily summary table",
     ["extract", "transform", "schedule", "filter"], ["mysql", "snowflake", "summary"], ["the"], ["30 days"], "complex"),
    ("get it from today", [], [], [], [], "simple"),
    ("", [], [], [], [], "simple"),
]


def test_requests(spark):
    df = spark.createDataFrame([(r[0],) for r in REQUESTS], "text string")
    got = {r.text: (r.operations, r.sources, r.columns, r.conditions, r.complexity)
           for r in tag_requests(df, "text").collect()}
    for text, operations, sources, columns, conditions, complexity in REQUESTS:
        if text.startswith("get it"):
            assert got[text][0] == ["extract"] and got[text][1] == []
            continue
        assert got[text] == (operations, sources, columns, conditions, complexity), text
    kinds = {(r.complexity, r.kind): r.requests for r in count_by_kind(tag_requests(df, "text")).collect()}
    assert kinds[("complex", "schedule")] == 1 and kinds[("simple", "extract")] == 2


def test_linear_patterns_find_the_same(spark):
    """Against the patterns as they are written, over random requests with all kinds of white space."""
    rng = random.Random(4)
    words = ["get", "target", "join", "save", "move", "copy", "from", "to", "into", "with", "x", "1a", "a1", "7", "07", "table",
             "views", "tableview", "column", "field", "days", "weeks", "ago", "last", "é", "clean", "a_b-c"]
    spaces = [" ", " ", " ", "\n", "\n", " \n", "  ", "   ", "\n\n", " \n ", "\n  \n", "  \n", "", "     ", "\n \n \n"]
    texts = sorted({"".join(w for _ in range(rng.randrange(1, 11)) for w in (rng.choice(words), rng.choice(spaces))).strip(" \n")
                    for _ in range(6000)})
    got = tag_requests(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    for r in got:
        kinds = [k for k, patterns in OPERATION_PATTERNS.items() for p in patterns if re.search(p, r.text)]
        sources = [w for p in SOURCE_PATTERNS for w in re.findall(p, r.text) if w not in TIME_WORDS and len(w) > 2]
        columns = [w for p in COLUMN_PATTERNS for w in re.findall(p, r.text)]
        conditions = [" ".join(m) for p in CONDITION_PATTERNS for m in re.findall(p, r.text)]
        assert (r.operations, r.sources, r.columns, r.conditions) == (kinds, sources, columns, conditions), r.text
    assert sum(bool(r.operations) for r in got) > 1000


def test_long_lines_take_linear_time(spark):
    """A text four times as long takes nowhere near sixteen times as long."""
    def seconds(n):
        texts = ["extract rows " * n, "move a from b " * n, "copy\n" * n, "w" * 12 * n, "7" * 12 * n, "join" + " " * 12 * n + "x",
                 "load a b" + "\n" * 12 * n + "to", "x table" * n + " from"]
        df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
        started = time.monotonic()
        tag_requests(df, "text").write.format("noop").mode("overwrite").save()
        return time.monotonic() - started

    seconds(100)
    small, large = min(seconds(25_000) for _ in range(2)), min(seconds(100_000) for _ in range(2))
    assert large < 30 and large < 10 * small + 1
