"""Operation lists, steps and request logs (area L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.requests import (
    COLUMN_PATTERNS, CONDITION_PATTERNS, OPERATION_PATTERNS, SOURCE_PATTERNS, TIME_WORDS, count_by_complexity,
    count_by_kind, tag_requests,
)
from sluice.plans.spec import check_spec, run_spec
from sluice.plans.steps import chain, run_file_spec, run_graph, run_steps, run_task
from sluice.queries.registry import Tables, query
from sluice.session import scratch_path

PRICING_SUMMARY = [
    {"type": "filter", "config": {"condition": "l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'"}},
    {"type": "derive", "config": {"columns": {"disc_price": "l_extendedprice * (1 - l_discount)"}}},
    {"type": "group", "source_columns": ["l_returnflag", "l_linestatus"]},
    {"type": "aggregate", "config": {"measures": [
        ["l_quantity", "sum"], ["l_extendedprice", "sum"], ["disc_price", "sum"], ["l_discount", "avg"],
        ["*", "count"]]}},
    {"type": "sort", "source_columns": ["l_returnflag", "l_linestatus"]},
]


@query("l1_operation_list", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum,
       round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc_price_sum,
       round(avg(l_discount), 6) AS l_discount_avg, count(*) AS total_count
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def flagship(t: Tables) -> DataFrame:
    out = run_spec(t("lineitem"), PRICING_SUMMARY)
    digits = {"l_quantity_sum": 2, "l_extendedprice_sum": 2, "disc_price_sum": 2, "l_discount_avg": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


_STEPS = [
    {"name": "recent", "operations": [
        {"type": "filter", "config": {"condition": "o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'"}}]},
    {"name": "named", "operations": [
        {"type": "join", "config": {"right_table": "customer", "condition": "l.o_custkey = r.c_custkey"}}]},
    {"name": "totals", "operations": [
        {"type": "aggregate", "source_columns": ["o_totalprice"],
         "config": {"function": "max", "group_by": ["c_mktsegment"]}}]},
]
_STEPS_SQL = """WITH recent AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
  named AS (SELECT * FROM recent JOIN customer ON o_custkey = c_custkey),
  totals AS (SELECT c_mktsegment, max(o_totalprice) AS o_totalprice_max FROM named GROUP BY c_mktsegment)"""


@query("l2_chained_steps", f"{_STEPS_SQL} SELECT * FROM totals")
def _(t: Tables) -> DataFrame:
    return chain(t("orders"), _STEPS, {"customer": t("customer")})


@query("l2_rows_per_step", f"""{_STEPS_SQL}
SELECT 'recent' AS step, true AS success, (SELECT count(*) FROM recent) AS rows_processed
UNION ALL SELECT 'named', true, (SELECT count(*) FROM named)
UNION ALL SELECT 'totals', true, (SELECT count(*) FROM totals)""")
def _(t: Tables) -> DataFrame:
    path = f"{scratch_path(t.spark, 'steps')}.parquet"
    run = run_steps(t("orders"), _STEPS, path, {"customer": t("customer")}, per_step=True)
    return t.spark.createDataFrame([(r.step, r.success, r.rows_processed) for r in run.results],
                                   "step string, success boolean, rows_processed long")


@query("l3_step_graph", """
WITH urgent AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
  late AS (SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01')
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum
FROM late JOIN urgent ON l_orderkey = o_orderkey GROUP BY l_returnflag""")
def _(t: Tables) -> DataFrame:
    steps = [
        {"name": "result", "input": "joined", "operations": [
            {"type": "aggregate", "source_columns": ["l_extendedprice"],
             "config": {"function": "sum", "group_by": ["l_returnflag"]}}]},
        {"name": "joined", "input": "late", "operations": [
            {"type": "join", "config": {"right_table": "urgent", "condition": "l.l_orderkey = r.o_orderkey"}}]},
        {"name": "urgent", "input": "orders", "operations": [
            {"type": "filter", "config": {"condition": "o_orderpriority = '1-URGENT'"}}]},
        {"name": "late", "input": "lineitem", "operations": [
            {"type": "filter", "config": {"condition": "l_shipdate > timestamp_ntz '1997-01-01 00:00:00'"}}]},
    ]
    out = run_graph(steps, {"orders": t("orders"), "lineitem": t("lineitem")})["result"]
    return out.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2))


@query("l4_load_transform_check_save", """
WITH d AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT 2::BIGINT AS total_rules_executed, 2::BIGINT AS passed_rules, 0::BIGINT AS failed_rules, 1.0::DOUBLE AS overall_score,
  'Data quality looks good! Continue monitoring.' AS recommendations, (SELECT count(*) FROM d) AS rows_processed""")
def _(t: Tables) -> DataFrame:
    spec = {
        "name": "segments",
        "source": {"path": t.path("customer")},
        "target": {"path": f"{scratch_path(t.spark, 'segments')}.csv"},
        "transformations": [
            {"type": "select", "source_columns": ["c_nationkey", "c_mktsegment"]},
            {"type": "deduplication", "key_columns": ["c_nationkey", "c_mktsegment"]},
        ],
        "quality_rules": [
            {"rule_id": "filled", "rule_type": "completeness"},
            {"rule_id": "no_repeats", "rule_type": "uniqueness"},
        ],
    }
    run, checked = run_file_spec(t.spark, spec)
    return checked.withColumns({"recommendations": F.array_join("recommendations", "; "),
                                "rows_processed": F.lit(run.total_rows_processed).cast("long")})


# Requests made from the orders, in the wording the tags look for, and real texts as well.
_REQUESTS = """SELECT 'o' || o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN concat('  Move last ', o_orderkey % 90, ' days of Customer orders from MySQL to snowflake_dw, clean the phone numbers, and create a daily summary table ')
  WHEN 1 THEN concat('extract orders_', o_custkey, ' from mysql_db')
  WHEN 2 THEN 'Clean phone_numbers and normalize addresses'
  WHEN 3 THEN concat('run weekly report at 10:', 10 + o_orderkey % 50, ' for the ', lower(o_orderstatus), ' field')
  WHEN 4 THEN concat('JOIN orders with customers where key > ', o_orderkey, ' and save the result into view_', o_custkey)
  WHEN 5 THEN concat('get rows of the nation table from the last ', o_orderkey % 12, ' months or from today, ', o_orderkey % 5, ' weeks ago')
  ELSE concat(o_orderpriority, chr(10), 'every ', o_orderkey % 60, ' minutes copy prices from', chr(10), 'db1 to db2') END AS text
FROM orders
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'd' || doc_id, text FROM documents"""


def _requests(t: Tables) -> DataFrame:
    names = ("orders", "conversations", "documents")
    text = _REQUESTS
    for n in names:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}")
    return t.spark.sql(text, **{n: t(n) for n in names})


def _tags_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    operations = ", ".join(f"CASE WHEN regexp_matches(request, {q(p)}) THEN '{kind}' END"
                           for kind, patterns in OPERATION_PATTERNS.items() for p in patterns)
    words = ", ".join(f"'{w}'" for w in TIME_WORDS)
    found = lambda patterns, g: [f"regexp_extract_all(request, {q(p)}, {g})" for p in patterns]
    sources, columns = " || ".join(found(SOURCE_PATTERNS, 1)), " || ".join(found(COLUMN_PATTERNS, 1))
    conditions = " || ".join(
        f"list_transform(list_zip({a}, {b}), lambda z: z[1] || ' ' || z[2])"
        for a, b in zip(found(CONDITION_PATTERNS, 1), found(CONDITION_PATTERNS, 2)))
    return f"""requests AS ({_REQUESTS}),
  lowered AS (SELECT id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS request FROM requests),
  lists AS (SELECT id, request, list_filter([{operations}], lambda x: x IS NOT NULL) AS operations,
    list_filter({sources}, lambda w: w NOT IN ({words}) AND length(w) > 2) AS sources, {columns} AS columns,
    {conditions} AS conditions FROM lowered),
  tagged AS (SELECT *, len(operations) AS n, len(list_distinct(sources)) AS ns,
    len(list_filter(operations, lambda k: k = 'transform')) AS nt FROM lists),
  done AS (SELECT *, CASE WHEN n <= 1 AND ns <= 1 THEN 'simple' WHEN n <= 3 AND ns <= 2 AND nt <= 1 THEN 'medium'
    ELSE 'complex' END AS complexity FROM tagged)"""


@query("l6_tag_requests", f"""WITH {_tags_sql()}
SELECT id, array_to_string(operations, ',') AS operations, array_to_string(sources, ',') AS sources,
  array_to_string(columns, ',') AS columns, array_to_string(conditions, ',') AS conditions, complexity FROM done""")
def _(t: Tables) -> DataFrame:
    tagged = tag_requests(_requests(t), "text")
    lists = ("operations", "sources", "columns", "conditions")
    return tagged.select("id", *[F.array_join(c, ",").alias(c) for c in lists], "complexity")


@query("l7_complexity", f"WITH {_tags_sql()} SELECT complexity, count(*) AS requests FROM done GROUP BY complexity")
def _(t: Tables) -> DataFrame:
    return count_by_complexity(tag_requests(_requests(t), "text"))


@query("l7_kinds", f"""WITH {_tags_sql()}, kinds AS (SELECT complexity, unnest(list_distinct(operations)) AS kind FROM done)
SELECT complexity, kind, count(*) AS requests FROM kinds GROUP BY complexity, kind""")
def _(t: Tables) -> DataFrame:
    return count_by_kind(tag_requests(_requests(t), "text"))


_CHECKED = [
    {"type": "filter", "config": {"condition": "o_totalprice > 100000"}},
    {"type": "select", "source_columns": ["o_orderkey", "o_totalprice"]},
    {"type": "select", "source_columns": ["o_orderpriority"]},  # no longer there
]


@query("j13_check_spec", """
SELECT * FROM (SELECT 0 AS position, true AS ok, count(*) AS rows FROM orders WHERE o_totalprice > 100000
  UNION ALL SELECT 1, true, count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 2, false, NULL)""")
def _(t: Tables) -> DataFrame:
    """Which operations of a list resolve, and how many rows those leave."""
    report = check_spec(t("orders"), _CHECKED)
    found = t.spark.createDataFrame([(r["position"], r["ok"]) for r in report], "position int, ok boolean")
    counts = None
    for r in report:
        if r["ok"]:
            one = run_spec(t("orders"), _CHECKED[:r["position"] + 1]).agg(
                F.lit(r["position"]).alias("position"), F.count(F.lit(1)).alias("rows"))
            counts = one if counts is None else counts.union(one)
    return found.join(counts, "position", "left")


@query("l5_task_result", """
SELECT 'sql_query' AS step, true AS success, count(*) AS rows FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'data_load', true, count(*) FROM customer""")
def _(t: Tables) -> DataFrame:
    tasks = [{"type": "sql_query", "data": {"query": "SELECT o_custkey FROM {o} GROUP BY o_custkey", "tables": {"o": t("orders")}}},
             {"type": "data_load", "data": {"source": t.path("customer")}}]
    parts = []
    for task in tasks:
        df, result = run_task(t.spark, task)
        parts.append(df.agg(F.lit(result.step).alias("step"), F.lit(result.success).alias("success"), F.count(F.lit(1)).alias("rows")))
    return parts[0].union(parts[1])
