"""Quality rules, profiles, reports, duplicates (area F, and B10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.quality import report
from sluice.quality.dedup import drop_duplicates
from sluice.quality.profile import profile, quality_summary, suggest_rules
from sluice.quality.rules import Rule, RuleBook, assess, mark_rows, split_rows
from sluice.quality.states import day_states, merged, read_states, save_states
from sluice.queries.registry import Tables, query
from sluice.session import scratch_path

# Orders with gaps, blanks and orphans, which the test tables do not have.
_DIRTY = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS totalprice, o_orderdate FROM orders"""


def _dirty(t: Tables) -> DataFrame:
    return t.spark.sql(_DIRTY.replace("FROM orders", "FROM {orders}"), orders=t("orders"))


_SHOWN = ["rule_id", "rule_type", "column_name", "threshold", "total_records", "failed_records", "score", "passed",
          "success_rate"]


def _shown(results: DataFrame) -> DataFrame:
    return results.select(*[F.round(c, 9).alias(c) if c in ("score", "success_rate") else c for c in _SHOWN])


def _rule_sql(rule_id: str, kind: str, column: str | None, threshold: float, counts: str) -> str:
    """One result row from a query giving `total` and `failed`."""
    empty = "0.0" if kind == "completeness" else "1.0"
    name = f"'{column}'" if column else "NULL"
    share = "CAST(total - failed AS DOUBLE) / nullif(total, 0)"
    return f"""SELECT '{rule_id}' AS rule_id, '{kind}' AS rule_type, {name} AS column_name,
  CAST({threshold} AS DOUBLE) AS threshold, CAST(total AS BIGINT) AS total_records,
  CAST(failed AS BIGINT) AS failed_records, round(coalesce({share}, {empty}), 9) AS score,
  CASE WHEN total = 0 THEN {empty} = 1.0 ELSE {share} >= {threshold} END AS passed,
  round(coalesce({share}, 0.0), 9) AS success_rate FROM ({counts}) AS c"""


_PATTERN = r"\d-[A-Z]+"
RULES = {
    "priority_completeness": Rule("priority_completeness", "completeness", "priority"),
    "all_completeness": Rule("all_completeness", "completeness", None, {"threshold": 0.9}),
    "custkey_uniqueness": Rule("custkey_uniqueness", "uniqueness", "custkey", {"threshold": 0.05}),
    "orderkey_uniqueness": Rule("orderkey_uniqueness", "uniqueness", "o_orderkey"),
    "priority_validity": Rule("priority_validity", "validity", "priority", {"pattern": _PATTERN, "threshold": 0.9}),
    "price_range": Rule("price_range", "range", "totalprice", {"min_value": 5000, "max_value": 400000.5}),
    "price_floor": Rule("price_floor", "range", "totalprice", {"min_value": 1000}),
    "date_consistency": Rule("date_consistency", "consistency", None, {
        "related_columns": ["o_orderdate", "totalprice"],
        "consistency_rule": "o_orderdate >= timestamp_ntz '1995-01-01 00:00:00' OR totalprice < 300000"}),
    "custkey_reference": Rule("custkey_reference", "referential_integrity", "custkey", {
        "reference_table": "customer", "reference_column": "c_custkey"}),
    "price_custom": Rule("price_custom", "custom", None, {"predicate": "totalprice * 100 % 2 < 1", "threshold": 0.4}),
}
COUNTS = {
    "priority_completeness": "SELECT count(*) AS total, count(*) FILTER (priority IS NULL OR priority = '') AS failed FROM d",
    "all_completeness": """SELECT count(*) * 5 AS total, count(*) FILTER (custkey IS NULL)
        + count(*) FILTER (priority IS NULL OR priority = '') + count(*) FILTER (totalprice IS NULL) AS failed FROM d""",
    "custkey_uniqueness": "SELECT count(custkey) AS total, count(custkey) - count(DISTINCT custkey) AS failed FROM d",
    "orderkey_uniqueness":
        "SELECT count(o_orderkey) AS total, count(o_orderkey) - count(DISTINCT o_orderkey) AS failed FROM d",
    "priority_validity": """SELECT count(priority) AS total, count(*) FILTER (priority IS NOT NULL
        AND NOT regexp_matches(priority, '^(?:\\d-[A-Z]+)')) AS failed FROM d""",
    "price_range": """SELECT count(totalprice) AS total,
        count(*) FILTER (totalprice < 5000 OR totalprice > 400000.5) AS failed FROM d""",
    "price_floor": "SELECT count(totalprice) AS total, count(*) FILTER (totalprice < 1000) AS failed FROM d",
    "date_consistency": """SELECT count(*) AS total, count(*) FILTER (NOT coalesce(o_orderdate >= TIMESTAMP '1995-01-01'
        OR totalprice < 300000, false)) AS failed FROM d""",
    "custkey_reference": """SELECT count(custkey) AS total, count(*) FILTER (custkey IS NOT NULL
        AND custkey NOT IN (SELECT c_custkey FROM customer)) AS failed FROM d""",
    "price_custom": """SELECT count(*) AS total,
        count(*) FILTER (NOT coalesce(totalprice * 100 % 2 < 1, false)) AS failed FROM d""",
}


def _one_sql(rule_id: str) -> str:
    r = RULES[rule_id]
    return _rule_sql(rule_id, r.rule_type, r.column, r.threshold, COUNTS[rule_id])


def _rules_sql(*ids: str) -> str:
    return f"WITH d AS ({_DIRTY}) " + " UNION ALL ".join(_one_sql(i) for i in ids)


def _check(name: str, *ids: str) -> None:
    query(name, _rules_sql(*ids))(lambda t: _shown(assess(
        _dirty(t), [RULES[i] for i in ids], {"customer": t("customer")})))


_check("f1_completeness", "priority_completeness")
_check("f2_completeness_all_cells", "all_completeness")
_check("f3_uniqueness", "custkey_uniqueness", "orderkey_uniqueness")
_check("f5_validity", "priority_validity")
_check("f6_range", "price_range", "price_floor")
_check("f7_consistency", "date_consistency")
_check("f8_referential_integrity", "custkey_reference")
_check("f9_custom", "price_custom")
_check("f11_assess", *RULES)


@query("f4_record_uniqueness", _rule_sql(
    "record_uniqueness", "uniqueness", None, 0.99,
    "SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM i) - (SELECT count(*) FROM (SELECT DISTINCT * FROM i))"
    " AS failed").join(["WITH i AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS flag FROM lineitem) ", ""]))
def _(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'A')").alias("flag"))
    return _shown(assess(items, [Rule("record_uniqueness", "uniqueness")]))


@query("f4_document_uniqueness", _rule_sql(
    "text_uniqueness", "uniqueness", "text", 0.99,
    "SELECT count(text) AS total, count(text) - count(DISTINCT text) AS failed FROM documents"))
def _(t: Tables) -> DataFrame:
    return _shown(assess(t("documents"), [Rule("text_uniqueness", "uniqueness", "text")]))


@query("f10_default_rules", _rule_sql("default_completeness", "completeness", None, 0.95, """
  SELECT count(*) * 5 AS total, count(*) FILTER (custkey IS NULL) + count(*) FILTER (priority IS NULL OR priority = '')
    + count(*) FILTER (totalprice IS NULL) AS failed FROM d""").join([f"WITH d AS ({_DIRTY}) ", " UNION ALL "])
    + _rule_sql("default_uniqueness", "uniqueness", None, 0.99, """
  SELECT (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))
    AS failed"""))
def _(t: Tables) -> DataFrame:
    return _shown(assess(_dirty(t), RuleBook().get(["default_completeness", "default_uniqueness"])))


_RESULTS = f"WITH r AS ({_rules_sql(*RULES)}) "


def _results(t: Tables) -> DataFrame:
    return assess(_dirty(t), list(RULES.values()), {"customer": t("customer")})


@query("f12_validate", _RESULTS + "SELECT bool_and(passed) AS data_passed FROM r")
def _(t: Tables) -> DataFrame:
    return report.validate(_results(t))


@query("f13_overall_score", _RESULTS + "SELECT round(avg(score), 6) AS overall_score FROM r")
def _(t: Tables) -> DataFrame:
    return report.overall_score(_results(t)).select(F.round("overall_score", 6).alias("overall_score"))


_WORDS = """CASE WHEN contains(lower(rule_id), 'completeness') THEN 'Improve data completeness'
  WHEN contains(lower(rule_id), 'uniqueness') THEN 'Address duplicate values'
  WHEN contains(lower(rule_id), 'validity') THEN 'Fix data format issues' ELSE 'Address quality issues' END"""


@query("f14_report", _RESULTS + f"""
SELECT count(*) AS total_rules_executed, count(*) FILTER (passed) AS passed_rules,
       count(*) FILTER (NOT passed) AS failed_rules, round(avg(score), 6) AS overall_score,
       coalesce(string_agg(CASE WHEN NOT passed THEN printf('%s for %s (current: %.2f%%)', {_WORDS}, rule_id, score * 100) END,
         '; ' ORDER BY {_WORDS}, rule_id), 'Data quality looks good! Continue monitoring.') AS recommendations FROM r""")
def _(t: Tables) -> DataFrame:
    out = report.report(_results(t))
    return out.withColumns({"overall_score": F.round("overall_score", 6),
                            "recommendations": F.array_join("recommendations", "; ")})


def _median_text(name: str) -> str:
    """The exact median of integers of 0 and more, as text."""
    low, high = f"quantile_disc({name}, 0.5)::HUGEINT", f"-quantile_disc(-{name}, 0.5)::HUGEINT"
    return f"CAST(({low} + ({high})) // 2 AS VARCHAR) || CASE WHEN ({low} + ({high})) % 2 = 1 THEN '.5' ELSE '' END"


def _profile_sql(table: str, columns: dict[str, str], source: str | None = None) -> str:
    """`columns` maps names to Spark type names; numbers get statistics."""
    parts = []
    for name, kind in columns.items():
        number = kind in ("int", "bigint", "double")
        stats = (f"CAST(min({name}) AS DOUBLE), CAST(max({name}) AS DOUBLE), round(avg({name}), 7), "
                 f"round(stddev_samp({name}), 6), CAST(median({name}) AS DOUBLE)") if number else \
            ", ".join(["CAST(NULL AS DOUBLE)"] * 5)
        exact = (f"CAST(min({name}) AS VARCHAR), CAST(max({name}) AS VARCHAR), {_median_text(name)}"
                 if kind in ("int", "bigint") else ", ".join(["CAST(NULL AS VARCHAR)"] * 3))
        parts.append(f"SELECT '{name}', '{kind}', count(*), count(*) - count({name}), {stats}, "
                     f"count(DISTINCT {name}), {exact} FROM {source or table}")
    return ("SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS p(column_name, data_type, total_values, null_count, "
            "min_value, max_value, mean_value, std_dev, median_value, unique_count, min_exact, max_exact, median_exact)")


def _rounded(p: DataFrame) -> DataFrame:
    return p.withColumns({"mean_value": F.round("mean_value", 7), "std_dev": F.round("std_dev", 6)})


_DIRTY_COLUMNS = {"o_orderkey": "bigint", "custkey": "bigint", "priority": "string", "totalprice": "double",
                  "o_orderdate": "timestamp_ntz"}
_ITEM_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("f15_profile", f"WITH d AS ({_DIRTY}) " + _profile_sql("d", _DIRTY_COLUMNS))
def _(t: Tables) -> DataFrame:
    return _rounded(profile(_dirty(t)))


@query("f15_profile_lineitem", _profile_sql("lineitem", _ITEM_COLUMNS))
def _(t: Tables) -> DataFrame:
    return _rounded(profile(t("lineitem")))


@query("f15_profile_documents", _profile_sql("documents", {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def _(t: Tables) -> DataFrame:
    return _rounded(profile(t("documents")))


_BIG = ["l_orderkey + 9007199254740993 AS big", "CAST(l_partkey AS DECIMAL(30,2)) + 12345678901234567890.25 AS wide"]


@query("f15_profile_big_numbers", f"""
WITH d AS (SELECT {', '.join(_BIG)} FROM lineitem)
SELECT 'big' AS column_name, count(DISTINCT big) AS unique_count, CAST(min(big) AS VARCHAR) AS min_exact,
       CAST(max(big) AS VARCHAR) AS max_exact, {_median_text("big")} AS median_exact FROM d
UNION ALL
SELECT 'wide', count(DISTINCT wide), CAST(min(wide) AS VARCHAR), CAST(max(wide) AS VARCHAR),
       regexp_replace(CAST((quantile_disc(wide, 0.5) - quantile_disc(-wide, 0.5))::DECIMAL(38,3) * 0.5 AS VARCHAR), '\\.?0+$', '') FROM d""")
def _(t: Tables) -> DataFrame:
    big = t("lineitem").selectExpr(*_BIG)
    return profile(big).select("column_name", "unique_count", "min_exact", "max_exact", "median_exact")


_KEPT = {"custkey": "bigint", "priority": "string", "totalprice": "double"}


def _state_sql(name: str, kind: str) -> str:
    d = f"CAST({name} AS DOUBLE)" if kind != "string" else "NULL::DOUBLE"
    return f"""SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS total_values, count(*) - count({name}) AS null_count,
  min({d}) AS min_value, max({d}) AS max_value, round(avg({d}), 4) AS mean_value, round(stddev_samp({d}), 4) AS std_dev FROM d"""


# Months are profiled and kept in two runs, those of 1993 in both.
@query("f15_profile_from_states", f"WITH d AS ({_DIRTY}) " + " UNION ALL ".join(_state_sql(*c) for c in _KEPT.items()))
def _(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "states"), _dirty(t)
    for part in ("year(o_orderdate) <= 1993", "year(o_orderdate) >= 1993"):
        save_states(day_states(rows.where(part), "o_orderdate", list(_KEPT), "month"), path)
    return merged(read_states(t.spark, path)).select(
        "column_name", "data_type", "total_values", "null_count", "min_value", "max_value",
        F.round("mean_value", 4).alias("mean_value"), F.round("std_dev", 4).alias("std_dev"))


@query("f16_quality_summary", f"""
WITH d AS ({_DIRTY}), p AS ({_profile_sql("d", _DIRTY_COLUMNS)}),
     s AS (SELECT column_name, (total_values - null_count) / total_values AS share FROM p)
SELECT round(avg(share), 9) AS overall_completeness, count(*) FILTER (share < 0.95) AS columns_with_issues,
       count(*) AS total_columns, string_agg(CASE WHEN share < 0.95 THEN
         printf('Column ''%s'' has low completeness: %.2f%%', column_name, share * 100) END, '; ' ORDER BY column_name)
         AS quality_issues FROM s""")
def _(t: Tables) -> DataFrame:
    out = quality_summary(profile(_dirty(t), approximate=True))
    return out.withColumns({"overall_completeness": F.round("overall_completeness", 9),
                            "quality_issues": F.array_join("quality_issues", "; ")})


@query("f17_dimensions", _RESULTS + """
, m AS (SELECT CASE WHEN rule_type IN ('range', 'custom') THEN 'accuracy'
          WHEN rule_type = 'referential_integrity' THEN 'consistency' ELSE rule_type END AS dimension, score FROM r)
SELECT dimension, round(avg(score), 6) AS score, count(*) AS rules,
  CASE dimension WHEN 'completeness' THEN 0.95::DOUBLE WHEN 'accuracy' THEN 0.9::DOUBLE WHEN 'consistency' THEN 0.95::DOUBLE
    WHEN 'validity' THEN 0.9::DOUBLE ELSE 0.99::DOUBLE END AS threshold,
  avg(score) >= CASE dimension WHEN 'completeness' THEN 0.95 WHEN 'accuracy' THEN 0.9 WHEN 'consistency' THEN 0.95
    WHEN 'validity' THEN 0.9 ELSE 0.99 END AS met FROM m GROUP BY dimension""")
def _(t: Tables) -> DataFrame:
    return report.dimension_verdicts(_results(t)).withColumn("score", F.round("score", 6))


def _suggest_sql() -> str:
    numbers, texts = ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]
    none = "CAST(NULL AS VARCHAR) AS pattern, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, "
    none += "CAST(NULL AS VARCHAR) AS min_exact, CAST(NULL AS VARCHAR) AS max_exact"
    parts = []
    for c in numbers + texts:
        parts.append(f"SELECT '{c}_completeness' AS rule_id, 'completeness' AS rule_type, '{c}' AS column_name, {none} "
                     f"FROM customer HAVING count({c}) = count(*)")
        parts.append(f"SELECT '{c}_uniqueness', 'uniqueness', '{c}', {none} FROM customer "
                     f"HAVING count(DISTINCT {c}) = count(*)")
    for c in numbers:
        exact = "NULL, NULL" if c == "c_acctbal" else f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)"
        parts.append(f"SELECT '{c}_range', 'range', '{c}', NULL, CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), "
                     f"{exact} FROM customer")
    code = r"[A-Za-z]+#\d+$"
    for c in texts:
        parts.append(f"SELECT '{c}_validity', 'validity', '{c}', '{code}', NULL, NULL, NULL, NULL FROM customer "
                     f"HAVING count(*) FILTER (regexp_matches({c}, '^(?:{code})')) >= count({c}) * 0.95")
    return " UNION ALL ".join(parts)


@query("f18_suggested_rules", _suggest_sql())
def _(t: Tables) -> DataFrame:
    return suggest_rules(t("customer"))


@query("f19_deduplicate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                 "l_extendedprice", "l_shipdate")
    return drop_duplicates(items, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@query("f19_deduplicate_documents", """
SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def _(t: Tables) -> DataFrame:
    return drop_duplicates(t("documents").select("doc_id", "text"), ["text"], ["doc_id"])


_ROW_RULES = ["priority_completeness", "priority_validity", "price_range", "date_consistency"]


@query("f20_score_over_time", f"""
WITH d AS ({_DIRTY})
SELECT 'data_quality_score' AS metric_name, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
  round(((1 - count(*) FILTER (priority IS NULL OR priority = '') / count(*))
  + coalesce(1 - count(*) FILTER (NOT regexp_matches(priority, '^(?:\\d-[A-Z]+)')) / nullif(count(priority), 0), 1)
  + coalesce(1 - count(*) FILTER (totalprice < 5000 OR totalprice > 400000.5) / nullif(count(totalprice), 0), 1)
  + (1 - count(*) FILTER (NOT coalesce(o_orderdate >= TIMESTAMP '1995-01-01' OR totalprice < 300000, false)) / count(*))
  ) / 4, 9) AS value FROM d GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = report.score_over_time(_dirty(t), "o_orderdate", [RULES[i] for i in _ROW_RULES])
    return out.select("metric_name", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 9).alias("value"))


_MARKS = """list_filter([CASE WHEN priority IS NULL OR priority = '' THEN 'priority_completeness' END,
  CASE WHEN NOT regexp_matches(priority, '^(?:\\d-[A-Z]+)') THEN 'priority_validity' END,
  CASE WHEN totalprice < 5000 OR totalprice > 400000.5 THEN 'price_range' END,
  CASE WHEN NOT coalesce(o_orderdate >= TIMESTAMP '1995-01-01' OR totalprice < 300000, false) THEN 'date_consistency' END],
  lambda x: x IS NOT NULL)"""


@query("b10_mark_rows", f"""
WITH d AS ({_DIRTY}) SELECT o_orderkey, array_to_string({_MARKS}, ',') AS violations FROM d""")
def _(t: Tables) -> DataFrame:
    marked = mark_rows(_dirty(t), [RULES[i] for i in _ROW_RULES])
    return marked.select("o_orderkey", F.array_join("_violations", ",").alias("violations"))


@query("b10_quarantine", f"""
WITH d AS ({_DIRTY}), m AS (SELECT o_orderkey, {_MARKS} AS v FROM d)
SELECT o_orderkey, len(v) = 0 AS good FROM m""")
def _(t: Tables) -> DataFrame:
    good, bad = split_rows(_dirty(t), [RULES[i] for i in _ROW_RULES])
    return good.select("o_orderkey", F.lit(True).alias("good")).unionByName(
        bad.select("o_orderkey", F.lit(False).alias("good")))
