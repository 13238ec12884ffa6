"""Rows, joins, aggregates, columns, windows, ordering, union (areas B, C, D, E, G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import cleaning
from sluice.operators import aggregates, joins, rows, windows
from sluice.plans.spec import run_spec
from sluice.queries.registry import Tables, query
from sluice.sources import files

# ---------------------------------------------------------------- B: rows


@query("b1_select", "SELECT c_name, c_custkey, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return rows.select(t("customer"), ["c_name", "c_custkey", "c_mktsegment"])


@query("b2_filter", """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def _(t: Tables) -> DataFrame:
    ops = [{"type": "filter", "config": {"condition": "o_orderstatus = 'F'"}},
           {"type": "filter", "config": {"condition": "o_totalprice > 100000"}}]
    return run_spec(t("orders"), ops)


@query("b3_sql_text", """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t: Tables) -> DataFrame:
    return files.query(
        t.spark,
        "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance "
        "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
        tables={"customer": t("customer"), "nation": t("nation")})


@query("b4_sql_parameters", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.5 AND o_orderpriority = '1-URGENT'""")
def _(t: Tables) -> DataFrame:
    return files.query(
        t.spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= :low AND o_orderpriority = :p",
        args={"low": 250000.5, "p": "1-URGENT"}, tables={"orders": t("orders")})


@query("b5_derive", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       l_quantity > 25 AS bulk FROM lineitem""")
def _(t: Tables) -> DataFrame:
    out = rows.derive(t("lineitem"), {
        "charge": "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)", "bulk": "l_quantity > 25"})
    return out.select("l_orderkey", "l_linenumber", "charge", "bulk")


@query("b6_cast", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1 + CAST(o_orderkey % 2 AS INT)) AS INTEGER) AS level
FROM orders""")
def _(t: Tables) -> DataFrame:
    text = t("orders").select(
        "o_orderkey", F.expr("substr(o_orderpriority, 1, 1 + cast(o_orderkey % 2 as int))").alias("level"))
    return rows.cast(text, {"level": "int"})


@query("b6_cast_failures", """
SELECT 'level' AS column_name, 'int' AS target_type,
       count(*) FILTER (TRY_CAST(substr(o_orderpriority, 1, 1 + CAST(o_orderkey % 2 AS INT)) AS INTEGER) IS NULL)
         AS failed_records FROM orders""")
def _(t: Tables) -> DataFrame:
    text = t("orders").select(F.expr("substr(o_orderpriority, 1, 1 + cast(o_orderkey % 2 as int))").alias("level"))
    return rows.cast_failures(text, {"level": "int"})


@query("b7_case_when", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
       ELSE 'small' END AS size_class FROM orders""")
def _(t: Tables) -> DataFrame:
    out = rows.case_when(t("orders"), "size_class",
                         [("o_totalprice > 300000", "large"), ("o_totalprice > 100000", "medium")], "small")
    return out.select("o_orderkey", "size_class")


@query("b8_format", """
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate, format('{:,.2f}', o_totalprice) AS o_totalprice,
       '<' || o_orderstatus || '>' AS o_orderstatus FROM orders""")
def _(t: Tables) -> DataFrame:
    out = rows.format_columns(t("orders"), {"o_orderdate": "%d/%m/%Y", "o_totalprice": 2, "o_orderstatus": "<%s>"})
    return out.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")


@query("b9_clean", """
SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS p_name, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS p_brand
FROM part""")
def _(t: Tables) -> DataFrame:
    dirty = t("part").select("p_partkey", F.expr("'  ' || p_name || ' '").alias("p_name"),
                             F.expr("nullif(p_brand, 'Brand#1')").alias("p_brand"))
    return rows.clean(dirty, {
        "p_name": ["trim_whitespace", "case_standardization"],
        "p_brand": [("null_handling", {"default_value": "none"})]})


@query("b11_keep_last_days", """
SELECT event_id, event_type FROM events
WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""")
def _(t: Tables) -> DataFrame:
    return rows.keep_last(t("events"), "ts", 7, "days").select("event_id", "event_type")


@query("b11_keep_last_months", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 3 MONTH
  AND o_orderdate <= TIMESTAMP '1998-06-01'""")
def _(t: Tables) -> DataFrame:
    return rows.keep_last(t("orders"), "o_orderdate", 3, "months", "1998-06-01").select("o_orderkey")


# ---------------------------------------------------------------- C: joins


@query("c1_inner_join", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey""")
def _(t: Tables) -> DataFrame:
    out = joins.join(t("orders"), t("customer"), "l.o_custkey = r.c_custkey")
    out = joins.join(out, t("nation"), "l.c_nationkey = r.n_nationkey", small="right")
    return out.select("o_orderkey", "c_name", "n_name")


_ORPHANS = "CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000000 ELSE o_custkey END"


def _orders_with_orphans(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.expr(_ORPHANS).alias("custkey"))


@query("c2_left_join", f"""
WITH o AS (SELECT o_orderkey, {_ORPHANS} AS custkey FROM orders)
SELECT o_orderkey, custkey, c_name FROM o LEFT JOIN customer ON custkey = c_custkey""")
def _(t: Tables) -> DataFrame:
    return joins.join(_orders_with_orphans(t), t("customer").select("c_custkey", "c_name"),
                      "l.custkey = r.c_custkey", "left").select("o_orderkey", "custkey", "c_name")


@query("c2_right_join", """
WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey, o_orderkey FROM o RIGHT JOIN customer ON o_custkey = c_custkey""")
def _(t: Tables) -> DataFrame:
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return joins.join(urgent, t("customer"), "l.o_custkey = r.c_custkey", "right").select("c_custkey", "o_orderkey")


@query("c2_full_join", f"""
WITH o AS (SELECT o_orderkey, {_ORPHANS} AS custkey FROM orders),
     c AS (SELECT c_custkey + 40 AS custkey, c_name FROM customer)
SELECT coalesce(o.custkey, c.custkey) AS custkey, o_orderkey, c_name FROM o FULL JOIN c ON o.custkey = c.custkey""")
def _(t: Tables) -> DataFrame:
    moved = t("customer").select((F.col("c_custkey") + 40).alias("custkey"), "c_name")
    return joins.join(_orders_with_orphans(t), moved, ["custkey"], "full").select("custkey", "o_orderkey", "c_name")


@query("c3_semi_join", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(t: Tables) -> DataFrame:
    big = t("orders").filter("o_totalprice > 400000")
    return joins.join(t("customer"), big, "l.c_custkey = r.o_custkey", "left_semi").select("c_custkey", "c_name")


@query("c3_anti_join", f"""
WITH o AS (SELECT o_orderkey, {_ORPHANS} AS custkey FROM orders)
SELECT o_orderkey, custkey FROM o WHERE custkey NOT IN (SELECT c_custkey FROM customer)""")
def _(t: Tables) -> DataFrame:
    return joins.join(_orders_with_orphans(t), t("customer"), "l.custkey = r.c_custkey", "left_anti")


@query("c4_condition_join", """
SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier
  ON l_suppkey = s_suppkey AND l_extendedprice > s_acctbal * 10""")
def _(t: Tables) -> DataFrame:
    out = joins.join(t("lineitem"), t("supplier"), "l.l_suppkey = r.s_suppkey AND l.l_extendedprice > r.s_acctbal * 10")
    return out.select("l_orderkey", "l_linenumber", "s_name")


@query("c4_theta_join", """
SELECT s_suppkey, r_name FROM supplier JOIN region ON s_nationkey > r_regionkey * 5""")
def _(t: Tables) -> DataFrame:
    return joins.range_join(t("supplier"), t("region"), "l.s_nationkey", low="r.r_regionkey * 5", low_open=True).select(
        "s_suppkey", "r_name")


@query("c4_band_join", """
SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem
  ON o_totalprice BETWEEN l_extendedprice * 4 - 0.5 AND l_extendedprice * 4 + 0.5""")
def _(t: Tables) -> DataFrame:
    return joins.range_join(t("orders"), t("lineitem"), "l.o_totalprice", low="r.l_extendedprice * 4 - 0.5D",
                            high="r.l_extendedprice * 4 + 0.5D").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("c4_range_anti_join", """
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders
  WHERE e.ts >= o_orderdate AND e.ts < o_orderdate + INTERVAL 1 HOUR AND o_totalprice > e.value * 1000)""")
def _(t: Tables) -> DataFrame:
    return joins.range_join(t("events"), t("orders"), "l.ts", low="r.o_orderdate", high="r.o_orderdate + INTERVAL 1 HOUR",
                            high_open=True, how="left_anti", condition="r.o_totalprice > l.value * 1000").select("event_id")


@query("c4_cross_join", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def _(t: Tables) -> DataFrame:
    return joins.join(t("supplier"), t("region"), how="cross", small="right").select("s_suppkey", "r_name")


@query("c5_sql_join", """
SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(t: Tables) -> DataFrame:
    names = ["orders", "customer", "nation", "region"]
    return files.query(t.spark, """
        SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {orders}
        JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name""", tables={n: t(n) for n in names})


@query("c6_small_side_join", """
SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25""")
def _(t: Tables) -> DataFrame:
    out = joins.join(t("lineitem"), t("part").filter("p_size > 25"), "l.l_partkey = r.p_partkey", small="right")
    return out.select("l_orderkey", "l_linenumber", "p_brand")


# ---------------------------------------------------------------- D: aggregates


def _grouped(t: Tables, function: str) -> DataFrame:
    out = aggregates.aggregate(t("lineitem"), ["l_quantity", "l_extendedprice"], function,
                               ["l_returnflag", "l_linestatus"])
    return out.select(*[F.round(c, 4).alias(c) if c.startswith(("l_quantity_", "l_extendedprice_")) else c
                        for c in out.columns])


def _grouped_sql(function: str) -> str:
    return f"""SELECT l_returnflag, l_linestatus, round({function}(l_quantity), 4) AS l_quantity_{function},
round({function}(l_extendedprice), 4) AS l_extendedprice_{function} FROM lineitem GROUP BY l_returnflag, l_linestatus"""


for _number, _function in (("d1", "sum"), ("d2", "avg"), ("d4", "max"), ("d5", "min")):
    query(f"{_number}_{_function}", _grouped_sql(_function))(lambda t, f=_function: _grouped(t, f))

_MASKED = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END"


@query("d3_count", f"""
SELECT priority, count(priority) AS priority_count, count(o_custkey) AS o_custkey_count
FROM (SELECT {_MASKED} AS priority, o_custkey FROM orders) GROUP BY priority""")
def _(t: Tables) -> DataFrame:
    masked = t("orders").select(F.expr(_MASKED).alias("priority"), "o_custkey")
    return aggregates.aggregate(masked, ["priority", "o_custkey"], "count", ["priority"])


@query("d6_row_count", f"""
SELECT priority, count(*) AS total_count FROM (SELECT {_MASKED} AS priority FROM orders) GROUP BY priority""")
def _(t: Tables) -> DataFrame:
    return aggregates.aggregate(t("orders").select(F.expr(_MASKED).alias("priority")), group_by=["priority"])


@query("d7_global", """
SELECT count(*) AS total_count, round(sum(o_totalprice), 2) AS o_totalprice_sum, max(o_totalprice) AS o_totalprice_max
FROM orders""")
def _(t: Tables) -> DataFrame:
    out = aggregates.multi_aggregate(t("orders"), [("*", "count"), ("o_totalprice", "sum"), ("o_totalprice", "max")])
    return out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query("d7_global_count", "SELECT count(*) AS total_count FROM lineitem")
def _(t: Tables) -> DataFrame:
    return aggregates.aggregate(t("lineitem"))


@query("d8_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS l_orderkey_count_distinct,
       count(DISTINCT l_partkey) AS l_partkey_count_distinct FROM lineitem GROUP BY l_returnflag""")
def _(t: Tables) -> DataFrame:
    return aggregates.aggregate(t("lineitem"), ["l_orderkey", "l_partkey"], "count_distinct", ["l_returnflag"])


@query("d9_statistics", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice_mean,
       round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, round(var_samp(o_totalprice), 1) AS o_totalprice_var,
       median(o_totalprice) AS o_totalprice_median, count(DISTINCT o_custkey) AS o_custkey_nunique
FROM orders GROUP BY o_orderpriority""")
def _(t: Tables) -> DataFrame:
    out = aggregates.multi_aggregate(t("orders"), [
        ("o_totalprice", "mean"), ("o_totalprice", "std"), ("o_totalprice", "var"), ("o_totalprice", "median"),
        ("o_custkey", "nunique")], ["o_orderpriority"])
    return out.withColumns({"o_totalprice_mean": F.round("o_totalprice_mean", 4),
                            "o_totalprice_std": F.round("o_totalprice_std", 4),
                            "o_totalprice_var": F.round("o_totalprice_var", 1)})


@query("d9_median_many_groups", "SELECT l_suppkey, median(l_quantity) AS l_quantity_median FROM lineitem GROUP BY l_suppkey")
def _(t: Tables) -> DataFrame:
    return aggregates.aggregate(t("lineitem"), ["l_quantity"], "median", ["l_suppkey"])


@query("d9_first_last", """
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_first,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice_last FROM orders GROUP BY o_custkey""")
def _(t: Tables) -> DataFrame:
    return aggregates.multi_aggregate(t("orders"), [("o_totalprice", "first"), ("o_totalprice", "last")],
                                      ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("d10_group", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t: Tables) -> DataFrame:
    return run_spec(t("lineitem"), [{"type": "group", "source_columns": ["l_returnflag", "l_linestatus"]}])


@query("d11_many_measures", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum,
       round(avg(l_discount), 6) AS l_discount_avg, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max,
       count(*) AS total_count FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t: Tables) -> DataFrame:
    out = aggregates.multi_aggregate(
        t("lineitem"), [("l_quantity", "sum"), ("l_discount", "avg"), ("l_tax", "min"), ("l_tax", "max"),
                        ("*", "count")], ["l_returnflag", "l_linestatus"])
    return out.withColumns({"l_quantity_sum": F.round("l_quantity_sum", 2),
                            "l_discount_avg": F.round("l_discount_avg", 6)})


@query("d12_pivot", """
SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS "O_l_quantity_sum",
       sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS "F_l_quantity_sum"
FROM lineitem GROUP BY l_returnflag""")
def _(t: Tables) -> DataFrame:
    return aggregates.pivot(t("lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F"], {"l_quantity": "sum"})


@query("d13_unpivot", """
SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return aggregates.unpivot(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("d14_daily_summary", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS total_count, round(sum(value), 4) AS value_sum,
       round(avg(value), 6) AS value_avg FROM events GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = aggregates.daily_summary(t("events"), "ts", [("*", "count"), ("value", "sum"), ("value", "avg")],
                                   ["event_type"])
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "total_count",
                      F.round("value_sum", 4).alias("value_sum"), F.round("value_avg", 6).alias("value_avg"))


# ---------------------------------------------------------------- E: columns


@query("e1_null_handling", f"SELECT o_orderkey, coalesce({_MASKED}, 'unknown') AS priority FROM orders")
def _(t: Tables) -> DataFrame:
    masked = t("orders").select("o_orderkey", F.expr(_MASKED).alias("priority"))
    return masked.select("o_orderkey", cleaning.template(
        "null_handling", column="priority", default_value="unknown").alias("priority"))


@query("e2_e3_trim_upper", """
SELECT p_partkey, trim('  ' || p_name || '   ') AS trimmed, upper(p_name) AS shouted FROM part""")
def _(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  "), "p_name", F.lit("   "))
    return t("part").select("p_partkey", cleaning.template("trim_whitespace", column=padded).alias("trimmed"),
                            cleaning.template("case_standardization", column="p_name").alias("shouted"))


@query("e4_date_format", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%d.%m.%y %H:%M') AS stamp
FROM orders""")
def _(t: Tables) -> DataFrame:
    return t("orders").select(
        "o_orderkey", cleaning.template("date_formatting", column="o_orderdate", format="%Y-%m").alias("month"),
        cleaning.template("date_formatting", column="o_orderdate", format="dd.MM.yy HH:mm").alias("stamp"))


@query("e5_truncate", """
SELECT doc_id, substr(text, 1, 40) AS head, length(text) > 40 AS cut FROM documents""")
def _(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", cleaning.truncate("text", 40).alias("head"),
                                 cleaning.is_truncated("text", 40).alias("cut"))


# Phone spellings made from each customer's key: bare, with country code, with extension letters, too short.
_PHONE = """CASE c_custkey % 4
  WHEN 0 THEN '(555) ' || lpad(CAST(c_custkey % 1000 AS VARCHAR(10)), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR(10)), 4, '0')
  WHEN 1 THEN '+44 20 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR(10)), 4, '0') || ' 1234'
  WHEN 2 THEN 'tel. 0049-30-' || lpad(CAST(c_custkey % 1000000 AS VARCHAR(10)), 6, '0')
  ELSE 'ext ' || CAST(c_custkey % 100 AS VARCHAR(10)) END"""


@query("e6_phone", f"""
WITH p AS (SELECT c_custkey, regexp_replace({_PHONE}, '[^0-9+]', '', 'g') AS kept FROM customer),
     q AS (SELECT c_custkey, kept, replace(kept, '+', '') AS digits FROM p)
SELECT c_custkey, CASE WHEN length(digits) NOT BETWEEN 8 AND 15 THEN NULL
  WHEN kept LIKE '+%' THEN '+' || digits WHEN length(digits) = 10 THEN '+1' || digits ELSE '+' || digits END AS phone
FROM q""")
def _(t: Tables) -> DataFrame:
    raw = t("customer").select("c_custkey", F.expr(_PHONE).alias("phone"))
    return run_spec(raw, [{"type": "phone_cleanup", "source_columns": ["phone"]}])


_MAIL = """CASE c_custkey % 3 WHEN 0 THEN ' ' || replace(c_name, '#', '.') || '@Example.COM '
  WHEN 1 THEN c_name || '@example' ELSE replace(c_name, '#', '+') || '@mail.example.org' END"""


@query("e7_email", f"""
SELECT c_custkey, lower(trim({_MAIL})) AS email,
       regexp_matches(lower(trim({_MAIL})), '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{{2,}}$') AS valid
FROM customer""")
def _(t: Tables) -> DataFrame:
    raw = t("customer").select("c_custkey", F.expr(_MAIL).alias("email"))
    return raw.select("c_custkey", cleaning.clean_email("email").alias("email"), cleaning.is_email("email").alias("valid"))


@query("e8_normalize", """
SELECT p_partkey, list_aggregate(list_transform(string_split(trim(regexp_replace(lower(p_name) || '   ' || lower(p_type),
  '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label FROM part""")
def _(t: Tables) -> DataFrame:
    messy = F.concat(F.lit(" "), F.lower("p_name"), F.lit("   "), "p_type", F.lit(" "))
    return t("part").select("p_partkey", cleaning.normalize_text(messy).alias("label"))


# ---------------------------------------------------------------- G: windows
# Order items are a few rows per order, so a plain window serves. Return flags hold a third
# of the table each, so those windows are split into blocks of order keys.

_ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
               "l_discount", "l_tax"]
_ITEM_SQL = ", ".join(_ITEM_ORDER)


def _items(t: Tables) -> DataFrame:
    return t("lineitem").select("l_returnflag", "l_linestatus", *_ITEM_ORDER)


@query("g1_row_number", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_SQL}) AS rn FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return windows.window(_items(t), "row_number", "rn", partition=["l_orderkey"], order=_ITEM_ORDER).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "rn")


@query("g1_row_number_big_groups", f"""
SELECT l_returnflag, {_ITEM_SQL},
       CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY {_ITEM_SQL}) AS INT) AS rn FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return windows.window(_items(t), "row_number", "rn", partition=["l_returnflag"], order=_ITEM_ORDER,
                          bucket="auto").select("l_returnflag", *_ITEM_ORDER, "rn")


@query("g2_rank", """
SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk FROM orders""")
def _(t: Tables) -> DataFrame:
    return windows.window(t("orders"), "rank", "rk", partition=["o_custkey"], order=["o_orderdate"]).select(
        "o_orderkey", "o_custkey", "rk")


@query("g2_rank_big_groups", """
SELECT o_orderkey, o_orderpriority,
       CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS INT) AS rk FROM orders""")
def _(t: Tables) -> DataFrame:
    return windows.window(t("orders"), "rank", "rk", partition=["o_orderpriority"], order=["o_orderdate"],
                          descending=True, bucket="auto").select(
        "o_orderkey", "o_orderpriority", "rk")


# Two line statuses hold half of the rows each, so nearly all rows tie.
@query("g2_rank_hot_tie", """
SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_linestatus) AS INT) AS rk,
       CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus DESC) AS INT) AS rk_flag FROM lineitem""")
def _(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    ranked = windows.window(items, "rank", "rk", order=["l_linestatus"])
    return windows.window(ranked, "rank", "rk_flag", partition=["l_returnflag"], order=["l_linestatus"], descending=True,
                          bucket="auto").select("l_orderkey", "l_linenumber", "rk", "rk_flag")


_NUMBERS_PER_TASK = 500_000


# Which of the tied rows has which number is not defined; the numbers that a status has are.
@query("g1_row_number_hot_tie", """
SELECT l_returnflag, l_linestatus, min(rn) AS first, max(rn) AS last, count(DISTINCT rn) AS numbers
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS rn FROM lineitem) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    numbered = windows.window(items, "row_number", "rn", partition=["l_returnflag"], order=["l_linestatus"], bucket="auto")
    # Numbers are dealt out before they are counted: a task would hold all numbers of its files.
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), items.count() // _NUMBERS_PER_TASK)
    numbered = numbered.repartition(tasks, "l_returnflag", "l_linestatus", "rn")
    return numbered.groupBy("l_returnflag", "l_linestatus").agg(
        F.min("rn").cast("long").alias("first"), F.max("rn").cast("long").alias("last"), F.countDistinct("rn").alias("numbers"))


@query("g5_running_hot_tie", """
SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS BIGINT) AS running
FROM lineitem""")
def _(t: Tables) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return windows.window(items, "sum", "running", "l_linenumber", ["l_returnflag"], ["l_linestatus"], bucket="auto").select(
        "l_orderkey", "l_linenumber", "running")


def _shift(t: Tables, fn: str) -> DataFrame:
    return windows.window(t("events"), fn, "other", "value", ["user_id"], ["ts", "event_id"], 2).select(
        "event_id", "user_id", "other")


def _shift_sql(fn: str) -> str:
    return f"""SELECT event_id, user_id, {fn}(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS other
FROM events"""


query("g3_lag", _shift_sql("lag"))(lambda t: _shift(t, "lag"))
query("g4_lead", _shift_sql("lead"))(lambda t: _shift(t, "lead"))


def _big_shift(t: Tables, fn: str) -> DataFrame:
    return windows.window(t("events"), fn, "other", "value", ["event_type"], ["ts", "event_id"], 3,
                          bucket="auto").select("event_id", "event_type", "other")


def _big_shift_sql(fn: str) -> str:
    return f"""SELECT event_id, event_type, {fn}(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS other
FROM events"""


query("g3_lag_big_groups", _big_shift_sql("lag"))(lambda t: _big_shift(t, "lag"))
query("g4_lead_big_groups", _big_shift_sql("lead"))(lambda t: _big_shift(t, "lead"))


@query("g5_partition_total", """
SELECT o_orderkey, o_orderpriority, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS share
FROM orders""")
def _(t: Tables) -> DataFrame:
    out = windows.window(t("orders"), "sum", "total", "o_totalprice", ["o_orderpriority"], few_groups=True)
    return out.select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / F.col("total"), 9).alias("share"))


@query("g5_moving_average", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events""")
def _(t: Tables) -> DataFrame:
    out = windows.window(t("events"), "avg", "smooth", "value", ["user_id"], ["ts", "event_id"], frame=("rows", -2, 0))
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("g5_running_sum_big_groups", """
SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS running,
       max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS highest FROM events""")
def _(t: Tables) -> DataFrame:
    out = windows.window(t("events"), "sum", "running", "value", ["event_type"], ["ts", "event_id"], bucket="auto")
    out = windows.window(out, "max", "highest", "value", ["event_type"], ["ts", "event_id"], bucket=F.date_trunc("day", "ts"))
    return out.select("event_id", "event_type", F.round("running", 4).alias("running"), "highest")


# ---------------------------------------------------------------- H: order, limit


@query("h1_sort", f"SELECT o_orderkey, {_MASKED} AS priority, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    masked = t("orders").select("o_orderkey", F.expr(_MASKED).alias("priority"), "o_totalprice")
    return rows.sort(masked, ["priority", "o_totalprice", "o_orderkey"], [True, False, True])


@query("h2_limit", "SELECT least(100, count(*)) AS n, 0::BIGINT AS strange FROM lineitem")
def _(t: Tables) -> DataFrame:
    # Which rows come out is not defined: how many, and how many that are not rows of the table.
    found = rows.limit(t("lineitem"), 100)
    strange = found.join(t("lineitem"), found.columns, "left_anti").agg(F.count("*").alias("strange"))
    return found.agg(F.count("*").alias("n")).crossJoin(strange)


@query("h3_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20""")
def _(t: Tables) -> DataFrame:
    return rows.top_k(t("orders").select("o_orderkey", "o_totalprice"), 20, ["o_totalprice", "o_orderkey"])


@query("h3_top_k_per_group", """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5""")
def _(t: Tables) -> DataFrame:
    ranked = windows.window(t("orders"), "row_number", "rn", partition=["o_orderpriority"],
                            order=["o_totalprice", "o_orderkey"], descending=True)
    return ranked.filter("rn <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- I: union


@query("i1_union_all", """
SELECT c_nationkey AS nationkey, c_acctbal AS balance, NULL AS segment FROM customer WHERE c_acctbal < 0
UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def _(t: Tables) -> DataFrame:
    a = t("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"),
                                                     F.col("c_acctbal").alias("balance"))
    b = t("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nationkey"),
                             F.lit("supplier").alias("segment"))
    return rows.union([a, b], allow_missing=True)


@query("i1_union_distinct", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")
def _(t: Tables) -> DataFrame:
    return rows.union([t("customer").select(F.col("c_nationkey").alias("nationkey")),
                       t("supplier").select(F.col("s_nationkey").alias("nationkey"))], distinct=True)
