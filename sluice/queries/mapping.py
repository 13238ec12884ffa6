"""Schema mapping (area J).

The catalog is made from `part`: every part is a column, twenty parts in a row are a
table, and each even table is mapped to the odd one after it. So tables and pairs grow
with the data while a table's width stays the same.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.mapping import match
from sluice.mapping.apply import TargetColumn, apply_mapping, truncated_rows
from sluice.mapping.types import CANONICAL_TYPES, TYPE_FAMILIES, canonical_type, type_family, type_parameters
from sluice.queries.registry import Tables, query

_CATALOG = """SELECT
  CASE WHEN p_partkey % 40 < 20 THEN 'shop' ELSE 'warehouse' END AS source_id,
  concat('t', CAST(p_partkey - p_partkey % 20 AS VARCHAR(20))) AS table_name,
  CAST(p_partkey % 20 AS INT) AS ordinal_position,
  concat(CASE WHEN p_partkey % 40 < 20 THEN replace(p_name, ' ', '_') ELSE upper(replace(p_name, ' ', '_')) END,
         CASE WHEN p_size < 12 THEN '' ELSE lower(p_type) END, '_', CAST(p_partkey % 20 AS VARCHAR(20))) AS column_name,
  CASE p_size % 13 WHEN 0 THEN 'INT(11)' WHEN 1 THEN 'BIGINT' WHEN 2 THEN 'DECIMAL(10, 2)'
    WHEN 3 THEN concat('VARCHAR(', CAST(p_size * 4 AS VARCHAR(20)), ')') WHEN 4 THEN 'char(8)' WHEN 5 THEN ' Text '
    WHEN 6 THEN 'date' WHEN 7 THEN 'TIMESTAMP' WHEN 8 THEN 'bool' WHEN 9 THEN 'variant' WHEN 10 THEN 'double'
    WHEN 11 THEN 'character varying' ELSE concat('varchar(', CAST(p_size AS VARCHAR(20)), ')') END AS raw_type,
  p_partkey % 3 <> 0 AS nullable, p_partkey % 20 = 0 AS is_primary_key,
  CASE WHEN p_size % 10 = 0 THEN concat('ref.', p_brand) END AS foreign_key
FROM part"""
_PAIRS = """SELECT DISTINCT 'shop' AS source_id, concat('t', CAST(p_partkey - p_partkey % 40 AS VARCHAR(20))) AS source_table,
  'warehouse' AS target_id, concat('t', CAST(p_partkey - p_partkey % 40 + 20 AS VARCHAR(20))) AS target_table FROM part"""


def _catalog(t: Tables) -> DataFrame:
    return t.spark.sql(_CATALOG.replace("FROM part", "FROM {part}"), part=t("part"))


def _pairs(t: Tables) -> DataFrame:
    return t.spark.sql(_PAIRS.replace("FROM part", "FROM {part}"), part=t("part"))


def _case(table: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_INSIDE = "split_part(split_part(raw_type, '(', 2), ')', 1)"
_PARSED = f"""SELECT *, {_case(CANONICAL_TYPES, "split_part(trim(lower(raw_type)), '(', 1)", "'unknown'")} AS data_type,
  CASE WHEN contains(raw_type, '(') AND NOT contains({_INSIDE}, ',') THEN TRY_CAST({_INSIDE} AS INT) END AS max_length,
  CASE WHEN contains({_INSIDE}, ',') THEN TRY_CAST(trim(split_part({_INSIDE}, ',', 1)) AS INT) END AS "precision",
  CASE WHEN contains({_INSIDE}, ',') THEN TRY_CAST(trim(split_part({_INSIDE}, ',', 2)) AS INT) END AS scale
FROM catalog"""


@query("j1_canonical_types", f"""
WITH catalog AS ({_CATALOG}), p AS ({_PARSED})
SELECT table_name, column_name, raw_type, data_type FROM p""")
def _(t: Tables) -> DataFrame:
    return _catalog(t).select("table_name", "column_name", "raw_type", canonical_type("raw_type").alias("data_type"))


@query("j2_type_parameters", f"""
WITH catalog AS ({_CATALOG}), p AS ({_PARSED})
SELECT table_name, column_name, raw_type, max_length, "precision", scale FROM p""")
def _(t: Tables) -> DataFrame:
    return _catalog(t).select("table_name", "column_name", "raw_type", type_parameters("raw_type").alias("p")).select(
        "table_name", "column_name", "raw_type", "p.*")


@query("j3_table_schemas", f"""
WITH catalog AS ({_CATALOG}), p AS ({_PARSED})
SELECT source_id, table_name, count(*) AS column_count,
  string_agg(concat(column_name, ':', data_type), ',' ORDER BY ordinal_position) AS columns,
  coalesce(string_agg(CASE WHEN is_primary_key THEN column_name END, ',' ORDER BY ordinal_position), '') AS primary_keys,
  coalesce(string_agg(CASE WHEN foreign_key IS NOT NULL THEN column_name END, ',' ORDER BY ordinal_position), '') AS foreign_keys
FROM p GROUP BY source_id, table_name""")
def _(t: Tables) -> DataFrame:
    out = match.table_schemas(match.parse_catalog(_catalog(t)))
    return out.select(
        "source_id", "table_name", F.size("columns").cast("long").alias("column_count"),
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c.column_name, c.data_type)), ",").alias("columns"),
        F.array_join("primary_keys", ",").alias("primary_keys"), F.array_join("foreign_keys", ",").alias("foreign_keys"))


def _similarity_sql(a: str, b: str) -> str:
    la, lb = f"string_split(lower({a}), '')", f"string_split(lower({b}), '')"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE
      WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN 0.8::DOUBLE
      ELSE len(list_intersect({la}, {lb}))::DOUBLE / len(list_distinct(list_concat({la}, {lb}))) END"""


def _score_sql(s: str = "s", t: str = "t") -> str:
    fam = lambda x: _case(TYPE_FAMILIES, f"{x}.data_type", "NULL")
    return f"""least(1.0::DOUBLE, {_similarity_sql(f'{s}.column_name', f'{t}.column_name')} * 0.4::DOUBLE
      + CASE WHEN {s}.data_type = {t}.data_type THEN 0.3::DOUBLE WHEN {fam(s)} = {fam(t)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN {s}.nullable = {t}.nullable THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN {s}.is_primary_key = {t}.is_primary_key THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN {fam(s)} = 'text' AND {fam(t)} = 'text' AND {s}.max_length > 0 AND {t}.max_length >= {s}.max_length
          THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"""


_SIDES = f"""WITH RECURSIVE catalog AS ({_CATALOG}), p AS ({_PARSED}), pairs AS ({_PAIRS}),
  ss AS (SELECT pairs.*, p.* EXCLUDE (source_id, table_name) FROM pairs JOIN p
         ON p.source_id = pairs.source_id AND p.table_name = source_table),
  tt AS (SELECT pairs.*, p.* EXCLUDE (source_id, table_name) FROM pairs JOIN p
         ON p.source_id = pairs.target_id AND p.table_name = target_table)"""


def _candidates(t: Tables) -> DataFrame:
    """Every column of a source table with every column of its target table."""
    parsed = match.parse_catalog(_catalog(t))
    return match._side(parsed, _pairs(t), "source", "s").join(match._side(parsed, _pairs(t), "target", "t"), [*match.PAIR])


@query("j4_name_similarity", f"""{_SIDES}
SELECT s.column_name AS source_column, t.column_name AS target_column,
  round({_similarity_sql('s.column_name', 't.column_name')}, 9) AS similarity
FROM ss s JOIN tt t USING (source_table)""")
def _(t: Tables) -> DataFrame:
    return _candidates(t).select(
        F.col("s.column_name").alias("source_column"), F.col("t.column_name").alias("target_column"),
        F.round(match.name_similarity("s.column_name", "t.column_name"), 9).alias("similarity"))


@query("j5_column_similarity", f"""{_SIDES}
SELECT s.column_name AS source_column, t.column_name AS target_column, round({_score_sql()}, 9) AS score
FROM ss s JOIN tt t USING (source_table)""")
def _(t: Tables) -> DataFrame:
    return _candidates(t).select(
        F.col("s.column_name").alias("source_column"), F.col("t.column_name").alias("target_column"),
        F.round(match.column_similarity(), 9).alias("score"))


@query("j6_type_families", f"""
WITH catalog AS ({_CATALOG}), p AS ({_PARSED})
SELECT data_type, {_case(TYPE_FAMILIES, 'data_type', 'NULL')} AS family, count(*) AS columns FROM p GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return match.parse_catalog(_catalog(t)).groupBy("data_type", type_family("data_type").alias("family")).agg(
        F.count(F.lit(1)).alias("columns"))


# The greedy assignment as a recursion over source positions, carrying the taken targets.
_MATCHED = f"""{_SIDES},
  exact AS (SELECT s.source_table, s.ordinal_position AS sp, t.ordinal_position AS tp
            FROM ss s JOIN tt t ON s.source_table = t.source_table AND lower(s.column_name) = lower(t.column_name)),
  cand AS (SELECT s.source_table, s.ordinal_position AS sp, t.ordinal_position AS tp, {_score_sql()} AS score
           FROM ss s JOIN tt t ON s.source_table = t.source_table
           WHERE (s.source_table, s.ordinal_position) NOT IN (SELECT (source_table, sp) FROM exact)
             AND (t.source_table, t.ordinal_position) NOT IN (SELECT (source_table, tp) FROM exact)
             AND {_score_sql()} > 0.6::DOUBLE),
  g AS (SELECT source_table, -1 AS sp, CAST([] AS INT[]) AS taken, CAST(NULL AS INT) AS tp FROM pairs
        UNION ALL
        SELECT g.source_table, g.sp + 1, CASE WHEN any_value(c.tp) IS NULL THEN any_value(g.taken)
                 ELSE list_append(any_value(g.taken), arg_min(c.tp, (-c.score, c.tp))) END,
               arg_min(c.tp, (-c.score, c.tp))
        FROM g LEFT JOIN cand c ON c.source_table = g.source_table AND c.sp = g.sp + 1 AND NOT list_contains(g.taken, c.tp)
        WHERE g.sp < 19 GROUP BY g.source_table, g.sp),
  m AS (SELECT source_table, sp, tp, 'exact' AS how FROM exact
        UNION ALL SELECT source_table, sp, tp, 'similar' FROM g WHERE tp IS NOT NULL),
  mapped AS (SELECT s.source_table, s.target_table, s.column_name AS source_column, t.column_name AS target_column, m.how,
               {_score_sql()} AS score, s.data_type AS stype, t.data_type AS ttype, s.max_length AS slen, t.max_length AS tlen,
               s.nullable AS snull, t.nullable AS tnull, s.is_primary_key AS spk
             FROM m JOIN ss s ON s.source_table = m.source_table AND s.ordinal_position = m.sp
             JOIN tt t ON t.source_table = m.source_table AND t.ordinal_position = m.tp)"""


def _matched(t: Tables) -> DataFrame:
    return match.match_columns(_catalog(t), _pairs(t))


@query("j7_match_columns", f"""{_MATCHED}
SELECT source_table, target_table, source_column, target_column, how, round(score, 9) AS score FROM mapped""")
def _(t: Tables) -> DataFrame:
    return _matched(t).select("source_table", "target_table", F.col("s.column_name").alias("source_column"),
                              F.col("t.column_name").alias("target_column"), "how", F.round("score", 9).alias("score"))


_CHANGES = """changes AS (
  SELECT source_table, source_column, target_column, 'type_conversion' AS change,
    'Convert ' || stype || ' to ' || ttype AS description FROM mapped WHERE stype <> ttype
  UNION ALL SELECT source_table, source_column, target_column, 'string_truncation',
    'Truncate string from ' || slen || ' to ' || tlen || ' characters'
    FROM mapped WHERE stype = 'string' AND ttype = 'string' AND slen > tlen AND tlen > 0
  UNION ALL SELECT source_table, source_column, target_column, 'null_handling',
    'Handle NULL values in ' || source_column || ' (target doesn''t allow NULLs)' FROM mapped WHERE snull AND NOT tnull)"""


@query("j8_changes", f"{_MATCHED}, {_CHANGES} SELECT * FROM changes")
def _(t: Tables) -> DataFrame:
    return match.changes(_matched(t)).drop("source_id", "target_id", "target_table")


_SCORES = """scores AS (SELECT ss.source_table, count(*) AS source_columns,
  (SELECT count(*) FROM mapped WHERE mapped.source_table = ss.source_table) AS mapped_columns,
  round(coalesce((SELECT sum(score) FROM mapped WHERE mapped.source_table = ss.source_table), 0) / count(*), 9)
    AS compatibility_score FROM ss GROUP BY ss.source_table)"""


@query("j9_compatibility", f"{_MATCHED}, {_SCORES} SELECT * FROM scores")
def _(t: Tables) -> DataFrame:
    out = match.compatibility(_catalog(t), _pairs(t), _matched(t))
    return out.select("source_table", "source_columns", "mapped_columns",
                      F.round("compatibility_score", 9).alias("compatibility_score"))


@query("j10_issues", f"""{_MATCHED}, {_CHANGES}
SELECT source_table, 'Unmapped source columns: ' || string_agg(column_name, ', ' ORDER BY ordinal_position) AS issue
  FROM ss WHERE (source_table, column_name) NOT IN (SELECT (source_table, source_column) FROM mapped) GROUP BY source_table
UNION ALL SELECT source_table, 'Required target columns without mapping: ' || string_agg(column_name, ', ' ORDER BY ordinal_position)
  FROM tt WHERE NOT nullable AND (source_table, column_name) NOT IN (SELECT (source_table, target_column) FROM mapped)
  GROUP BY source_table
UNION ALL SELECT source_table, 'Source primary key columns are not mapped' FROM ss WHERE is_primary_key
  AND source_table NOT IN (SELECT source_table FROM mapped WHERE spk)
UNION ALL SELECT source_table, 'Potential data loss in ' || count(*) || ' transformations' FROM changes
  WHERE change IN ('type_conversion', 'string_truncation') GROUP BY source_table""")
def _(t: Tables) -> DataFrame:
    return match.issues(_catalog(t), _pairs(t), _matched(t)).select("source_table", "issue")


_CUSTOMER_TARGET = [
    TargetColumn("customer_id", "integer", "c_custkey", nullable=False),
    TargetColumn("name", "string", "c_name", max_length=12),
    TargetColumn("balance", "decimal", "c_acctbal", precision=12, scale=1),
    TargetColumn("segment", "string", "segment", nullable=False, default="none", max_length=6),
    TargetColumn("email", "string"),
    TargetColumn("active", "boolean", default=True),
]


def _customers(t: Tables) -> DataFrame:
    return t("customer").withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')"))


@query("j11_apply_mapping", """
SELECT CAST(c_custkey AS INT) AS customer_id, substr(c_name, 1, 12) AS name,
  CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(18, 6)) AS DECIMAL(12, 1))::DOUBLE AS balance,
  coalesce(substr(nullif(c_mktsegment, 'BUILDING'), 1, 6), 'none') AS segment, CAST(NULL AS VARCHAR) AS email, true AS active
FROM customer""")
def _(t: Tables) -> DataFrame:
    return apply_mapping(_customers(t), _CUSTOMER_TARGET).withColumn("balance", F.col("balance").cast("double"))


@query("j11_truncated_rows", """
SELECT 'name' AS column_name, 12 AS max_length, count(*) FILTER (length(c_name) > 12) AS truncated_records FROM customer
UNION ALL SELECT 'segment', 6, count(*) FILTER (length(nullif(c_mktsegment, 'BUILDING')) > 6) FROM customer""")
def _(t: Tables) -> DataFrame:
    return truncated_rows(_customers(t), _CUSTOMER_TARGET)


@query("j12_summary", f"""{_MATCHED}, {_SCORES}
SELECT (SELECT count(*) FROM (SELECT DISTINCT source_id, table_name FROM p)) AS total_schemas,
  (SELECT count(DISTINCT table_name) FROM p WHERE source_id = 'shop') AS shop_schemas,
  (SELECT count(DISTINCT table_name) FROM p WHERE source_id = 'warehouse') AS warehouse_schemas,
  count(*) AS total_mappings, round(avg(compatibility_score), 6) AS average_compatibility_score,
  TIMESTAMP '2024-05-06 07:08:09' AS last_mapping FROM scores""")
def _(t: Tables) -> DataFrame:
    scores = match.compatibility(_catalog(t), _pairs(t), _matched(t), datetime(2024, 5, 6, 7, 8, 9))
    out = match.summary(_catalog(t), scores)
    return out.select("total_schemas", F.col("schemas_by_source")["shop"].alias("shop_schemas"),
                      F.col("schemas_by_source")["warehouse"].alias("warehouse_schemas"), "total_mappings",
                      F.round("average_compatibility_score", 6).alias("average_compatibility_score"), "last_mapping")
