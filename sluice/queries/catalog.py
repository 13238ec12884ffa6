"""Sources, sinks and the catalog (area A). Round trips write to a new shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.queries.registry import NAMES, Tables, query
from sluice.session import scratch_path
from sluice.sources import catalog, files


def _round_trip(t: Tables, df: DataFrame, fmt: str, **options) -> DataFrame:
    path = f"{scratch_path(t.spark, fmt)}.{fmt}"
    files.save(df, path)
    return files.load(t.spark, path, options=options)


@query("a1_csv", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, t("customer"), "csv")


@query("a2_json", "SELECT * FROM nation")
def _(t: Tables) -> DataFrame:
    return _round_trip(t, t("nation"), "json").withColumns(
        {c: F.col(c).cast("int") for c in ("n_nationkey", "n_regionkey")})


@query("a3_parquet", "SELECT * FROM orders")
def _(t: Tables) -> DataFrame:
    return files.load(t.spark, t.path("orders"))


@query("a5_reader_options", "SELECT s_suppkey::INT AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t: Tables) -> DataFrame:
    path = f"{scratch_path(t.spark, 'piped')}.csv"
    files.save(t("supplier"), path, options={"sep": "|"})
    return files.load(t.spark, path, options={"sep": "|"})


@query("a6_registered", "SELECT r_name, r_regionkey FROM region WHERE r_regionkey > 1")
def _(t: Tables) -> DataFrame:
    files.load(t.spark, t.path("region"), options={"table_name": "sluice_region"})
    return files.query(t.spark, "SELECT r_name, r_regionkey FROM sluice_region WHERE r_regionkey > 1")


@query("a8_path_as_table", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment")
def _(t: Tables) -> DataFrame:
    return files.query(t.spark, "SELECT c_mktsegment, count(*) AS customers FROM people GROUP BY c_mktsegment",
                       tables={"people": t.path("customer")})


_COUNTS = " UNION ALL ".join(f"SELECT 'files' AS source_id, '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES)


def _all(t: Tables) -> dict[str, DataFrame]:
    return {n: t(n) for n in NAMES}


@query("a12_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) > 0 AS filled FROM {n}" for n in NAMES))
def _(t: Tables) -> DataFrame:
    listed = catalog.list_files(t.spark, t.folder).select("table_name")
    counted = catalog.table_metadata(_all(t), "files").select("table_name", (F.col("row_count") > 0).alias("filled"))
    return listed.join(counted, "table_name")


@query("a13_metadata", f"""
SELECT table_name, row_count, (SELECT count(*) FROM duckdb_columns() WHERE duckdb_columns.table_name = c.table_name)
  AS column_count FROM ({_COUNTS}) AS c""")
def _(t: Tables) -> DataFrame:
    return catalog.table_metadata(_all(t), "files", {n: t.path(n) for n in NAMES}).select(
        "table_name", "row_count", F.col("column_count").cast("long").alias("column_count"))


def _of_source(found: DataFrame, source: DataFrame) -> DataFrame:
    """How many rows were found, and how many of them are not rows of the source."""
    strange = found.join(source, source.columns, "left_anti").agg(F.count("*").alias("strange"))
    return found.agg(F.count("*").alias("n")).crossJoin(strange)  # one row each


@query("a14_sample", "SELECT least(10, count(*)) AS n, 0 AS strange FROM lineitem")
def _(t: Tables) -> DataFrame:
    return _of_source(catalog.sample(t("lineitem"), 10), t("lineitem")).select("n", F.col("strange").cast("int").alias("strange"))


@query("a14_sample_fraction", "SELECT true AS near, 0 AS strange")
def _(t: Tables) -> DataFrame:
    # Five standard errors around the share asked for.
    counts = _of_source(catalog.sample(t("lineitem"), fraction=0.01), t("lineitem"))
    every = t("lineitem").agg(F.count("*").alias("every"))
    near = F.abs(F.col("n") - 0.01 * F.col("every")) <= 5 * F.sqrt(0.0099 * F.col("every"))
    return counts.crossJoin(every).select(near.alias("near"), F.col("strange").cast("int").alias("strange"))


@query("a4_detected", "SELECT 'csv' AS format, count(*) AS n FROM nation UNION ALL SELECT 'json', count(*) FROM nation "
       "UNION ALL SELECT 'parquet', count(*) FROM nation")
def _(t: Tables) -> DataFrame:
    out = [_round_trip(t, t("nation"), fmt).agg(F.lit(fmt).alias("format"), F.count("*").alias("n")) for fmt in ("csv", "json", "parquet")]
    return out[0].union(out[1]).union(out[2])


@query("a7_rows_in_memory", "SELECT n_name, r_name FROM nation JOIN (VALUES (0, 'AFRICA'), (1, 'AMERICA')) v(k, r_name) ON n_regionkey = k")
def _(t: Tables) -> DataFrame:
    named = files.from_rows(t.spark, [{"k": 0, "r_name": "AFRICA"}, {"k": 1, "r_name": "AMERICA"}])
    return t("nation").join(F.broadcast(named), F.col("n_regionkey") == F.col("k")).select("n_name", "r_name")


@query("a13_sizes")
def _(t: Tables) -> DataFrame:
    return catalog.table_sizes(t.spark, {n: t.path(n) for n in NAMES})


@query("a13_columns", """
SELECT table_name, column_name, column_index::INT AS ordinal_position, is_nullable AS nullable,
  numeric_precision::INT AS numeric_precision, numeric_scale::INT AS numeric_scale, column_default, character_maximum_length::INT AS max_length
FROM duckdb_columns() WHERE table_name IN ('nation', 'orders', 'labels')""")
def _(t: Tables) -> DataFrame:
    return catalog.column_details({n: t(n) for n in ("nation", "orders", "labels")})


_KIND = """CASE WHEN table_name IN ('documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
  THEN 'text' ELSE 'tabular' END"""


def _discovered(t: Tables) -> DataFrame:
    text = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    parts = {"texts": ("text", [n for n in NAMES if n in text]), "rows": ("tabular", [n for n in NAMES if n not in text])}
    return catalog.discover({sid: (kind, {n: t(n) for n in names}) for sid, (kind, names) in parts.items()},
                            {sid: {n: t.path(n) for n in names} for sid, (_, names) in parts.items()})


@query("a17_discover", f"SELECT {_KIND} AS source_type, table_name, row_count FROM ({_COUNTS}) AS c")
def _(t: Tables) -> DataFrame:
    return _discovered(t).select("source_type", "table_name", "row_count")


@query("a18_discovery_summary", f"""
SELECT source_type, 1::BIGINT AS sources, count(*) AS tables, sum(row_count)::BIGINT AS total_rows
FROM (SELECT {_KIND} AS source_type, row_count FROM ({_COUNTS}) AS c) GROUP BY source_type""")
def _(t: Tables) -> DataFrame:
    return catalog.discovery_summary(_discovered(t))


@query("a19_save_registered", "SELECT * FROM part WHERE p_size < 10")
def _(t: Tables) -> DataFrame:
    t("part").filter("p_size < 10").createOrReplaceTempView("sluice_small_parts")
    path = f"{scratch_path(t.spark, 'parts')}.parquet"
    files.save("sluice_small_parts", path, spark=t.spark)
    return files.load(t.spark, path)


@query("a20_rows_written", "SELECT count(*) AS rows FROM lineitem WHERE l_quantity > 30")
def _(t: Tables) -> DataFrame:
    written = files.save(t("lineitem").filter("l_quantity > 30"), f"{scratch_path(t.spark, 'items')}.parquet")
    return t.spark.createDataFrame([(written.get["rows"],)], "rows long")


@query("a21_query_to_json", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def _(t: Tables) -> DataFrame:
    found = files.query(t.spark, "SELECT o_orderstatus, count(*) AS orders FROM {orders} GROUP BY o_orderstatus",
                        tables={"orders": t("orders")})
    return _round_trip(t, found, "json")


@query("a22_optimized_table", "SELECT * FROM supplier")
def _(t: Tables) -> DataFrame:
    name, path = f"supplier_{uuid.uuid4().hex}", f"{scratch_path(t.spark, 'optimized')}.parquet"
    t("supplier").createOrReplaceTempView(name)
    files.optimize_table(t.spark, name, ["s_nationkey", "s_suppkey"])
    files.save(f"{name}_optimized", path, spark=t.spark)  # read while it is cached
    files.release(t.spark, name)
    t.spark.catalog.dropTempView(name)
    return t.spark.read.parquet(path)


@query("a23_partitioned_layout", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW'")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "by-priority")
    files.lay_out(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, ["o_orderpriority"])
    return t.spark.read.parquet(path).filter("o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice")


@query("a23_clustered_layout", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
WHERE l_extendedprice BETWEEN 20000 AND 30000 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01'""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "clustered")
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    files.cluster(t("lineitem").select(*columns), path, ["l_extendedprice", "l_shipdate"], 32, lookups=["l_orderkey"])
    return t.spark.read.parquet(path).filter(
        "l_extendedprice BETWEEN 20000 AND 30000 AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-07-01'")


@query("a23_bucketed_join", """
SELECT o_orderpriority, count(*) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def _(t: Tables) -> DataFrame:
    run = uuid.uuid4().hex
    files.bucket(t("orders").select("o_orderkey", "o_orderpriority"), f"orders_{run}", ["o_orderkey"], 8,
                 scratch_path(t.spark, "orders"))
    files.bucket(t("lineitem").select("l_orderkey", "l_linenumber"), f"items_{run}", ["l_orderkey"], 8,
                 scratch_path(t.spark, "items"))
    joined = t.spark.table(f"orders_{run}").join(t.spark.table(f"items_{run}"), F.expr("o_orderkey = l_orderkey"))
    for name in (f"orders_{run}", f"items_{run}"):
        t.spark.sql(f"DROP TABLE {name}")  # the files stay, as they have a path of their own
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("items"))
