import sqlite3

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from sluice import build_session, scratch_path
from sluice.operators import aggregates
from sluice.session import broadcast_if_small, plan_bytes
from sluice.sources import catalog, databases, files, sqlite
from tests.conftest import rows


@pytest.mark.parametrize(("path", "want"), [
    ("/a/b.csv", "csv"), ("x.JSON", "json"), ("s3://b/c.parquet", "parquet"), ("data", "csv"), ("a.txt", "csv")])
def test_formats(path, want):
    assert files.detect_format(path) == want


def test_options_reach_the_reader(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("1;x\n2;y\n")
    df = files.load(spark, str(path), options={"sep": ";", "header": False, "table_name": "piped"},
                    schema="id int, name string")
    assert rows(df) == [(1, "x"), (2, "y")] and rows(spark.table("piped")) == rows(df)
    doc = tmp_path / "d.json"
    doc.write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(files.load(spark, str(doc), options={"multiLine": True})) == [(1,), (2,)]
    with pytest.raises(ValueError, match="unsupported format"):
        files.load(spark, "x", "excel")


def test_rows_in_memory(spark):
    want = [(1, "a"), (2, "b")]
    assert rows(files.from_rows(spark, [{"i": 1, "s": "a"}, {"i": 2, "s": "b"}])) == want
    assert rows(files.from_rows(spark, {"i": [1, 2], "s": ["a", "b"]})) == want
    assert rows(files.from_rows(spark, pd.DataFrame({"i": [1, 2], "s": ["a", "b"]}))) == want
    assert files.register(files.from_rows(spark, {"i": [1]})).startswith("table_")


def test_typed_parameters(spark):
    t = files.from_rows(spark, {"s": ["it's", "x"]})
    assert rows(files.query(spark, "SELECT s FROM {t} WHERE s = :v", {"v": "it's"}, {"t": t})) == [("it's",)]


def test_save_counts_and_reads_back(spark, tmp_path):
    df = files.from_rows(spark, {"a": [3, 1, 2], "b": ["x", "y", "z"]})
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / f"out.{fmt}")
        assert files.save(df, path).get["rows"] == 3
        files.save(df, path, mode="append")
        assert files.load(spark, path).count() == 6
        files.save(df, path)
        assert rows(files.load(spark, path).select("a", "b")) == [(1, "y"), (2, "z"), (3, "x")]


def test_optimize_and_release(spark):
    files.from_rows(spark, {"a": [1, 2]}).createOrReplaceTempView("tiny")
    files.optimize_table(spark, "tiny", ["a"])
    assert spark.catalog.isCached("tiny") and spark.table("tiny_optimized").count() == 2
    files.release(spark, "tiny")
    assert not spark.catalog.isCached("tiny")


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("left_b", "right_b"):
        files.bucket(spark.range(1000).withColumnRenamed("id", "k"), name, ["k"], 4, scratch_path(spark, name))
    joined = spark.table("left_b").hint("merge").join(spark.table("right_b"), "k")
    assert joined.count() == 1000
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE customers (id INTEGER PRIMARY KEY, name VARCHAR(50) NOT NULL, score REAL DEFAULT 0)")
        c.executemany("INSERT INTO customers VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 101)])
        c.execute("CREATE TABLE \"odd name\" (x)")
        c.execute("INSERT INTO \"odd name\" VALUES (NULL)")
    c.close()
    return path


def test_sqlite(spark, db):
    df = sqlite.read(spark, db, "customers", partitions=3)
    assert df.rdd.getNumPartitions() == 3
    assert rows(aggregates.multi_aggregate(df, [("id", "count"), ("score", "sum")])) == [(100, 2525.0)]
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert df.schema["name"].metadata["raw_type"] == "VARCHAR(50)"
    assert rows(sqlite.read(spark, db, query="SELECT count(*) AS n, max(name) AS m FROM customers")) == [(100, "n99")]
    assert rows(sqlite.tables(spark, db)) == [("customers",), ("odd name",)]
    assert rows(sqlite.read(spark, db, "odd name", partitions=4)) == [(None,)]
    assert rows(sqlite.columns(spark, db, "customers").select("column_name", "raw_type", "nullable", "is_primary_key")) == [
        ("id", "INTEGER", 1, 1), ("name", "VARCHAR(50)", 0, 0), ("score", "REAL", 1, 0)]
    assert sqlite.sample(spark, db, "customers", 7).count() == 7
    with pytest.raises(Exception, match="readonly|read-only"):
        with sqlite._connect(db) as c:
            c.execute("DELETE FROM customers")


def test_connection_parameters():
    env = {"POSTGRES_HOST": "db1", "POSTGRES_PORT": "6000", "POSTGRES_PASSWORD": "from-env"}
    got = databases.resolve({"type": "postgres", "database": "shop"}, env)
    assert (got["type"], got["host"], got["port"], got["password"]) == ("postgresql", "db1", 6000, "from-env")
    assert databases.resolve({"type": "mysql"}, {})["port"] == 3306
    assert "password" not in databases.connection_info({"type": "mysql", "password": "x"})
    with pytest.raises(ValueError, match="unknown source type"):
        databases.resolve({"type": "oracle"}, {})


def test_jdbc_options():
    config = {"type": "postgresql", "host": "h", "database": "d", "username": "u", "password": "p"}
    whole = databases.jdbc_options(config, table="orders", partition=("id", 0, 1000, 8))
    assert whole["url"] == "jdbc:postgresql://h:5432/d" and whole["dbtable"] == "orders"
    assert (whole["partitionColumn"], whole["numPartitions"]) == ("id", "8")
    assert databases.jdbc_options(config, query="SELECT 1")["query"] == "SELECT 1"
    split = databases.jdbc_options(config, query="SELECT * FROM t", partition=("id", 0, 9, 2))
    assert split["dbtable"] == "(SELECT * FROM t) AS q" and "query" not in split
    with pytest.raises(ValueError, match="either"):
        databases.jdbc_options(config)
    assert "pg_catalog" in databases.tables_query("postgres") and "performance_schema" in databases.tables_query("mysql")
    assert "it''s" in databases.columns_query("mysql", "it's")


def test_no_connection_is_false(spark):
    assert databases.test_connection(spark, {"type": "mysql"}) is False
    assert databases.test_connection(spark, {"type": "sqlite", "database": "/nowhere/x.db"}) is False


def test_sqlite_connection(spark, db):
    assert databases.test_connection(spark, {"type": "sqlite", "database": db}) is True


def test_connector_registration(spark):
    class Numbers(DataSource):
        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from ((i,) for i in range(3))

            return Reader()

    sqlite.register_connector(spark, "numbers", Numbers)
    assert rows(spark.read.format("numbers").load()) == [(0,), (1,), (2,)]
    assert {"numbers", "sqlite", "mysql", "postgresql"} <= set(sqlite.available_connectors())
    with pytest.raises(ValueError, match="calls itself"):
        sqlite.register_connector(spark, "letters", Numbers)


def test_catalog(spark, sf):
    df = files.from_rows(spark, {"a": [1], "b": ["x"]})
    got = catalog.column_rows({"t": df}, "mem", {"t": ["a"]})
    assert rows(got.select("column_name", "raw_type", "is_primary_key")) == [("a", "bigint", True), ("b", "text", False)]
    df.createOrReplaceTempView("seen_here")
    assert ("seen_here", "TEMPORARY") in rows(catalog.list_tables(spark))
    assert catalog.list_files(spark, sf).count() == 14


def test_broadcast_only_when_small(spark):
    small, big = spark.range(10), spark.range(100_000_000)
    assert plan_bytes(small) < 1000
    assert "broadcast" in broadcast_if_small(small)._jdf.queryExecution().toString()
    assert "broadcast" not in broadcast_if_small(big)._jdf.queryExecution().toString()


def test_scratch_is_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert build_session().conf.get("spark.sql.ansi.enabled") == "true"


def test_sqlite_never_converts_with_loss(spark, tmp_path):

    path = str(tmp_path / "mixed.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INT, b REAL, c TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(None, 1, "x"), (1, 2.5, "y"), (2, 3, None)])
        db.execute("CREATE TABLE bad (a INT)")
        db.executemany("INSERT INTO bad VALUES (?)", [(1,), (3.7,), (2,)])
    assert sorted(sqlite.read(spark, path, "t").select("b").collect()) == [(1.0,), (2.5,), (3.0,)]
    by_query = sqlite.read(spark, path, query="SELECT a, b, c FROM t")
    assert by_query.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    with pytest.raises(Exception, match="is not a bigint"):
        sqlite.read(spark, path, "bad").collect()
    assert sorted(sqlite.read(spark, path, query="SELECT a FROM bad").collect()) == [(1.0,), (2.0,), (3.7,)]


def test_query_leaves_session_views_alone(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    out = files.query(spark, "SELECT count(*) AS n FROM kept_view JOIN other_view USING (id)",
                      tables={"kept_view": spark.range(10), "other_view": spark.range(7)})
    assert out.first().n == 7 and spark.table("kept_view").count() == 3
    assert not spark.catalog.tableExists("other_view")
    spark.catalog.dropTempView("kept_view")


def test_many_tables_in_one_scan(spark, tmp_path):
    root = f"file://{tmp_path}/with space"
    spark.range(10).repartition(3).write.parquet(f"{root}/a.parquet")
    spark.range(100).withColumn("day", F.col("id") % 4).write.partitionBy("day").parquet(f"{root}/days")
    spark.range(7).selectExpr("cast(id as string) AS `no column`").write.parquet(f"{root}/days-more")
    spark.range(0).write.parquet(f"{root}/empty")
    paths = {n: f"{root}/{n}" for n in ("a.parquet", "days", "days-more", "empty")}
    counts = catalog.file_counts(spark, paths)
    assert {r.name: r.row_count for r in counts.collect()} == {"a.parquet": 10, "days": 100, "days-more": 7, "empty": 0}
    size = sum(f.stat().st_size for f in (tmp_path / "with space" / "days").rglob("*.parquet"))
    assert {r.name: (r.bytes == size, r.files >= 4) for r in counts.where("name = 'days'").collect()} == {"days": (True, True)}
    tables = {n: spark.read.parquet(p) for n, p in paths.items()}
    mixed = catalog.discover({"one": ("lake", tables), "two": ("memory", {"days": spark.range(3)})}, {"one": paths})
    assert {(r.source_id, r.source_type, r.table_name, r.row_count, r.column_count) for r in mixed.collect()} == {
        ("one", "lake", "a.parquet", 10, 1), ("one", "lake", "days", 100, 2), ("one", "lake", "days-more", 7, 1),
        ("one", "lake", "empty", 0, 1), ("two", "memory", "days", 3, 1)}
    plan = catalog.table_metadata(tables, "one", paths)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<>" in plan


def test_clustered_layout_reads_few_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 40_000
    table = pd.DataFrame({"a": rng.lognormal(3, 2, n), "b": rng.integers(0, 10 ** 6, n), "name": rng.permutation(n).astype(str),
                          "key": rng.permutation(n) * 3, "same": 7})
    df = spark.createDataFrame(table).withColumn("a", F.when(F.col("key") % 50 == 0, None).otherwise(F.col("a")))
    path = str(tmp_path / "clustered")
    files.cluster(df, path, ["a", "b"], 64, lookups=["key"])
    back = spark.read.parquet(path)
    assert back.columns == df.columns and back.exceptAll(df).isEmpty() and back.count() == n

    def scanned(condition):
        """Rows that the scan handed on: those of the row groups it could not rule out."""
        found = back.where(condition)
        assert rows(found) == rows(df.where(condition))
        plan = found._jdf.queryExecution().executedPlan()  # the plan that `rows` has run
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    low, high = (float(table.a.quantile(q)) for q in (0.3, 0.4))
    both = f"a BETWEEN {low} AND {high} AND b BETWEEN 300000 AND 400000"
    assert 0 < scanned(both) < n * 0.15
    assert scanned(f"a BETWEEN {low} AND {high}") < n * 0.4 and scanned("b BETWEEN 300000 AND 400000") < n * 0.4
    assert scanned("key = 60001") < n * 0.1  # not there, though inside the bounds of every file

    files.cluster(df, path + "-three", ["name", "b", "a"], 64)
    back = spark.read.parquet(path + "-three")
    assert scanned("name >= '5' AND name < '6'") < n * 0.6 and scanned(both) < n * 0.4

    files.cluster(df.select("same"), str(tmp_path / "one"), ["same"], 8)
    parts = [pq.read_metadata(f).num_rows for f in (tmp_path / "one").glob("*.parquet")]
    assert len(parts) == 8 and max(parts) < n / 4
    files.cluster(df.limit(0), str(tmp_path / "none"), ["a"], 4)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="seven"):
        files.cluster(df, path, [])
