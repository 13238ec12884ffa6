"""Rank selection and split windows against plain computations on the same rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sluice.operators import ranks, windows
from tests.conftest import rows

random.seed(11)
DATA = (
    [("hot", round(random.gauss(0, 50), 2)) for _ in range(3000)]
    + [("flat", 7.0)] * 500
    + [("two", v) for v in [1.0] * 90 + [9.0] * 91]
    + [("one", 4.0), ("pair", 1.0), ("pair", 2.0), (None, 3.0), (None, None), ("none", None)]
)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DATA, "k string, v double").repartition(5)


def _groups():
    out = {}
    for k, v in DATA:
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize(("accuracy", "share", "levels"), [
    (10_000, 1 / 16, ranks.LEVELS), (10_000, 1.0, (0.05, 0.2)), (20, 0.5, (0.4, 0.6)), (10_000, 0.01, (9.0,))])
def test_median(data, monkeypatch, accuracy, share, levels):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    monkeypatch.setattr(ranks, "SHARE", share)
    monkeypatch.setattr(ranks, "LEVELS", levels)
    want = {k: statistics.median(v) for k, v in _groups().items()}
    for few in (True, False):
        got = ranks.median(data, ["k"], "v", "m", few_groups=few)
        assert {r.k: r.m for r in got.collect()} == want
    every = [v for _, v in DATA if v is not None]
    assert ranks.median(data, [], "v", "m").first().m == statistics.median(every)


@pytest.mark.parametrize("p", [0, 1, 50, 95, 99, 100])
def test_nearest_rank(data, monkeypatch, p):
    monkeypatch.setattr(ranks, "SHARE", 1.0)
    monkeypatch.setattr(ranks, "LEVELS", (0.06, 0.1))
    want = {k: sorted(v)[min(int(len(v) * p / 100), len(v) - 1)] for k, v in _groups().items()}
    assert {r.k: r.x for r in ranks.nearest_rank(data, ["k"], "v", p, "x").collect()} == want


def test_a_missed_bracket_is_widened(data):
    """The rank asked for is far from the fraction given; the counts must catch it."""
    got = ranks.value_at_rank(data.filter("k = 'hot'"), ["k"], "v", 0.5,
                              {"low": "0L", "high": "n - 1"})
    hot = _groups()["hot"]
    assert rows(got.select("low", "high")) == [(min(hot), max(hot))]


def test_medians_of_integers_are_exact(spark):
    df = spark.createDataFrame([(2_000_000_000, 2 ** 53 + 1), (2_000_000_001, 2 ** 63 - 1)], "i int, b long")
    assert ranks.median(df, [], "i", "m").first().m == 2_000_000_000.5
    assert str(ranks.median(df, [], "b", "m", exact=True).first().m) == str((2 ** 53 + 2 ** 63) // 2) + ".0"
    found = {r.column_name: r.median_exact for r in ranks.medians(df, ["i", "b"]).collect()}
    assert found == {"i": "2000000000.5", "b": str((2 ** 53 + 2 ** 63) // 2)}


def test_large_brackets_are_narrowed(spark, monkeypatch):
    """Many distinct values, and one that half of the rows have, with brackets far above the limit."""
    monkeypatch.setattr(ranks, "RANKED_ROWS", 500)
    monkeypatch.setattr(ranks, "LEVELS", (0.4,))
    monkeypatch.setattr(ranks, "STEPS", 20)
    df = spark.range(60_000).selectExpr("if(id % 2 = 0, 'even', 'hot') AS k",
                                        "if(id % 4 = 1, 777777L, id * 7919 % 1000003) AS v")
    values = {"even": sorted(i * 7919 % 1000003 for i in range(0, 60_000, 2)),
              "hot": sorted(777777 if i % 4 == 1 else i * 7919 % 1000003 for i in range(1, 60_000, 2))}
    for p in (0, 3, 50, 90, 100):
        got = {r.k: r.x for r in ranks.nearest_rank(df, ["k"], "v", p, "x").collect()}
        assert got == {k: v[min(len(v) * p // 100, len(v) - 1)] for k, v in values.items()}
    assert {r.k: r.m for r in ranks.median(df, ["k"], "v", "m").collect()} == {k: statistics.median(v) for k, v in values.items()}


def test_hundred_values(spark):
    df = spark.range(1, 101).select(F.lit("m").alias("k"), F.col("id").cast("double").alias("v"))
    assert ranks.nearest_rank(df, ["k"], "v", 95, "x").first().x == 96.0


@pytest.fixture(scope="module")
def series(spark):
    out = []
    for i in range(900):
        k = "hot" if i % 3 else random.choice(["a", "b", None])
        out.append((k, random.choice([None, *range(60)]), i, random.choice([None, round(random.random(), 3)])))
    return spark.createDataFrame(out, "k string, t int, id int, v double").repartition(6)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("fn", ["row_number", "rank", "lag", "lead", "sum", "count", "min", "max"])
def test_split_windows(series, fn, descending):
    order = ["t"] if fn == "rank" else ["t", "id"]
    column = None if fn in windows.RANKING else "v"
    for width, offset in ((7, 1), (1, 4), (100, 2)):
        plain = windows.window(series, fn, "w", column, ["k"], order, offset, descending)
        split = windows.window(series, fn, "w", column, ["k"], order, offset, descending,
                               bucket=F.floor(F.col("t") / width))
        rounded = lambda df: rows(df.select("id", F.round("w", 6).alias("w")))
        assert rounded(split) == rounded(plain)
    by_data = windows.window(series, fn, "w", column, ["k"], order, 3, descending, bucket="auto")
    assert by_data.columns == [*series.columns, "w"]
    assert rounded(by_data) == rounded(windows.window(series, fn, "w", column, ["k"], order, 3, descending))
    # Without a partition the data always splits it.
    whole = series.withColumn("one", F.lit(1))
    assert rounded(windows.window(series, fn, "w", column, [], order, 2, descending)) == rounded(
        windows.window(whole, fn, "w", column, ["one"], order, 2, descending))


@pytest.fixture(scope="module")
def tied(spark):
    """Half of the rows are equal in partition and order columns; some have nulls there, some are equal in all columns."""
    return spark.range(6000).select(
        F.when(F.col("id") % 11 == 0, None).otherwise("hot").alias("k"),
        F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 7 != 0, F.col("id") % 40).cast("int").alias("t"),
        (F.col("id") - F.col("id") % 3).alias("id"), F.create_map(F.lit("a"), "id").alias("m")).repartition(6)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partition", [["k"], []])
def test_hot_ties(tied, partition, descending):
    whole = tied.withColumn("one", F.lit(1))
    for fn, column in (("rank", None), ("sum", "id"), ("count", "id"), ("max", "id")):
        split = windows.window(tied, fn, "w", column, partition, ["t"], descending=descending, bucket="auto")
        plain = windows.window(whole, fn, "w", column, partition or ["one"], ["t"], descending=descending)
        assert split.schema["w"].dataType == plain.schema["w"].dataType and split.columns == [*tied.columns, "w"]
        assert rows(split.drop("m")) == rows(plain.drop("m", "one"))
    numbered = windows.window(tied, "row_number", "w", None, partition, ["t"], descending=descending, bucket="auto")
    ranked = windows.window(numbered, "rank", "r", None, partition, ["t"], descending=descending, bucket="auto")
    per = ranked.groupBy(*partition).agg(F.count("w").alias("n"), F.countDistinct("w").alias("d"), F.min("w").alias("a"), F.max("w").alias("z"))
    assert all(r.n == r.d == r.z and r.a == 1 for r in per.collect())
    # A value's numbers start at its rank, without gaps.
    ties = ranked.groupBy(*partition, "t", "r").agg(F.count("w").alias("n"), F.min("w").alias("a"), F.max("w").alias("z")).collect()
    assert all(r.a == r.r and r.z == r.r + r.n - 1 for r in ties)


def test_hot_ties_spread_over_ranges(spark, tied):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        dealt = windows._ranged(tied.withColumn("_tie", windows._row_hash(tied)), ["k"], ["t", "_tie"], False, ordered=True)
        most = dealt.where("t = 5").groupBy("_range").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set(name, before)
    assert most < tied.where("t = 5").count() / 2


@pytest.mark.parametrize("fn", ["row_number", "rank", "lag"])
def test_ranges_hold_as_many_rows_at_any_number_of_shuffle_partitions(spark, monkeypatch, fn):
    made = []
    ranged = windows._ranged
    monkeypatch.setattr(windows, "_ranged", lambda *args, **named: made.append(ranged(*args, **named)) or made[-1])
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 500)
    df = spark.range(20_000).selectExpr("id", "id % 3 AS k", "id % 2 AS t")  # 40 ranges, the session has 4 shuffle partitions
    order = ["t"] if fn == "rank" else ["t", "id"]
    split = windows.window(df, fn, "w", "id", ["k"], order, bucket="auto")
    assert rows(split) == rows(windows.window(df, fn, "w", "id", ["k"], order))
    # Bounds come from samples, so ranges differ a little.
    assert made[0].groupBy("_range").count().agg(F.max("count")).first()[0] < 1500


def test_split_windows_over_nothing(tied):
    for fn in ("rank", "row_number", "sum", "lag"):
        assert windows.window(tied.limit(0), fn, "w", "id", ["k"], ["t"], bucket="auto").count() == 0


def test_a_lag_over_split_windows_scans_its_table_twice(spark, sf):
    from sluice.queries import QUERIES

    plan = QUERIES["g3_lag_big_groups"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_unsplit_windows_over_everything_warn(series):
    with pytest.warns(UserWarning, match="one task"):
        windows.window(series, "avg", "w", "v", [], ["t", "id"])


def test_partition_total(series):
    plain = series.groupBy("k").agg(F.sum("v").alias("s")).collect()
    want = {r.k: round(r.s, 6) for r in plain}
    for few in (False, True):
        out = windows.window(series, "sum", "s", "v", ["k"], few_groups=few)
        assert out.count() == series.count()
        assert {r.k: r.s for r in out.select("k", F.round("s", 6).alias("s")).distinct().collect()} == want


def test_window_rejections(series):
    with pytest.raises(ValueError, match="needs an order"):
        windows.window(series, "rank", "w", partition=["k"])
    with pytest.raises(ValueError, match="bucketed"):
        windows.window(series, "avg", "w", "v", ["k"], ["t"], bucket=F.col("t"))


def test_rows_of_few_large_partitions_are_not_shuffled_by_them(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, NULL, id % 3) AS k", "id % 2 AS t")
    for fn, column, args in (("row_number", None, {"bucket": "auto", "order": ["t"]}), ("rank", None, {"bucket": "auto", "order": ["t"]}),
                             ("sum", "id", {"bucket": "auto", "order": ["t"]}), ("sum", "id", {"few_groups": True})):
        out = windows.window(df, fn, "x", column, ["k"], **args)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_g#" not in plan and "hashpartitioning(_p#" not in plan
        if fn != "row_number":
            assert rows(out) == rows(windows.window(df, fn, "x", column, ["k"], args.get("order", [])))
