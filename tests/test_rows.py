import bisect
import math
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluice.functions import cleaning
from sluice.operators import aggregates, joins, rows as ops
from sluice.operators.order import cut_number
from sluice.plans.spec import check_spec, run_spec
from tests.conftest import rows


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0, None), (2, "b", None, "x"), (3, None, 30.0, "y"), (4, "a", 5.0, "x")],
        "id int, k string, v double, note string")


def test_filter_after_aggregate_acts_on_groups(people):
    out = run_spec(people, [
        {"type": "aggregate", "source_columns": ["v"], "config": {"function": "sum", "group_by": ["k"]}},
        {"type": "filter", "config": {"condition": "v_sum > 20"}}])
    assert rows(out) == [(None, 30.0)]


def test_null_keys_form_a_group_and_names_follow(people):
    out = aggregates.aggregate(people, ["v"], "avg", ["k"])
    assert out.columns == ["k", "v_avg"]
    assert rows(out) == [("a", 7.5), ("b", None), (None, 30.0)]


def test_default_functions(people):
    assert aggregates.aggregate(people, ["v"]).columns == ["v_sum"]
    assert rows(aggregates.aggregate(people)) == [(4,)]


def test_rejections(people):
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregates.aggregate(people, ["v"], "harmonic")
    with pytest.raises(ValueError, match="needs a number"):
        aggregates.aggregate(people, ["k"], "sum")
    with pytest.raises(ValueError, match="needs columns"):
        aggregates.aggregate(people, [], "sum")
    with pytest.raises(ValueError, match="order column"):
        aggregates.aggregate(people, ["v"], "first", ["k"])
    with pytest.raises(ValueError, match="unknown operation"):
        run_spec(people, [{"type": "teleport"}])
    with pytest.raises(ValueError, match="join type"):
        joins.join(people, people, ["id"], "sideways")
    with pytest.raises(KeyError, match="not given"):
        run_spec(people, [{"type": "join", "source_columns": ["id"], "config": {"right_table": "nowhere"}}])


def test_sort_nulls(people):
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(ops.sort(people, ["v"])) == [4, 1, 3, 2]
    assert ids(ops.sort(people, ["v"], False)) == [3, 1, 4, 2]
    assert ids(ops.sort(people, ["v"], True, "first")) == [2, 4, 1, 3]


def test_join_suffix_and_kinds(spark, people):
    other = spark.createDataFrame([(1, "p"), (1, "q"), (9, "r"), (None, "s")], "id int, note string")
    out = joins.join(people, other, ["id"])
    assert out.columns == ["id", "k", "v", "note", "note_right"]
    assert rows(out.select("id", "note_right")) == [(1, "p"), (1, "q")]
    assert rows(joins.join(people, other, ["id"], "full").select("id", "note_right")) == [
        (1, "p"), (1, "q"), (2, None), (3, None), (4, None), (9, "r"), (None, "s")]
    assert rows(joins.join(people, other, "l.id = r.id", "left_anti").select("id")) == [(2,), (3,), (4,)]
    assert rows(joins.join(people, other, "l.id < r.id").select("id", "id_right")) == [(1, 9), (2, 9), (3, 9), (4, 9)]
    assert joins.join(people, other, how="cross").count() == 16


def test_full_join_equals_outer(spark):
    a = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(40)], "k int, a int")
    b = spark.createDataFrame([(i % 11 if i % 3 else None, i) for i in range(30)], "k int, b int")
    assert rows(joins.join(a, b, ["k"], "full")) == rows(a.join(b, ["k"], "full"))


def test_cast(people):
    bad = people.selectExpr("coalesce(k, '7') AS k")
    assert rows(ops.cast(bad, {"k": "int"})) == [(7,), (None,), (None,), (None,)]
    assert rows(ops.cast_failures(bad, {"k": "int"})) == [("k", "int", 3)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ops.cast(bad, {"k": "int"}, strict=True).collect()


def test_check_spec(people):
    report = check_spec(people, [
        {"type": "select", "source_columns": ["id", "v"]},
        {"type": "filter", "config": {"condition": "nothing > 1"}},
        {"type": "sort", "source_columns": ["id"]}])
    assert [r["ok"] for r in report] == [True, False]
    assert report[0]["columns"] == ["id", "v"] and "nothing" in report[1]["error"]


def test_named_operations(spark, people):
    out = run_spec(people, [
        {"type": "clean", "source_columns": ["k"], "config": {"steps": [["null_handling", {"default_value": "?"}],
                                                                       "case_standardization"]}},
        {"type": "rank", "source_columns": [], "config": {"partition": ["k"], "order": ["v"]}},
        {"type": "case_when", "config": {"name": "big", "branches": [["v > 9", "yes"]], "otherwise": "no"}},
        {"type": "union", "config": {"tables": ["more"], "allow_missing": True}},
        {"type": "limit", "config": {"n": 100}}],
        {"more": spark.createDataFrame([(7,)], "id int")})
    assert rows(out.select("id", "k", "rank", "big")) == sorted(
        [(1, "A", 2, "yes"), (2, "B", 1, "no"), (3, "?", 1, "yes"), (4, "A", 1, "no"), (7, None, None, None)], key=repr)


def test_validate_operation(people):
    out = run_spec(people, [{"type": "validate", "config": {"rules": [
        {"rule_id": "k", "rule_type": "completeness", "column": "k"},
        {"rule_id": "v", "rule_type": "range", "column": "v", "parameters": {"max_value": 20}}]}}])
    assert rows(out.select("id", "_violations")) == [(1, []), (2, []), (3, ["k", "v"]), (4, [])]


def test_keep_last(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-03-31')) AS d")
    assert ops.keep_last(days, "d", 2, "weeks").count() == 15
    assert ops.keep_last(days, "d", 1, "month", "2024-02-29").count() == 32
    with pytest.raises(ValueError, match="unit"):
        ops.keep_last(days, "d", 1, "fortnight")


@pytest.mark.parametrize(("raw", "want"), [
    ("(555) 123-4567", "+15551234567"), ("+44 20 7946 0958", "+442079460958"), ("555.123.4567", "+15551234567"),
    ("0049 30 123456", "+004930123456"), ("123", None), ("", None), ("no phone", None), (None, None),
    ("+1 (555) 123+4567", "+15551234567"), ("1234567890123456", None)])
def test_phone(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(cleaning.clean_phone("p")).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [
    (" A.B@Example.Com ", True), ("a@b.co", True), ("a+b@mail.example.org", True), ("a@b", False), ("@b.com", False),
    ("a b@c.com", False), ("a@b..com", False), ("a@b.c", False), (None, None)])
def test_email(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(cleaning.is_email("p")).first()[0] is want


def test_date_patterns():
    assert cleaning.spark_pattern("%Y-%m-%d at %H:%M") == "yyyy-MM-dd 'a''t' HH:mm"
    assert cleaning.spark_pattern("yyyy/MM") == "yyyy/MM"
    with pytest.raises(ValueError, match="date code"):
        cleaning.spark_pattern("%Q")


def test_templates(spark, people):
    out = people.select(cleaning.template("null_handling", column="k", default_value="default").alias("k"))
    assert rows(out) == [("a",), ("a",), ("b",), ("default",)]
    count = people.select(cleaning.template("count", category="aggregations", column="k"))
    assert rows(count) == [(3,)]
    lagged = people.select("id", cleaning.template("lag", category="window_functions", column="id", offset=1,
                                                   partition="k", order="id"))
    assert rows(lagged) == [(1, None), (2, None), (3, None), (4, 1)]
    with pytest.raises(ValueError, match="unknown template"):
        cleaning.template("nothing", column="k")
    with pytest.raises(ValueError, match="category"):
        cleaning.template("trim_whitespace", category="other", column="k")


def test_unknown_column_is_an_analysis_error(people):
    with pytest.raises(AnalysisException):
        ops.select(people, ["missing"]).collect()


def _pairs(left, right, low_open, high_open, extra=lambda a, b: True):
    def inside(v, lo, hi):
        return v is not None and (lo < v or lo == v and not low_open) and (v < hi or v == hi and not high_open)

    return [(a, b) for a in left for b in right if b[1] is not None and b[2] is not None and inside(a[1], b[1], b[2]) and extra(a, b)]


@pytest.mark.parametrize(("low_open", "high_open", "buckets"), [(False, False, 7), (True, False, 64), (False, True, 2), (True, True, 300)])
def test_range_join_by_brute_force(spark, low_open, high_open, buckets):
    rng = random.Random(buckets)
    left = [(i, rng.choice([None, rng.randrange(100), 50, 50])) for i in range(300)]
    right = [(i, rng.choice([None, (a := rng.randrange(-20, 120))]), a + rng.choice([-3, 0, 0, 2, 9, 80])) for i in range(120)]
    l, r = spark.createDataFrame(left, "id int, v int"), spark.createDataFrame(right, "id int, lo int, hi int")
    args = dict(low="r.lo", high="r.hi", low_open=low_open, high_open=high_open, buckets=buckets)
    want = _pairs(left, right, low_open, high_open)
    found = {a for a, _ in want}
    assert rows(joins.range_join(l, r, "l.v", **args)) == sorted([a + b for a, b in want], key=repr)
    assert rows(joins.range_join(l, r, "l.v", how="semi", **args)) == sorted(found, key=repr)
    assert rows(joins.range_join(l, r, "l.v", how="anti", **args)) == sorted(set(left) - found, key=repr)
    outer = [a + b for a, b in want] + [a + (None, None, None) for a in set(left) - found]
    assert rows(joins.range_join(l, r, "l.v", how="left", **args)) == sorted(outer, key=repr)
    some = _pairs(left, right, low_open, high_open, lambda a, b: (a[0] + b[0]) % 3 == 0)
    assert rows(joins.range_join(l, r, "l.v", condition="(l.id + r.id) % 3 = 0", **args)) == sorted([a + b for a, b in some], key=repr)


def test_range_join_of_one_bound_and_of_nothing(spark):
    l = spark.createDataFrame([(i, i % 13 - 5.5) for i in range(60)], "id int, v double")
    r = spark.createDataFrame([(k,) for k in (-9, 0, 3, 50)], "k int")
    for args, sql in ((dict(low="r.k"), "v >= k"), (dict(low="r.k", low_open=True), "v > k"), (dict(high="r.k + 1"), "v <= k + 1")):
        assert rows(joins.range_join(l, r, "l.v", buckets=9, **args)) == rows(l.crossJoin(r).where(sql))
    assert joins.range_join(l.limit(0), r, "l.v", low="r.k").count() == 0
    assert joins.range_join(l, r.limit(0), "l.v", low="r.k", how="left").count() == 60
    plan = joins.range_join(l, r, "l.v", low="r.k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="range join"):
        joins.range_join(l, r, "l.v", low="r.k", how="full")
    with pytest.raises(ValueError, match="bound"):
        joins.range_join(l, r, "l.v")


@pytest.mark.parametrize("buckets", [1, 5])
def test_range_join_with_cells_by_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(joins, "ROWS_PER_CELL", 4)
    monkeypatch.setattr(joins, "MOST_COPIES", 100)
    rng = random.Random(buckets)
    left = [(i, rng.choice([None, float("nan"), float("inf"), -0.0, rng.random() * 50, 7.0])) for i in range(400)]
    right = [(i, rng.choice([None, (a := rng.random() * 90 - 20)]), a + rng.choice([-1.0, 0.0, 0.2, 1.0, 30.0])) for i in range(300)]
    l, r = spark.createDataFrame(left, "id int, v double"), spark.createDataFrame(right, "rid int, lo double, hi double")
    met = "v >= lo AND v < hi"
    args = dict(low="r.lo", high="r.hi", high_open=True, buckets=buckets)
    for how in ("left", "left_anti"):
        assert _texts(joins.range_join(l, r, "l.v", how=how, **args)) == _texts(l.join(r, F.expr(met), how))
    assert _texts(joins.range_join(l, r, "l.v", high="r.hi", buckets=buckets)) == _texts(l.join(r, F.expr("v <= hi")))
    assert _texts(joins.range_join(l, r, "l.v", low="r.lo", buckets=buckets)) == _texts(l.join(r, F.expr("v >= lo")))


def _texts(df):
    """Rows as texts, since NaN is not equal to NaN."""
    return list(map(repr, rows(df)))


def _compared(spark, left, right):
    """How many pairs of rows meet in cells."""
    placed, ranges = joins._in_cells(left.alias("l"), right.alias("r"), "l.v", "r.lo", "r.hi", None)
    held = placed.groupBy("_bucket").count().join(ranges.groupBy("_bucket").agg(F.count("*").alias("n")), "_bucket")
    return held.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0


def test_range_join_compares_few_pairs_in_narrow_ranges(spark):
    left = spark.range(40_000).selectExpr("id", "id / 4 AS v")
    right = spark.range(40_000).selectExpr("id", "id / 4 + 0.1D AS lo", "id / 4 + 0.3D AS hi")
    assert _compared(spark, left, right) < 40_000 * 1000


def test_range_join_compares_nothing_with_ranges_beyond_all_values(spark):
    left = spark.range(1000).selectExpr("id", "1000000D + id AS v")
    right = spark.range(30_000).selectExpr("id", "CAST(id AS double) AS lo", "id + 1D AS hi")
    assert _compared(spark, left, right) == 0
    gap = spark.range(1000).selectExpr("id", "if(id < 500, -1D, 1000000D) + id AS v")  # all ranges but few lie between its values
    assert _compared(spark, gap, right) < 1000 * 1500


def test_cut_number_by_bisection(spark):
    cuts = [1.5, 2.0, 2.0, 7.25, 9.0]
    values = [None, -3.0, 1.5, 1.6, 2.0, 7.0, 7.25, 8.0, 9.0, 50.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in range(6):
        held = df.withColumn("c", F.array(*[F.lit(c) for c in cuts[:n]]).cast("array<double>"))
        number = cut_number("c", F.col("v"), 5)
        want = [None if v is None else n if math.isnan(v) else bisect.bisect_right(cuts[:n], v) for v in values]
        assert [x[0] for x in held.select(number).collect()] == want
    assert "filter" not in str(number)  # which looks at every cut
