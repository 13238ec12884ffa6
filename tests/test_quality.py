import random

import pytest
from pyspark.sql import functions as F

from sluice.quality import report
from sluice.quality.dedup import drop_duplicates
from sluice.quality.profile import profile, quality_summary, suggest_rules, to_rules
from sluice.quality.rules import Rule, RuleBook, assess, split_rows
from tests.conftest import rows


def one(df, rule, refs=None):
    r = assess(df, [rule], refs).first()
    return r.total_records, r.failed_records, r.score, r.passed, r.success_rate


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([(1, "Test 1"), (2, "Test 2"), (3, None)], "id int, name string")


def test_profile_of_three_rows(three):
    got = {r.column_name: r for r in profile(three).collect()}
    i, n = got["id"], got["name"]
    assert (i.total_values, i.null_count, i.unique_count) == (3, 0, 3)
    assert (i.min_value, i.max_value, i.mean_value, i.median_value, i.std_dev) == (1, 3, 2, 2, 1)
    assert (n.null_count, n.unique_count, n.min_value, n.median_value) == (1, 2, None, None)
    s = quality_summary(profile(three)).first()
    assert s.overall_completeness == pytest.approx(5 / 6)
    assert s.quality_issues == ["Column 'name' has low completeness: 66.67%"]
    assert (s.columns_with_issues, s.total_columns) == (1, 2)


def test_profile_edges(spark):
    df = spark.createDataFrame([(0.0, "x" * 100, b"a", [1]), (-0.0, "x" * 100, b"a", [1]), (None, "x" * 63, None, None)],
                               "d double, s string, b binary, l array<int>")
    got = {r.column_name: r for r in profile(df).collect()}
    assert [got[c].unique_count for c in "dsbl"] == [1, 2, 1, 1]
    single = {r.column_name: r for r in profile(df.limit(1)).collect()}
    assert single["d"].std_dev == 0.0
    empty = {r.column_name: r for r in profile(df.filter("false")).collect()}
    assert (empty["d"].total_values, empty["d"].unique_count, empty["d"].std_dev) == (0, 0, None)
    assert quality_summary(profile(df.filter("false"))).first().overall_completeness == 0


def test_empty_data(three):
    empty = three.filter("false")
    assert one(empty, Rule("r", "completeness", "name")) == (0, 0, 0.0, False, 0.0)
    assert one(empty, Rule("r", "completeness", "name", {"threshold": 0.0})) == (0, 0, 0.0, False, 0.0)
    for rule in (Rule("r", "uniqueness", "id"), Rule("r", "uniqueness"), Rule("r", "validity", "name"),
                 Rule("r", "validity"), Rule("r", "range", "id", {"min_value": 1})):
        assert one(empty, rule) == (0, 0, 1.0, True, 0.0)


def test_rules_without_a_column_fail(three):
    assert one(three, Rule("r", "validity", None, {"threshold": 0.0})) == (3, 3, 0.0, False, 0.0)
    assert one(three, Rule("r", "range", "id", {"threshold": 0.0})) == (3, 3, 0.0, False, 0.0)


def test_validity_matches_from_the_start(spark):
    df = spark.createDataFrame([("abc1",), ("1abc",), ("ab\nc",), (None,)], "s string")
    assert one(df, Rule("r", "validity", "s", {"pattern": "abc|ab"}))[:2] == (3, 1)
    assert one(df, Rule("r", "validity", "s", {"pattern": r"\d"}))[:2] == (3, 2)


def test_range_kinds(spark):
    df = spark.createDataFrame([(1, 1.0, "9", True), (5, float("nan"), "x", False), (None, None, None, None)],
                               "i int, d double, s string, b boolean")
    limits = {"min_value": 1, "max_value": 3}
    assert one(df, Rule("r", "range", "i", limits))[:2] == (2, 1)
    assert one(df, Rule("r", "range", "d", limits))[:2] == (2, 0)
    assert one(df, Rule("r", "range", "s", limits))[:3] == (0, 0, 1.0)
    assert one(df, Rule("r", "range", "b", limits))[:2] == (2, 1)


def test_record_uniqueness_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (1, "a")], "a int, b string")
    assert one(df, Rule("r", "uniqueness"))[:2] == (4, 1)
    assert one(df, Rule("r", "uniqueness", "b"))[:2] == (1, 0)


def test_references(spark, three):
    refs = {"ids": spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")}
    rule = Rule("r", "referential_integrity", "id", {"reference_table": "ids", "reference_column": "k"})
    assert one(three, rule, refs)[:2] == (3, 1)
    with pytest.raises(KeyError, match="was not given"):
        assess(three, [rule])


def test_custom_and_consistency(three):
    assert one(three, Rule("r", "custom", parameters={"predicate": "name LIKE 'Test%'"}))[:2] == (3, 1)
    assert one(three, Rule("r", "custom", parameters={"predicate": lambda df: df.id > 1}))[:2] == (3, 1)
    assert one(three, Rule("r", "consistency", parameters={"consistency_rule": "id < 3 AND name <> ''"}))[:2] == (3, 1)


def test_rule_book(three):
    book = RuleBook()
    assert [r.rule_id for r in book.get()] == ["default_completeness", "default_uniqueness"]
    book.add({"rule_id": "mine", "rule_type": "completeness", "column": "name"})
    results = assess(three, book.get())
    assert {r.rule_id: r.passed for r in results.collect()} == {
        "default_completeness": False, "default_uniqueness": True, "mine": False}
    with pytest.raises(KeyError, match="unknown quality rules"):
        book.get(["nope"])
    with pytest.raises(ValueError, match="rule type"):
        Rule("r", "sparkle")


def test_report(three):
    rules = [Rule("name_completeness", "completeness", "name"), Rule("id_uniqueness", "uniqueness", "id"),
             Rule("short", "validity", "name", {"pattern": "x"})]
    r = report.report(assess(three, rules)).first()
    assert (r.total_rules_executed, r.passed_rules, r.failed_rules) == (3, 1, 2)
    assert r.recommendations == ["Address quality issues for short (current: 0.00%)",
                                 "Improve data completeness for name_completeness (current: 66.67%)"]
    good = assess(three, rules[1:2])
    assert report.report(good).first().recommendations == ["Data quality looks good! Continue monitoring."]
    assert report.validate(good).first().data_passed


def test_suggestions_hold(three, spark):
    df = spark.createDataFrame([("a@b.com", 1.5), ("c@d.org", 2.0)], "mail string, v double")
    rules = to_rules(suggest_rules(df))
    assert {r.rule_id for r in rules} == {"mail_completeness", "mail_uniqueness", "mail_validity", "v_completeness",
                                          "v_uniqueness", "v_range"}
    assert all(r.passed for r in assess(df, rules).collect())


def test_split_rows(three):
    good, bad = split_rows(three, [Rule("n", "completeness", "name"), Rule("i", "range", "id", {"max_value": 1})])
    assert rows(good) == [(1, "Test 1")]
    assert rows(bad) == [(2, "Test 2", ["i"]), (3, None, ["n", "i"])]


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "z", 1), (None, "q", 9), (None, "r", 9)], "k int, v string, o int")
    assert rows(drop_duplicates(df, ["k"], ["o"])) == [(1, "z", 1), (None, "q", 9)]
    assert drop_duplicates(df.select("k"), ["k"]).count() == 2


@pytest.mark.parametrize("order", [["o"], ["o", "z"], ["z"], ["s"], []])
def test_drop_duplicates_by_brute_force(spark, order):
    rng = random.Random(2)
    names = ["a", "b.c", "o", "z", "s"]
    data = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", "long " * 40, None]), rng.choice([None, 5, 6, 7]), rng.randrange(3),
             rng.choice(["p", None, "q"])) for _ in range(400)]
    data += [(9, "hot", 1 << 62, i % 50, None) for i in range(3000)] + [(8, "same", -(1 << 62), 2, "r")] * 2000
    df = spark.createDataFrame(data, "a int, `b.c` string, o bigint, z int, s string").repartition(7)
    by = [names.index(c) for c in [*order, *(c for c in names if c not in order and c not in ("a", "b.c"))]]
    best = {}
    for row in data:
        place = [(row[i] is not None, row[i]) for i in by]
        if row[:2] not in best or place < best[row[:2]][0]:
            best[row[:2]] = (place, row)
    assert rows(drop_duplicates(df, ["a", "b.c"], order)) == sorted((r for _, r in best.values()), key=repr)


def test_drop_duplicates_sorts_only_ties(spark):
    df = spark.createDataFrame([(i % 5, f"a{i}", i) for i in range(40)], "k int, v string, o bigint")
    plan = drop_duplicates(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    first, second = plan[plan.index("Union"):].split("\n   +- ", 1)
    assert "Sort" not in first and second.count("SortAggregate") == 2  # a partial and a final one in the branch of ties


def test_merged_states_are_the_profile_of_all_rows(spark, tmp_path):
    from sluice.quality.states import day_states, merged, read_states, save_states

    df = spark.range(9000).select(
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"),
        F.when(F.col("id") % 9 != 0, F.lit(1e9) + F.sin(F.col("id"))).alias("x"), (F.col("id") % 700).alias("n"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("w"), F.col("id") % 900)).alias("w"), F.lit(None).cast("int").alias("none"))
    late = F.col("ts").isNull() | (F.to_date("ts") >= "2023-11-17")
    path = str(tmp_path / "states")
    for rows_of in (df.where(~late), df.where(late), df.where(late)):  # days given again count once
        save_states(day_states(rows_of, "ts"), path)
    got = {r.column_name: r for r in merged(read_states(spark, path)).collect()}
    want = {r.column_name: r for r in profile(df).collect()}
    assert got.keys() == want.keys()
    for name, w in want.items():
        g = got[name]
        assert [g.data_type, g.total_values, g.null_count, g.min_value, g.max_value] == [
            w.data_type, w.total_values, w.null_count, w.min_value, w.max_value]
        assert abs(g.unique_estimate - w.unique_count) <= 0.05 * w.unique_count
    for name in ("x", "n"):
        assert got[name].mean_value == pytest.approx(want[name].mean_value, rel=1e-12)
        assert got[name].std_dev == pytest.approx(want[name].std_dev, rel=1e-6)
    assert abs(got["n"].median_estimate - want["n"].median_value) < 0.03 * 700
    assert got["none"].std_dev is None and got["none"].median_estimate is None and got["w"].mean_value is None
    assert day_states(df.limit(0), "ts").count() == 0 and merged(day_states(df.limit(0), "ts")).count() == 0
