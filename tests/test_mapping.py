import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.mapping import match
from sluice.mapping.apply import apply_mapping, from_match
from sluice.mapping.types import canonical_type, raw_type_name, spark_type, type_parameters
from tests.conftest import rows

CATALOG = ("source_id string, table_name string, ordinal_position int, column_name string, raw_type string, "
           "nullable boolean, is_primary_key boolean, foreign_key string")
PAIRS = "source_id string, source_table string, target_id string, target_table string"


@pytest.mark.parametrize(("raw", "kind", "params"), [
    ("VARCHAR(50)", "string", (50, None, None)), ("DECIMAL(10,2)", "decimal", (None, 10, 2)),
    ("INT(11)", "integer", (11, None, None)), ("character varying", "unknown", (None, None, None)),
    ("", "unknown", (None, None, None)), (" Number(38 , 0) ", "decimal", (None, 38, 0)),
    ("double", "float", (None, None, None)), ("VARCHAR(max)", "string", (None, None, None)),
    ("decimal(1,2,3)", "decimal", (None, None, None)), ("bytea", "binary", (None, None, None))])
def test_types(spark, raw, kind, params):
    row = spark.createDataFrame([(raw,)], "t string").select(canonical_type("t"), type_parameters("t")).first()
    assert (row[0], tuple(row[1])) == (kind, params)


def test_type_names():
    assert spark_type("decimal", 10, 2) == "decimal(10,2)" and spark_type("integer") == "int"
    assert raw_type_name("array<float>") == "array" and raw_type_name("bigint") == "bigint"


@pytest.mark.parametrize(("a", "b", "want"), [
    ("Name", "name", 1.0), ("name", "full_name", 0.8), ("abc", "abd", 0.5), ("", "a", 0.0), ("xy", "ab", 0.0)])
def test_name_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(match.name_similarity("a", "b")).first()[0]
    assert got == want


@pytest.fixture(scope="module")
def shop(spark):
    catalog = spark.createDataFrame([
        ("crm", "customers", 0, "customer_id", "INTEGER", False, True, None),
        ("crm", "customers", 1, "first_name", "VARCHAR(50)", False, False, None),
        ("crm", "customers", 2, "Email", "VARCHAR(100)", True, False, None),
        ("crm", "customers", 3, "born", "date", True, False, None),
        ("crm", "customers", 4, "photo", "blob", True, False, "media.id"),
        ("dw", "people", 0, "EMAIL", "VARCHAR(80)", False, False, None),
        ("dw", "people", 1, "firstname", "text", False, False, None),
        ("dw", "people", 2, "cust_id", "BIGINT", False, True, None),
        ("dw", "people", 3, "country", "char(2)", False, False, None),
    ], CATALOG)
    pairs = spark.createDataFrame([("crm", "customers", "dw", "people")], PAIRS)
    return catalog, pairs, match.match_columns(catalog, pairs)


def test_match(shop):
    _, _, mapped = shop
    got = {(r.s.column_name, r.t.column_name): (r.how, round(r.score, 6)) for r in mapped.collect()}
    # letters of customer_id: c u s t o m e r _ i d (11), of cust_id: c u s t _ i d (7): 7 of 11
    assert got == {
        ("Email", "EMAIL"): ("exact", 0.8),  # 0.4 + 0.3 + 0.1 (key flag)
        ("customer_id", "cust_id"): ("similar", round(0.4 * 7 / 11 + 0.2 + 0.1 + 0.1, 6)),
        ("first_name", "firstname"): ("similar", round(0.4 * 9 / 10 + 0.2 + 0.1 + 0.1, 6)),
    }


def test_changes_and_issues(shop):
    catalog, pairs, mapped = shop
    changes = {(r.source_column, r.change) for r in match.changes(mapped).collect()}
    assert changes == {("customer_id", "type_conversion"), ("first_name", "type_conversion"),
                       ("Email", "string_truncation"), ("Email", "null_handling")}
    found = {r.issue for r in match.issues(catalog, pairs, mapped).collect()}
    assert found == {"Unmapped source columns: born, photo", "Required target columns without mapping: country",
                     "Potential data loss in 3 transformations"}
    score = match.compatibility(catalog, pairs, mapped).first()
    assert (score.source_columns, score.mapped_columns) == (5, 3)
    assert score.compatibility_score == pytest.approx(sum(r.score for r in mapped.collect()) / 5)


def test_summary_and_schemas(shop):
    catalog, pairs, mapped = shop
    scores = match.compatibility(catalog, pairs, mapped).withColumn("created_at", F.lit(datetime(2024, 5, 1)))
    s = match.summary(catalog, scores).first()
    assert (s.total_schemas, s.schemas_by_source, s.total_mappings) == (2, {"crm": 1, "dw": 1}, 1)
    assert s.last_mapping == datetime(2024, 5, 1)
    schemas = {r.table_name: r for r in match.table_schemas(match.parse_catalog(catalog)).collect()}
    assert schemas["customers"].primary_keys == ["customer_id"] and schemas["customers"].foreign_keys == ["photo"]
    assert [c.column_name for c in schemas["people"].columns] == ["EMAIL", "firstname", "cust_id", "country"]


def test_from_match_applies(shop, spark):
    _, _, mapped = shop
    data = spark.createDataFrame([(1, "Ann", "x" * 90)], "customer_id int, first_name string, Email string")
    out = apply_mapping(data, from_match(mapped, {"EMAIL": "none"}))
    assert out.dtypes == [("EMAIL", "string"), ("firstname", "string"), ("cust_id", "bigint")]
    assert rows(out) == [("x" * 80, "Ann", 1)]


def _similar(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    return 0.8 if a in b or b in a else len(set(a) & set(b)) / len(set(a) | set(b))


_KINDS = {"int": ("integer", "n"), "bigint": ("bigint", "n"), "varchar(9)": ("string", "t"), "text": ("text", "t"),
          "varchar(5)": ("string", "t"), "date": ("date", "d"), "bool": ("boolean", None), "odd": ("unknown", None)}


def _score(s, t):
    total = _similar(s[1], t[1]) * 0.4
    (a, fa), (b, fb) = _KINDS[s[2]], _KINDS[t[2]]
    total += 0.3 if a == b else 0.2 if fa is not None and fa == fb else 0.0
    total += 0.1 if s[3] == t[3] else 0.0
    total += 0.1 if s[4] == t[4] else 0.0
    length = {"varchar(9)": 9, "varchar(5)": 5}
    if fa == fb == "t" and s[2] in length and t[2] in length and length[t[2]] >= length[s[2]]:
        total += 0.1
    return min(total, 1.0)


def test_matching_by_brute_force(spark):
    """Random schemas, matched by trying everything in order."""
    rng = random.Random(5)
    catalog, pairs, want = [], [], set()
    for p in range(25):
        side = {}
        for sid in ("a", "b"):
            names = rng.sample([x + y for x in ("id", "na", "Da", "em", "to") for y in ("", "me", "te", "ID", "_x")], 9)
            names = list({n.lower(): n for n in names}.values())
            side[sid] = [(i, n, rng.choice(list(_KINDS)), rng.random() < 0.5, i == 0) for i, n in enumerate(names)]
            catalog += [(sid, f"t{p}", i, n, k, null, pk, None) for i, n, k, null, pk in side[sid]]
        pairs.append(("a", f"t{p}", "b", f"t{p}"))
        mapping = {}
        for s in side["a"]:
            for t in side["b"]:
                if s[1].lower() == t[1].lower():
                    mapping[s[1]] = t[1]
        free = [t for t in side["b"] if t[1] not in mapping.values()]
        for s in [s for s in side["a"] if s[1] not in mapping]:
            best = None
            for t in free:
                if _score(s, t) > (best[0] if best else 0.6):
                    best = (_score(s, t), t)
            if best:
                mapping[s[1]] = best[1][1]
                free.remove(best[1])
        want |= {(f"t{p}", s, t) for s, t in mapping.items()}
    got = match.match_columns(spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(pairs, PAIRS))
    assert {(r.source_table, r.s.column_name, r.t.column_name) for r in got.collect()} == want
