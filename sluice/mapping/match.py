"""Column matching between source and target tables, over catalog rows.

A catalog has one row per column: source_id, table_name, ordinal_position, column_name,
raw_type, nullable, is_primary_key (and more it may carry). `pairs` names the tables to
compare: source_id, source_table, target_id, target_table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.mapping.types import canonical_type, type_family, type_parameters

PAIR = ["source_id", "source_table", "target_id", "target_table"]
MIN_SCORE = 0.6  # fixed value: a fuzzy match must score above this


def parse_catalog(catalog: DataFrame) -> DataFrame:
    """Add data_type, max_length, precision and scale to catalog rows."""
    return catalog.withColumn("data_type", canonical_type("raw_type")).withColumn(
        "_p", type_parameters("raw_type")).select("*", "_p.*").drop("_p")


def table_schemas(parsed: DataFrame) -> DataFrame:
    """One row per table: its columns in order, primary and foreign keys. A table's column
    list is bounded by the width of its schema."""
    entry = F.struct("ordinal_position", "column_name", "data_type", "nullable", "max_length", "precision", "scale")
    refs = F.col("foreign_key") if "foreign_key" in parsed.columns else F.lit(None).cast("string")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "is_primary_key",
                                                    refs.alias("foreign_key"))))
    return parsed.groupBy("source_id", "table_name").agg(
        F.array_sort(F.collect_list(entry)).alias("columns"), ordered.alias("_k"),
    ).select(
        "source_id", "table_name", "columns",
        F.transform(F.filter("_k", lambda k: k.is_primary_key), lambda k: k.column_name).alias("primary_keys"),
        F.transform(F.filter("_k", lambda k: k.foreign_key.isNotNull()), lambda k: k.column_name).alias("foreign_keys"),
    )


def letters(name: Column) -> Column:
    return F.array_distinct(F.split(F.lower(name), ""))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """1 when equal, 0.8 when one holds the other, else shared letters over all letters;
    case does not matter and an empty name scores 0."""
    a, b = (F.lower(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    return _similarity(a, b, letters(a), letters(b))


def _similarity(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """The same from lower-case names and their distinct letters."""
    shared = F.size(F.array_intersect(a_letters, b_letters))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(b, a) | F.contains(a, b), F.lit(0.8))
        .otherwise(shared / (F.size(a_letters) + F.size(b_letters) - shared))
    )


def column_similarity(s: str = "s", t: str = "t", names: Column | None = None) -> Column:
    """Score of a source and a target column given as struct columns `s` and `t`; `names`
    is their name similarity where it is known."""
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def bonus(condition: Column) -> Column:
        return F.when(condition, F.lit(0.1)).otherwise(F.lit(0.0))

    same_type = col(s, "data_type") == col(t, "data_type")
    s_family, t_family = type_family(col(s, "data_type")), type_family(col(t, "data_type"))
    types = F.when(same_type, F.lit(0.3)).when(s_family == t_family, F.lit(0.2)).otherwise(F.lit(0.0))
    fits = (s_family == "text") & (t_family == "text") & (col(s, "max_length") > 0) & (
        col(t, "max_length") > 0) & (col(t, "max_length") >= col(s, "max_length"))
    if names is None:
        names = name_similarity(col(s, "column_name"), col(t, "column_name"))
    score = (
        names * 0.4
        + types
        + bonus(col(s, "nullable") == col(t, "nullable"))
        + bonus(col(s, "is_primary_key") == col(t, "is_primary_key"))
        + bonus(fits)
    )
    return F.least(score, F.lit(1.0))


def _side(parsed: DataFrame, pairs: DataFrame, side: str, name: str) -> DataFrame:
    """Every column of one side of every pair, as struct column `name`."""
    keep = ["ordinal_position", "column_name", "data_type", "nullable", "is_primary_key", "max_length",
            "precision", "scale"]
    columns = parsed.select(
        F.col("source_id").alias(f"{side}_id"), F.col("table_name").alias(f"{side}_table"),
        F.struct(*keep).alias(name))
    return pairs.select(*PAIR).join(columns, [f"{side}_id", f"{side}_table"])


def candidates(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Column pairs that may match: equal names (in any case), and others that score above
    the minimum, as structs `s` and `t` with `how` and `score`.

    Without a shared type or type family the score cannot pass 0.4 + 0.1 + 0.1, so columns
    meet only on an equal name or within one family: one join on those keys, never on the
    table pair alone.
    """
    def keyed(side: str, name: str) -> DataFrame:
        kind = F.col(f"{name}.data_type")
        keys = F.array(F.concat(F.lit("name "), F.lower(f"{name}.column_name")),
                       F.concat(F.lit("kind "), F.coalesce(type_family(kind), kind)))
        lower = F.lower(f"{name}.column_name")
        return _side(parsed, pairs, side, name).select(
            *PAIR, name, lower.alias(f"_{name}"), letters(lower).alias(f"_{name}_letters"), F.explode(keys).alias("_key"))

    met = keyed("source", "s").join(keyed("target", "t"), [*PAIR, "_key"])
    by_name = F.col("_key").startswith("name ")
    names = _similarity(F.col("_s"), F.col("_t"), F.col("_s_letters"), F.col("_t_letters"))
    scored = met.filter(by_name | (F.col("_s") != F.col("_t"))).withColumn("score", column_similarity(names=names))
    return scored.filter(by_name | (F.col("score") > MIN_SCORE)).select(
        *PAIR, "s", "t", F.when(by_name, "exact").otherwise("similar").alias("how"), "score")


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted: per table pair equal names first, then source columns in order,
    each with its best target first. A row is kept when both its columns are still free."""
    pair, sources, targets = None, set(), set()
    for batch in batches:
        keep = []
        for row in zip(*[batch[c] for c in PAIR], batch["_sp"], batch["_tp"]):
            if row[:4] != pair:
                pair, sources, targets = row[:4], set(), set()
            free = row[4] not in sources and row[5] not in targets
            if free:
                sources.add(row[4])
                targets.add(row[5])
            keep.append(free)
        yield batch[keep]


def match_columns(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """The mapping: one row per matched source column, with both columns as structs
    `s` and `t`, `how` (exact or similar) and `score`.

    What a column may take depends on what earlier ones took, so the candidates of a pair
    are walked in order. Spark sorts them; the walk holds the positions of one pair.
    """
    found = candidates(parse_catalog(catalog), pairs)
    flat = found.select(
        *PAIR, F.to_json("s", {"ignoreNullFields": "false"}).alias("_s"),
        F.to_json("t", {"ignoreNullFields": "false"}).alias("_t"),
        F.col("s.ordinal_position").alias("_sp"), F.col("t.ordinal_position").alias("_tp"), "how", "score")
    ordered = flat.repartition(*PAIR).sortWithinPartitions(*PAIR, "how", "_sp", F.col("score").desc(), "_tp")
    chosen = ordered.mapInPandas(_assign, flat.schema)
    kinds = {f.name: f.dataType for f in found.schema.fields}
    return chosen.select(*PAIR, F.from_json("_s", kinds["s"]).alias("s"), F.from_json("_t", kinds["t"]).alias("t"),
                         "how", "score")


def truncates() -> Column:
    """A bounded text moves into a shorter one."""
    s, t = (lambda n: F.col(f"s.{n}")), (lambda n: F.col(f"t.{n}"))
    return ((s("data_type") == "string") & (t("data_type") == "string") & (t("max_length") > 0)
            & (s("max_length") > t("max_length")))


# The texts of changes and issues.
CONVERT, TRUNCATE = "Convert %s to %s", "Truncate string from %d to %d characters"
HANDLE_NULLS = "Handle NULL values in %s (target doesn't allow NULLs)"
UNMAPPED, REQUIRED = "Unmapped source columns: ", "Required target columns without mapping: "
NO_KEY, LOSSY = "Source primary key columns are not mapped", "Potential data loss in %d transformations"


def changes(mapped: DataFrame) -> DataFrame:
    """The changes each matched column needs: type_conversion, string_truncation, null_handling."""
    s, t = (lambda n: F.col(f"s.{n}")), (lambda n: F.col(f"t.{n}"))

    def change(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("change"), text.alias("description"))

    found = F.array_compact(F.array(
        F.when(s("data_type") != t("data_type"), change(
            "type_conversion", F.format_string(CONVERT, s("data_type"), t("data_type")))),
        F.when(truncates(), change(
            "string_truncation",
            F.format_string(TRUNCATE, s("max_length"), t("max_length")))),
        F.when(s("nullable") & ~t("nullable"), change(
            "null_handling",
            F.format_string(HANDLE_NULLS, s("column_name")))),
    ))
    return mapped.select(
        *PAIR, F.col("s.column_name").alias("source_column"), F.col("t.column_name").alias("target_column"),
        F.explode(found).alias("c")).select("*", "c.*").drop("c")


def compatibility(catalog: DataFrame, pairs: DataFrame, mapped: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """Per pair: mean score over all source columns, where an unmatched one counts 0; with
    `created_at`, the time the mapping was made."""
    every = _side(parse_catalog(catalog), pairs, "source", "s").groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("source_columns"))
    got = mapped.groupBy(*PAIR).agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("mapped_columns"))
    out = every.join(got, PAIR, "left").select(
        *PAIR, "source_columns", F.coalesce("mapped_columns", F.lit(0)).alias("mapped_columns"),
        (F.coalesce("_sum", F.lit(0.0)) / F.col("source_columns")).alias("compatibility_score"))
    return out if created_at is None else out.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))


def issues(catalog: DataFrame, pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per pair, the texts of what is wrong with a mapping (one row per issue). The lists
    hold names of one table's columns, so they are bounded by the width of a schema."""
    parsed = parse_catalog(catalog)

    def columns(side: str, name: str, alias: str) -> DataFrame:
        entry = F.struct(f"{name}.ordinal_position", f"{name}.column_name", f"{name}.nullable", f"{name}.is_primary_key")
        return _side(parsed, pairs, side, name).groupBy(*PAIR).agg(F.array_sort(F.collect_list(entry)).alias(alias))

    conversion = F.col("s.data_type") != F.col("t.data_type")
    used = mapped.groupBy(*PAIR).agg(
        F.collect_set("s.column_name").alias("_s_used"), F.collect_set("t.column_name").alias("_t_used"),
        F.bool_or("s.is_primary_key").alias("_key_mapped"),
        (F.count_if(conversion) + F.count_if(truncates())).alias("_lossy"))
    every = columns("source", "s", "_s").join(columns("target", "t", "_t"), PAIR, "full").join(used, PAIR, "left")
    names = lambda cols: F.array_join(F.transform(cols, lambda c: c.column_name), ", ")
    taken = lambda c, used: F.coalesce(F.array_contains(used, c.column_name), F.lit(False))
    unmapped = F.filter("_s", lambda c: ~taken(c, F.col("_s_used")))
    required = F.filter("_t", lambda c: ~c.nullable & ~taken(c, F.col("_t_used")))
    return every.select(*PAIR, F.explode(F.array_compact(F.array(
        F.when(F.size(unmapped) > 0, F.concat(F.lit(UNMAPPED), names(unmapped))),
        F.when(F.size(required) > 0, F.concat(F.lit(REQUIRED), names(required))),
        F.when(F.exists("_s", lambda c: c.is_primary_key) & ~F.coalesce("_key_mapped", F.lit(False)),
               F.lit(NO_KEY)),
        F.when(F.col("_lossy") > 0, F.format_string(LOSSY, "_lossy")),
    ))).alias("issue"))


def summary(catalog: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: schemas, schemas by source, mappings, mean compatibility, last mapping time
    (when the scores carry `created_at`)."""
    tables = catalog.select("source_id", "table_name").distinct()
    by_source = tables.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    left = by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_schemas"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("schemas_by_source"))
    last = F.max("created_at") if "created_at" in scores.columns else F.lit(None).cast("timestamp")
    right = scores.agg(
        F.count(F.lit(1)).alias("total_mappings"),
        F.coalesce(F.avg("compatibility_score"), F.lit(0.0)).alias("average_compatibility_score"),
        last.alias("last_mapping"))
    return left.crossJoin(right)  # one row each
