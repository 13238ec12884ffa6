"""Raw database type names to canonical types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw type names and the canonical type of each.
CANONICAL_TYPES = {
    "int": "integer", "integer": "integer", "smallint": "integer", "serial": "integer",
    "bigint": "bigint", "bigserial": "bigint",
    "decimal": "decimal", "numeric": "decimal", "money": "decimal", "number": "decimal",
    "float": "float", "double": "float", "real": "float",
    "boolean": "boolean", "bool": "boolean",
    "varchar": "string", "char": "string",
    "text": "text",
    "date": "date",
    "datetime": "datetime",
    "timestamp": "timestamp",
    "json": "json", "variant": "json", "array": "json", "object": "json",
    "blob": "binary", "bytea": "binary",
}

# Types that convert into each other share a family.
TYPE_FAMILIES = {
    "integer": "numeric", "bigint": "numeric", "decimal": "numeric", "float": "numeric",
    "string": "text", "text": "text",
    "date": "datetime", "datetime": "datetime", "timestamp": "datetime",
}

# The Spark type behind each canonical type; decimals take their parsed precision.
SPARK_TYPES = {
    "integer": "int", "bigint": "bigint", "decimal": "decimal(38,18)", "float": "double",
    "boolean": "boolean", "string": "string", "text": "string", "date": "date",
    "datetime": "timestamp_ntz", "timestamp": "timestamp", "json": "string", "binary": "binary",
    "unknown": "string",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table as one constant map."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items())))[key]


def canonical_type(raw: Column | str) -> Column:
    """The type name before any parenthesis, looked up; `unknown` when it is not listed."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    name = F.substring_index(F.trim(F.lower(raw)), "(", 1)
    return F.coalesce(_lookup(CANONICAL_TYPES, name), F.lit("unknown"))


def type_family(canonical: Column | str) -> Column:
    """`numeric`, `text` or `datetime`; null for the other types."""
    return _lookup(TYPE_FAMILIES, F.col(canonical) if isinstance(canonical, str) else canonical)


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))


def type_parameters(raw: Column | str) -> Column:
    """struct(max_length, precision, scale): one number is a length, two are precision and scale."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inside = F.substring_index(F.regexp_extract(raw, r"^[^(]*\(([^(]*)", 1), ")", 1)
    whole = raw.contains("(") & raw.contains(")")
    parts = F.split(inside, ",")
    pair = whole & (F.size(parts) == 2)
    precision, scale = _number(F.get(parts, F.lit(0))), _number(F.get(parts, F.lit(1)))
    return F.struct(
        F.when(whole & (F.size(parts) == 1), _number(inside)).alias("max_length"),
        F.when(pair, precision).alias("precision"),
        F.when(pair, scale).alias("scale"),
    )


def spark_type(canonical: str, precision: int | None = None, scale: int | None = None) -> str:
    if canonical == "decimal" and precision is not None:
        return f"decimal({precision},{scale or 0})"
    return SPARK_TYPES[canonical]


def raw_type_name(spark_type_name: str) -> str:
    """The raw type name of a Spark column, for catalogs made from DataFrames."""
    return {
        "string": "text", "int": "integer", "tinyint": "smallint", "timestamp_ntz": "datetime",
    }.get(spark_type_name, "array" if spark_type_name.startswith("array") else spark_type_name)
