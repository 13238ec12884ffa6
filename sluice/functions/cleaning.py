"""Column builders for cleaning text, dates and contact data, and the named templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime codes and the Spark datetime pattern letters they stand for.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE",
    "%A": "EEEE", "%i": "mm", "%s": "ss", "%%": "%",
}

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_null(c: str | Column, default: object) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def trim(c: str | Column) -> Column:
    return F.trim(_col(c))


def upper(c: str | Column) -> Column:
    return F.upper(_col(c))


def spark_pattern(fmt: str) -> str:
    """A Spark datetime pattern; `%`-codes are translated, other text is quoted."""
    if "%" not in fmt:
        return fmt
    out, i = "", 0
    while i < len(fmt):
        code = fmt[i:i + 2]
        if code in STRFTIME_TO_SPARK:
            out += STRFTIME_TO_SPARK[code]
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported date code {code!r}")
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def format_date(c: str | Column, fmt: str) -> Column:
    return F.date_format(_col(c), spark_pattern(fmt))


def format_number(c: str | Column, digits: int) -> Column:
    return F.format_number(_col(c), digits)


def format_text(c: str | Column, fmt: str) -> Column:
    return F.format_string(fmt, _col(c))


def truncate(c: str | Column, length: int) -> Column:
    return F.substring(_col(c), 1, length)


def is_truncated(c: str | Column, length: int) -> Column:
    return F.coalesce(F.length(_col(c)) > length, F.lit(False))


def clean_phone(c: str | Column, country_code: str = "1") -> Column:
    """Digits with a leading `+`. Ten bare digits get the country code; a number outside
    8 to 15 digits is null."""
    kept = F.regexp_replace(_col(c), r"[^0-9+]", "")
    digits = F.regexp_replace(kept, r"\+", "")
    return (
        F.when(~F.length(digits).between(8, 15), F.lit(None).cast("string"))
        .when(kept.startswith("+"), F.concat(F.lit("+"), digits))
        .when(F.length(digits) == 10, F.concat(F.lit("+" + country_code), digits))
        .otherwise(F.concat(F.lit("+"), digits))
    )


def clean_email(c: str | Column) -> Column:
    return F.lower(F.trim(_col(c)))


def is_email(c: str | Column) -> Column:
    return clean_email(c).rlike(r"\A" + EMAIL)


def normalize_text(c: str | Column) -> Column:
    """Single spaces, no outer spaces, each word capitalised."""
    return F.initcap(F.trim(F.regexp_replace(_col(c), r"\s+", " ")))


# Names are the ones a caller passes, so they are fixed values.
CLEANING: dict[str, Callable[..., Column]] = {
    "null_handling": lambda column, default_value: fill_null(column, default_value),
    "trim_whitespace": lambda column: trim(column),
    "case_standardization": lambda column: upper(column),
    "date_formatting": lambda column, format: format_date(column, format),
    "string_truncation": lambda column, length: truncate(column, length),
    "phone_cleanup": lambda column, country_code="1": clean_phone(column, country_code),
    "email_cleanup": lambda column: clean_email(column),
    "normalize": lambda column: normalize_text(column),
}


def template(name: str, category: str = "data_cleaning", **params: object) -> Column:
    """A column expression by template category and name; values are bound, never spliced."""
    from sluice.operators.aggregates import aggregate_column
    from sluice.operators.windows import window_column

    if category == "data_cleaning":
        if name not in CLEANING:
            raise ValueError(f"unknown template {name!r} in category {category!r}")
        return CLEANING[name](**params)
    if category == "aggregations":
        return aggregate_column(name, params["column"])
    if category == "window_functions":
        return window_column(name, **params)
    raise ValueError(f"unknown template category {category!r}")
