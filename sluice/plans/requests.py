"""Tagging a log of plain-language requests with operations, names, conditions and complexity.

Written plainly, a pattern such as "verb, anything, from, anything" is tried anew at every verb of a line, up to the end of
the line, and "a name, then table" at every character of a long name: the time grows with the square of a text. So a
request is matched by patterns that find the same and start only once for each line, verb at a line's end, or name. They
rest on two facts: the first verb of a line reaches every word that a later one reaches, and runs of white space matter
only by three kinds, which are made equally short beforehand. The time is linear in the length of a text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request of each kind looks like.
OPERATION_PATTERNS = {
    "extract": [
        r"(extract|get|fetch|pull|retrieve)\s+(.+?)\s+from\s+(.+)",
        r"move\s+(.+?)\s+from\s+(.+?)\s+to\s+(.+)",
        r"copy\s+(.+?)\s+from\s+(.+?)\s+to\s+(.+)",
    ],
    "transform": [
        r"(clean|cleanse|normalize|format)\s+(.+)",
        r"(aggregate|group|sum|count|average)\s+(.+)",
        r"(join|merge|combine)\s+(.+?)\s+with\s+(.+)",
    ],
    "load": [
        r"(load|insert|save|write|store)\s+(.+?)\s+(to|into)\s+(.+)",
        r"create\s+(table|view|summary)\s+(.+)",
    ],
    "schedule": [
        r"(daily|weekly|monthly|hourly)\s+(.+)",
        r"every\s+(\d+)\s+(minutes?|hours?|days?)\s+(.+)",
        r"at\s+(\d{1,2}):(\d{2})\s+(.+)",
    ],
    "filter": [
        r"(where|filter|only|with)\s+(.+)",
        r"last\s+(\d+)\s+(days?|weeks?|months?)\s+(.+)",
    ],
}
# Where names and times stand in a request, and words that are not names.
SOURCE_PATTERNS = [
    r"(?:from|to|into|table|view)\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s+(?:table|view)",
]
COLUMN_PATTERNS = [
    r"(?:clean|format|normalize)\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s+(?:column|field)",
]
CONDITION_PATTERNS = [
    r"last\s+(\d+)\s+(days?|weeks?|months?)",
    r"(\d+)\s+(days?|weeks?|months?)\s+ago",
]
TIME_WORDS = ["last", "next", "previous", "recent", "current", "past", "future", "today", "yesterday", "tomorrow"]

# Every character that counts as white space in a request.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006" \
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE_SPACE = WHITE_SPACE.replace("\n", "").replace(" ", "")
_UNIX_LINES = "(?d)"  # only \n ends a line, so `.` matches all else


# Words a text must hold for a pattern to match, one of each list. A substring test is far
# cheaper than a pattern, and most long texts fail it.
_VERBS = {
    "extract": ["extract", "get", "fetch", "pull", "retrieve"],
    "clean": ["clean", "normalize", "format"],
    "aggregate": ["aggregate", "group", "sum", "count", "average"],
    "join": ["join", "merge", "combine"],
    "load": ["load", "insert", "save", "write", "store"],
}
_DAYS = ["day", "week", "month"]
_TABLES = ["table", "view"]
_NEEDED = {
    "extract": [[_VERBS["extract"], ["from"]], [["move"], ["from"], ["to"]], [["copy"], ["from"], ["to"]]],
    "transform": [[_VERBS["clean"]], [_VERBS["aggregate"]], [_VERBS["join"], ["with"]]],
    "load": [[_VERBS["load"], ["to"]], [["create"], [*_TABLES, "summary"]]],
    "schedule": [[["daily", "weekly", "monthly", "hourly"]], [["every"], ["minute", "hour", "day"]], [["at"], [":"]]],
    "filter": [[["where", "filter", "only", "with"]], [["last"], _DAYS]],
    "source": [[["from", "to", *_TABLES]], [_TABLES]],
    "column": [[_VERBS["clean"]], [["column", "field"]]],
    "condition": [[["last"], _DAYS], [["ago"], _DAYS]],
}


def _short_spaces(text: Column) -> Column:
    """A text whose runs of white space are at most three characters long, and which the patterns below match alike.

    What counts is whether a run holds a line end, and whether a character that is none stands inside it.
    """
    for run, short in ((r"(?<!\s)(?= *+\n)\s+? \s\s*+", "\n \n"), (r"   ++", "   "), (r"\n\n++", "\n")):
        text = F.regexp_replace(text, F.lit(run), F.lit(short))
    return text


def _linked(first: str, word: str) -> list[str]:
    """`first`, something within one line, and `word`, with white space between and after them.

    From the first `first` of a line; from one at the end of a line into the next; or with only white space between.
    """
    return [rf"^(?>.*?(?:{first})(?=\s)) .+\s+(?:{word})\s", rf"(?:{first})(?= ?\n)\s++.+\s+(?:{word})\s",
            rf"(?:{first})\s \s(?:{word})\s"]


def _twice_linked(first: str, word: str, last: str) -> list[str]:
    """`first`, something, `word`, something, and `last`. Of the places for `word`, the earliest in its line reaches
    whatever others in the line reach; one at the end of a line, or at the start of the next, reaches further."""
    rest = rf"(?: .+\s+| ?\n\s*+.+\s+|\s \s){last}\s"
    middle = rf"(?:(?>.+?\s+{word}(?=\s))|.+\s+{word}(?= ?\n)|.++\s++{word}(?=\s)){rest}"
    return [rf"^(?>.*?{first}(?=\s)) {middle}", rf"{first}(?= ?\n)\s++{middle}", rf"{first}\s \s{word}{rest}"]


def _verbs(kind: str) -> str:
    return "|".join(_VERBS[kind])


# By kind and place in OPERATION_PATTERNS: what finds the same in linear time, in a text with short spaces.
_LINEAR = {
    ("extract", 0): _linked(_verbs("extract"), "from"),
    ("extract", 1): _twice_linked("move", "from", "to"),
    ("extract", 2): _twice_linked("copy", "from", "to"),
    ("transform", 2): _linked(_verbs("join"), "with"),
    ("load", 0): _linked(_verbs("load"), "to|into"),
}
# The same for patterns that begin with a name or a number. A match begins where the run of its characters does, or where
# the match before it has ended.
_NAME = r"(?:\G|(?<![a-zA-Z0-9_]))[0-9]*+([a-zA-Z_][a-zA-Z0-9_]*+)"
_NUMBER = r"(?:\G|(?<!\d))(\d++)"


def _from_the_start(pattern: str) -> str:
    return pattern.replace("([a-zA-Z_][a-zA-Z0-9_]*)", _NAME) if pattern.startswith("([a-zA-Z_]") else \
        _NUMBER + pattern.removeprefix(r"(\d+)") if pattern.startswith(r"(\d+)") else pattern


def _possible(text: Column, needed: list[list[str]]) -> Column:
    return reduce(and_, [reduce(or_, [F.contains(text, F.lit(w)) for w in words]) for words in needed])


def _matches(kind: str, place: int, pattern: str) -> Column:
    linear = _LINEAR.get((kind, place))
    found = (F.col("_text").rlike(_UNIX_LINES + pattern) if linear is None else
             reduce(or_, [F.col("_short").rlike("(?dm)" + p) for p in linear]))
    return _possible(F.col("_text"), _NEEDED[kind][place]) & found


def _all(text: Column, pattern: str, group: int, needed: list[list[str]]) -> Column:
    found = F.regexp_extract_all(text, F.lit(_UNIX_LINES + _from_the_start(pattern)), F.lit(group))
    return F.when(_possible(text, needed), found).otherwise(F.array().cast("array<string>"))


def tag_requests(df: DataFrame, column: str) -> DataFrame:
    """Add request (lower case, trimmed), operations (one kind per matching pattern), sources,
    columns, conditions and complexity. Everything is row-wise, in time linear in the texts; no shuffle."""
    request = F.col("request")
    plain = F.translate(request, _RARE_SPACE, " " * len(_RARE_SPACE))
    text = F.col("_text")
    operations = F.array_compact(F.array(*[
        F.when(_matches(kind, place, p), F.lit(kind))
        for kind, patterns in OPERATION_PATTERNS.items() for place, p in enumerate(patterns)
    ]))
    sources = F.filter(
        F.concat(*[_all(text, p, 1, n) for p, n in zip(SOURCE_PATTERNS, _NEEDED["source"])]),
        lambda w: ~w.isin(TIME_WORDS) & (F.length(w) > 2))
    columns = F.concat(*[_all(text, p, 1, n) for p, n in zip(COLUMN_PATTERNS, _NEEDED["column"])])
    conditions = F.concat(*[
        F.zip_with(_all(text, p, 1, needed), _all(text, p, 2, needed), lambda n, unit: F.concat_ws(" ", n, unit))
        for p, needed in zip(CONDITION_PATTERNS, _NEEDED["condition"])
    ])
    tagged = df.withColumn("request", F.btrim(F.lower(F.col(column)), F.lit(WHITE_SPACE))).withColumn("_text", plain)
    tagged = tagged.withColumn("_short", F.when(text.rlike(r"\s\s"), _short_spaces(text)).otherwise(text))
    tagged = tagged.withColumns(
        {"operations": operations, "sources": sources, "columns": columns, "conditions": conditions})
    return tagged.drop("_text", "_short").withColumn("complexity", complexity())


def complexity() -> Column:
    n = F.size("operations")
    distinct_sources = F.size(F.array_distinct("sources"))
    transforms = F.size(F.filter("operations", lambda kind: kind == "transform"))
    return (
        F.when((n <= 1) & (distinct_sources <= 1), "simple")
        .when((n <= 3) & (distinct_sources <= 2) & (transforms <= 1), "medium")
        .otherwise("complex")
    )


def count_by_kind(tagged: DataFrame) -> DataFrame:
    """Requests per complexity and kind of operation; a kind counts once per request."""
    return tagged.select("complexity", F.explode(F.array_distinct("operations")).alias("kind")).groupBy(
        "complexity", "kind").agg(F.count(F.lit(1)).alias("requests"))


def count_by_complexity(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("complexity").agg(F.count(F.lit(1)).alias("requests"))
