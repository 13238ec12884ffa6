"""Secret scans: long words with digits, and values given to the name of a credential, are candidates; a random forest
removes the false ones.

The forest looks at the candidate's length and characters, its character transitions under a model of the corpus's words,
its dictionary coverage, the path it was found under, and the words before it. Everything runs as column expressions inside
the row: a document is never exploded or shuffled to be scanned, and the fitted trees become one expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import cut, hash_sample, whole_row

DICTIONARY_SHARE = 1 / 20_000  # least share of a dictionary word in all words, so there are at most 20,000
TRAIN_ROWS = 20_000      # labelled findings the forest is fitted on, half of each label at most, picked by hash
TREES = 24
DEPTH = 5
MIN_LENGTH = 16
MIN_NAMED = 6            # of a value given to the name of a credential

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[ \t\n\x0B\f\r]+"
_AROUND = "\"'`.,;:!?()[]{}<>"
_KEY = r"[A-Za-z0-9+/=_.:@~\-]"

# Words that announce a credential, words that announce an example, and a provider's key format.
_CREDENTIAL = "pass(word|wd|phrase)?|pwd|token|secret|api_?key|access_?key|auth|bearer|credentials?|private_?key"
_EXAMPLE = "example|sample|dummy|test|fake|placeholder"
_PROVIDER = "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$"

FEATURES = ["length", "digit_share", "upper_share", "lower_share", "other_share", "class_changes", "distinct_share",
            "transitions", "coverage", "path_marks", "example_path", "credential_before", "example_before"]


@dataclass(frozen=True)
class Words:
    """Frequent words, and log probabilities of one letter after another in all words (27 x 27, the first for no letter)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


def corpus_words(df: DataFrame, text: str) -> Words:
    """The dictionary and the transition model, from all words of two letters or more (a to z) of all rows.

    Counts are combined before the shuffle and written; what reaches the driver is the words that make up at least
    DICTIONARY_SHARE of all, and 27 x 27 sums of pairs of letters. Without words the dictionary is empty and all
    transitions are alike.
    """
    word = F.explode(F.split(F.translate(F.col(text), _UPPER, _LOWER), _SPACE)).alias("word")
    counts = cut(df.select(word).where(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").count(), "words")
    least = (counts.agg(F.sum("count")).first()[0] or 0) * DICTIONARY_SHARE
    frequent = counts.where(F.col("count") >= least).collect()
    frequent.sort(key=lambda r: (-r["count"], r.word))
    spots = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(_LOWER), c))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), spots), F.concat(spots, F.array(F.lit(0))), lambda a, b: a * 27 + b)
    pairs = {r.pair: r.n for r in counts.select(F.explode(steps).alias("pair"), "count").groupBy("pair").agg(
        F.sum("count").alias("n")).collect()}
    after = [sum(pairs.get(a * 27 + b, 0) for b in range(27)) for a in range(27)]
    table = (math.log((pairs.get(a * 27 + b, 0) + 1) / (after[a] + 27)) for a in range(27) for b in range(27))
    return Words(tuple(r.word for r in frequent), tuple(round(x, 6) for x in table))


def _listed(values: tuple, kind: str = "string") -> Column:
    """A constant array from one literal."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def _bind(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once: a lambda's argument is a value, an expression in it is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidates(text: Column) -> Column:
    """An array of (word, name, before, value): number of the word, the name that the word begins with where it assigns one,
    the two words before, and the value.

    Runs of at least MIN_LENGTH characters of keys, numbers and addresses, with a digit, without name and final stops. And
    whatever is given to the name of a credential, in the same word or the next one (also `bearer` and a word), the name
    quoted or not: MIN_NAMED characters of any kind, but no plain word.
    """
    return _bind(F.split(text, _SPACE), lambda words: F.concat(_candidates(words), _named(words)))


_NAME = rf"[A-Za-z0-9_\-]{{0,40}}?(?:{_CREDENTIAL.replace('(', '(?:')})(?:[0-9_\-][A-Za-z0-9_\-]{{0,20}})?"
_GIVEN = rf"(?i)^[\"'`(\[{{,]*({_NAME})[\"'`]?[=:]+[\"'`]?"
_GIVES_NEXT = rf"(?i)^[\"'`(\[{{,]*(?:{_NAME}[\"'`]?[=:]+|(?:authorization[=:]+)?bearer)$"


def _named(words: Column) -> Column:
    """Candidates by context. What a run of key characters already covers is left out."""
    numbers = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
    word = lambda i: F.get(words, i)
    after = lambda i: F.coalesce(word(i - 1).rlike(_GIVES_NEXT), F.lit(False))
    spots = F.filter(numbers, lambda i: (F.length(word(i)) >= MIN_NAMED) & (word(i).rlike(_GIVEN) | after(i)))
    found = F.transform(spots, lambda i: F.struct(
        i.alias("word"), F.regexp_extract(word(i), _GIVEN, 1).alias("name"), F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before"),
        F.btrim(F.regexp_replace(word(i), _GIVEN, ""), F.lit(_AROUND.replace("!", "").replace("?", ""))).alias("value")))
    plain = rf"^[A-Za-z]?[a-z]*$|^[A-Z]+$|^\[SECRET|^{_KEY}{{{MIN_LENGTH},}}$"
    return F.filter(found, lambda x: (F.length(x.value) >= MIN_NAMED) & ~x.value.rlike(plain))


def _candidates(words: Column) -> Column:
    numbers = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
    word = lambda i: F.get(words, i)
    long = F.filter(numbers, lambda i: (F.length(word(i)) >= MIN_LENGTH) & word(i).rlike("[0-9]"))
    bare = F.transform(long, lambda i: F.struct(i.alias("word"), F.ltrim(word(i), F.lit(_AROUND)).alias("bare"),
                                                F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before")))
    named = F.transform(bare, lambda x: F.struct(
        x.word.alias("word"), x.bare.alias("bare"), x.before.alias("before"),
        F.regexp_extract(x.bare, r"^([A-Za-z_][A-Za-z0-9_\-]{0,39})[=:]", 1).alias("name")))
    found = F.flatten(F.transform(named, lambda x: F.transform(
        F.regexp_extract_all(F.substring(x.bare, F.when(x["name"] == "", 1).otherwise(F.length(x["name"]) + 2), F.length(x.bare)),
                             F.lit("(%s{%d,})" % (_KEY, MIN_LENGTH))),
        lambda v: F.struct(x.word.alias("word"), x["name"].alias("name"), x.before.alias("before"),
                           F.btrim(v, F.lit(".:")).alias("value")))))
    return F.filter(found, lambda x: (F.length(x.value) >= MIN_LENGTH) & x.value.rlike("[0-9]"))


def _features(x: Column, path: Column, known: Words) -> Column:
    """FEATURES of one candidate, as an array."""
    value, size = x.value, F.length(x.value).cast("double")
    lower = F.translate(value, _UPPER, _LOWER)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    table = _listed(known.transitions, "double")
    steps = _bind(F.transform(F.split(lower, ""), lambda c: F.instr(F.lit(_LOWER), c)), lambda spots: F.zip_with(
        spots, F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0))),
        lambda a, b: F.get(table, a * 27 + F.coalesce(b, F.lit(0)))))
    runs = F.filter(F.regexp_extract_all(lower, F.lit("([a-z]{2,})")), lambda r: F.array_contains(_listed(known.words), r))
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    around = F.translate(F.concat_ws(" ", x.before, x["name"]), _UPPER, _LOWER)
    return F.array(
        F.least(size, F.lit(256.0)), count("[0-9]") / size, count("[A-Z]") / size, count("[a-z]") / size,
        count("[^A-Za-z0-9]") / size,
        count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])") / size,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)), total(steps) / size,
        total(F.transform(runs, lambda r: F.length(r).cast("double"))) / size, count("[/.@:]"),
        F.coalesce(path.rlike(f"(?i){_EXAMPLE}"), F.lit(False)).cast("double"),
        around.rlike(rf"(^|[^a-z])({_CREDENTIAL})([^a-z]|$)").cast("double"),
        (around.rlike(rf"(^|[^a-z])({_EXAMPLE})([^a-z]|$)") | lower.rlike(_EXAMPLE)).cast("double"))


def _described(text: Column, path: Column, known: Words) -> Column:
    return F.transform(candidates(text), lambda x: F.struct(
        x.word.alias("word"), x.value.alias("value"), x["name"].alias("name"), x.before.alias("before"),
        _features(x, path, known).alias("features")))


def weak_label(x: Column) -> Column:
    """A label from format alone, where it decides: 1 for a provider's key and for hexadecimal text assigned to a
    credential's name, 0 for plain numbers, addresses and dotted names; else null."""
    around = F.translate(F.concat_ws(" ", x.before, x["name"]), _UPPER, _LOWER)
    assigned = around.rlike(rf"(^|[^a-z])({_CREDENTIAL})\W*[=:]?\W*$") & x.value.rlike("^[0-9A-Fa-f]+$") & x.value.rlike("[A-Fa-f]")
    return (F.when(x.value.rlike(_PROVIDER) | assigned, 1.0)
            .when(x.value.rlike(r"^[0-9.:\-]+$") | x.value.contains("@") | x.value.rlike(r"^[a-z0-9\-]+(\.[a-z0-9\-]+)+$"), 0.0))


def _tree(node, x: Column) -> Column:
    """A fitted tree as an expression over the features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(
        _tree(node.rightChild(), x))


class Forest:
    """A random forest fitted on (features, label) rows; columns beside these tell findings apart. Each label is sampled by
    itself and weighs as much as the other. Without both labels the weak label decides, and a candidate without one stays."""

    def __init__(self, labelled: DataFrame) -> None:
        known = cut(labelled.withColumn("label", F.col("label").cast("double")), "findings")
        by = [c for c in known.columns if c not in ("features", "label")]
        each = [hash_sample(known.where(F.col("label") == v), [*by, "features", "label"], TRAIN_ROWS // 2).coalesce(1) for v in (0.0, 1.0)]
        sizes = [x.count() for x in each]
        self.roots = []
        if all(sizes):
            sample = reduce(DataFrame.union, (x.withColumn("share", F.lit(max(sizes) / n)) for x, n in zip(each, sizes))).coalesce(1)
            vectors = sample.select(array_to_vector("features").alias("features"), "label", "share")
            model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, weightCol="share").fit(vectors)
            self.roots = [t._call_java("rootNode") for t in model.trees]

    def score(self, x: Column) -> Column:
        """The share of trees that call a candidate a secret; without trees its weak label, 0 where it has none."""
        if not self.roots:
            return F.coalesce(weak_label(x), F.lit(0.0))
        return reduce(lambda a, b: a + b, (_tree(r, x.features) for r in self.roots)) / len(self.roots)


def train(df: DataFrame, key: str, text: str, path: str | None = None) -> tuple[Words, Forest]:
    """Words of the corpus, and a forest on its findings that have a weak label.

    Findings of rows with crc32(key) mod 5 = 0 are left out, so accuracy can be measured there. Findings labelled by hand
    can be given to `Forest` directly.
    """
    known = corpus_words(df, text)
    where = F.col(path).cast("string") if path else F.lit("")
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    found = df.where(~held_out).select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("text"),
                                       F.explode(_described(F.col(text), where, known)).alias("x"))
    spot = F.xxhash64("key", "text", "x.word", "x.value").alias("spot")
    labelled = found.select(spot, "x.features", weak_label(F.col("x")).alias("label")).where("label IS NOT NULL")
    return known, Forest(labelled)


def findings(text: Column, path: Column, known: Words, forest: Forest) -> Column:
    """(word, value, name, score) of each candidate of a text, in order; empty for null and empty texts."""
    scored = F.transform(_described(text, path, known), lambda x: F.struct(
        x.word.alias("word"), x.value.alias("value"), x["name"].alias("name"), forest.score(x).alias("score")))
    return F.coalesce(scored, F.array().cast("array<struct<word:int,value:string,name:string,score:double>>"))


def scan(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """One row per finding: the key, number of the word, the value, its name, score, and kept (score of 0.5 or more).

    Null and empty texts give no rows; repeated rows give repeated findings; a null key is carried along. An empty table
    gives no rows. The whole text is scanned; a candidate is a whole word of any length.
    """
    known, forest = train(df, key, text, path)
    where = F.col(path).cast("string") if path else F.lit("")
    rows = df.select(F.col(key).alias("key"), F.explode(findings(F.col(text), where, known, forest)).alias("x"))
    return rows.select("key", "x.word", "x.value", "x.name", "x.score", (F.col("x.score") >= 0.5).alias("kept"))


def redact(df: DataFrame, key: str, text: str, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `df` with every secret in `text` replaced by `mark`, wherever in the text it stands; all rows and other
    columns stay as they are.

    A secret that is part of another one goes with it: longer values are replaced first. Null and empty texts stay, repeated
    rows stay alike, and an empty table gives no rows. Columns of any name are kept.
    """
    known, forest = train(df, key, text, path)
    where = F.col(path).cast("string") if path else F.lit("")
    real = F.filter(findings(F.col(text), where, known, forest), lambda x: x.score >= 0.5)
    rows = whole_row(df, F.col(text).alias("text"), F.transform(real, lambda x: x.value).alias("secrets"))
    longest = F.reverse(F.array_sort(F.transform(F.array_distinct("secrets"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    clean = F.aggregate(longest, F.col("text"), lambda t, x: F.replace(t, x.s, F.lit(mark)))
    return rows.select(*((F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")) if c == text else F.col("row")[c]).alias(c)
                         for c in df.columns))


def document_secrets(documents: DataFrame) -> DataFrame:
    """Findings of all documents; a value is given by its SHA-256 and length."""
    return scan(documents.select("doc_id", "text", "source"), "doc_id", "text", "source").select(
        F.col("key").alias("doc_id"), "word", F.sha2("value", 256).alias("value_sha256"),
        F.length("value").alias("length"), "name", "score", "kept")
