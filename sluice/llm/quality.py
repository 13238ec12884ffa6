"""Quality rules: statistics of a text, and an isolation forest that finds documents whose statistics are odd."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import cut, hash_sample

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
          "words_per_line"]
# Statistics a forest may look at; labelled rows choose the set. Odd is not bad: on all statistics together, a forest also
# isolates the rare good document with numbers or a repeated line.
SETS = [["word_length", "symbol_share"], ["word_length", "symbol_share", "upper_share"],
        ["word_length", "symbol_share", "mark_share", "upper_share"], SHARES]
SAMPLE_ROWS = 8192   # rows the forest is fitted on, picked by hash from all rows
TREES = 64
TREE_ROWS = 256
STEPS = 1000         # thresholds tried in calibration
NO_LABELS = 0.62     # threshold where no row has a label

_CODES = np.arange(256)
_SYMBOLS = np.isin(_CODES, list(b"#*$%&|<>"))
_SPACE = np.isin(_CODES, list(b" \t\n\x0b\x0c\r"))
_MARKS = np.isin(_CODES, list(b"!\"'()+,-./:;=?@[\\]^_`{}~"))
_DIGITS = (_CODES >= 48) & (_CODES <= 57)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_STARTS = (_CODES & 0xC0) != 0x80  # the first byte of a code point


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that is found twice or more, its first time included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:len(words) - 2 + shift] |= often
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple:
    """COUNTS, then SHARES, of a whole UTF-8 text; all zero for null and for texts without a word."""
    words = text.split() if text else []
    if not words:
        return (0,) * len(COUNTS) + (0.0,) * len(SHARES)
    by_code = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(by_code[_STARTS].sum() - by_code[_SPACE].sum())
    symbols = int(by_code[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    double = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    return (len(words), chars, symbols, double, repeats, chars / len(words), symbols / chars, double / len(lines),
            repeats / len(words), by_code[_UPPER].sum() / chars, by_code[_DIGITS].sum() / chars,
            by_code[_MARKS].sum() / chars, math.log1p(len(words) / len(lines)))


def with_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, COUNTS, SHARES) of every row."""
    names = ["key", *COUNTS, *SHARES]
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(SHARES)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = ", ".join([f"key {df.schema[key].dataType.simpleString()}", *(f"{n} long" for n in COUNTS),
                        *(f"{n} double" for n in SHARES)])
    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(batches, schema)


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of a leaf that still holds n rows."""
    n = np.asarray(n, dtype=float)
    long = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits, as arrays: split feature (-1 in a leaf), threshold, left child (right is next), depth."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.tree_rows = min(tree_rows, len(rows))
        self.limit = max(1, math.ceil(math.log2(max(self.tree_rows, 2))))
        self.trees = [self._grow(rows[draw.choice(len(rows), self.tree_rows, replace=False)], draw) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, threshold, child, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, inside, level = todo.pop()
            low, high = inside.min(axis=0), inside.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level >= self.limit or len(inside) < 2 or not len(usable):
                depth[node] = level + float(_path_length(len(inside)))
                continue
            pick = int(draw.choice(usable))
            cut_at = float(draw.uniform(low[pick], high[pick]))
            left = inside[:, pick] <= cut_at
            feature[node], threshold[node], child[node] = pick, cut_at, len(feature)
            for part in (inside[left], inside[~left]):
                todo.append((len(feature), part, level + 1))
                for store, empty in ((feature, -1), (threshold, 0.0), (child, 0), (depth, 0.0)):
                    store.append(empty)
        return np.array(feature), np.array(threshold), np.array(child), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 where random splits isolate a row early."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, child, depth in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.limit):
                split = feature[node]
                right = rows[at, split] > threshold[node]
                node = np.where(split < 0, node, child[node] + right)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_path_length(self.tree_rows)), 1e-9))


def fit(stats: DataFrame) -> list[IsolationForest]:
    """A forest for each of SETS on at most SAMPLE_ROWS of the rows that pass the base rules, picked by hash; none
    without such rows."""
    picked = hash_sample(stats.where(~base_failed()), ["key", *COUNTS, *SHARES], SAMPLE_ROWS).select(*SHARES).toPandas()
    return [IsolationForest(picked[names].to_numpy(dtype=float)) for names in SETS] if len(picked) else []


def scored(stats: DataFrame, forests: list[IsolationForest]) -> DataFrame:
    """The statistics with `anomalies`: the score of each forest; null for rows that fail the base rules."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            scores = [f.score(np.column_stack([np.asarray(batch.column(c), dtype=float) for c in names]))
                      for f, names in zip(forests, SETS)]
            flat = np.column_stack(scores).ravel() if scores else np.empty(0)
            ends = np.arange(batch.num_rows + 1) * len(scores)
            yield batch.append_column("anomalies", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))

    schema = stats.schema.simpleString().removeprefix("struct<").removesuffix(">")
    out = stats.mapInArrow(batches, f"{schema}, anomalies:array<double>")
    return out.withColumn("anomalies", F.when(~base_failed(), F.col("anomalies")))


def calibrate(rows: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[int, float]:
    """The forest and the threshold with the most right verdicts on labelled rows, where label 1 is good.

    Ties take the highest threshold. All labelled rows that pass the base rules count; what reaches the driver is one
    row for each forest and step of the score.
    """
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("good"))
    steps = (rows.where(F.col("anomalies").isNotNull()).select("key", F.posexplode("anomalies").alias("forest", "anomaly"))
             .join(good, "key").groupBy("forest", F.ceil(F.col("anomaly") * STEPS).cast("int").alias("step"))
             .agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"),
                  F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")).collect())
    if not steps:
        return 0, NO_LABELS
    good_at, bad_at = (np.zeros((len(SETS), STEPS + 1)) for _ in range(2))
    for row in steps:
        good_at[row.forest, row.step], bad_at[row.forest, row.step] = row.good, row.bad
    right = good_at.cumsum(axis=1) + bad_at.sum(axis=1, keepdims=True) - bad_at.cumsum(axis=1)  # kept up to a step
    best = int(right.max(axis=1).argmax())
    return best, float(np.flatnonzero(right[best] == right.max())[-1] / STEPS)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, COUNTS, SHARES, base_failed, anomaly, threshold, kept) of every row.

    A row is kept if it passes the base rules and its anomaly is at most the calibrated threshold. Null texts and texts
    without a word have zero counts and fail. Rows that share a key are judged alone, and all count for its label; rows
    without a label or with a null key are judged like others. Conflicting labels: the best one counts. Empty tables give
    no rows; without labels the threshold is NO_LABELS.
    """
    stats = cut(with_statistics(df, key, text), "statistics")
    rows = cut(scored(stats, fit(stats)), "anomalies")
    forest, threshold = calibrate(rows, labels, key, label)
    judged = rows.withColumns({"base_failed": base_failed(), "threshold": F.lit(threshold),
                               "anomaly": F.get("anomalies", F.lit(forest))}).drop("anomalies")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("anomaly") <= threshold, F.lit(False))
                             ).withColumnRenamed("key", key)


def document_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics and the verdict of every document."""
    return judge(documents.select("doc_id", "text"), labels).select(
        "doc_id", *COUNTS, "base_failed", "kept", "anomaly", "threshold")
