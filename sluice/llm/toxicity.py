"""Toxicity behind disguises: texts are restored with a noisy channel, then scored.

A disguised word (leetspeak, letters held down, letters spaced out) is a lattice of the letters each sign may stand for.
Viterbi decoding under a four-letter model of the corpus picks the likeliest word. The score looks at restored words and
their beginnings, with weights and calibration learned from labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import cut, hash_sample, whole_row

TRAIN_ROWS = 20_000      # labelled documents the scorer is fitted on, half of each label at least where there are as many
MODEL_FEATURES = 100_000  # words and beginnings of words tried as features
MIN_DOCUMENTS = 3        # toxic documents a feature must be in
STRONGEST = 5            # words that count as evidence in one document
CACHED_WORDS = 400_000   # decoded words a task remembers before it starts afresh

# What signs stand for, and what the channel makes of letters (log probabilities).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou"}
AS_LEET, AS_SIGN, HELD_DOWN, DOUBLED, DROPPED, REAL_SPACE = -2.0, -3.0, -0.5, -6.0, -2.0, -3.0

A = 27                   # a to z, and 0 for everything that ends a word
_CONTEXT = A ** 3
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*])(?:[ .\-_*](?:[^\W_]|[@$!|+*])){3,}(?=[\s.,;:?!]|$)")
_LETTER = "[^\\W\\d_]"
_DISGUISED = re.compile(rf"{_LETTER}[0-9@$!|+€£(*]|[0-9@$!|+€£(*]{_LETTER}|(.)\1\1")
_HELD = re.compile(r"(.)\1+$")
_EDGE = "\"'`()[]{}<>.,;:?#%&~^=/\\_-"


def _fold(code: int) -> int:
    """The number of a letter without its accent, 1 to 26; 0 for other signs."""
    if code == 0xDF:
        return 19
    base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 0


_FOLDED = np.array([_fold(i) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x250)] + [0], dtype=np.int64)


def letter_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of four signs in a row, as numbers to base 27; what stands before the start of a word is 0."""
    codes = np.frombuffer(" ".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.concatenate([[0, 0, 0], _FOLDED[np.minimum(codes, len(_FOLDED) - 1)], [0]])
    first, second, third, last = signs[:-3], signs[1:-2], signs[2:-1], signs[3:]
    second = np.where(third == 0, 0, second)
    first = np.where(second == 0, 0, first)
    grams = ((first * A + second) * A + third) * A + last
    counts = np.bincount(grams, minlength=1)
    counts[0] = 0  # between words
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def letter_model(df: DataFrame, text: str) -> np.ndarray:
    """Log probabilities of a sign after three others, from all texts: 27**4 numbers, whatever the size of the corpus.

    Tasks count their texts; the counts are added up by gram, at most 27**4 rows. Orders are mixed, longer contexts
    counting more the oftener they were seen (Witten and Bell).
    """
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CONTEXT * A, dtype=np.int64)
        for batch in source:
            texts, held = [], 0
            for item in batch.column(0):
                texts.append(item.as_py())
                held += len(texts[-1] or "")
                if held > 1 << 22:
                    grams, counts = letter_grams(texts)
                    total[grams] += counts
                    texts, held = [], 0
            grams, counts = letter_grams(texts)
            total[grams] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["gram", "n"])

    sums = df.select(F.col(text).alias("text")).mapInArrow(batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = sums.toPandas()
    counts = np.zeros(_CONTEXT * A)
    counts[grams.gram.to_numpy(np.int64)] = grams.n.to_numpy(np.float64)
    model = np.full(A, 1 / A)
    for order in range(1, 5):
        own = counts.reshape(-1, A ** order).sum(axis=0).reshape(-1, A)
        total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
        lower = np.tile(model.reshape(-1, A), (max(1, len(own) // max(1, len(model.reshape(-1, A)))), 1))
        model = np.where(total > 0, (own + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(model).ravel()


def _runs(observed: str) -> list[tuple[str, int]]:
    out: list[list] = []
    for sign in observed:
        if out and out[-1][0] == sign:
            out[-1][1] += 1
        else:
            out.append([sign, 1])
    return [(s, n) for s, n in out]


def _arcs(sign: str, count: int, spaced: bool) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with the channel's log probability."""
    code = ord(sign)
    letter = int(_FOLDED[min(code, len(_FOLDED) - 1)])
    if letter:
        c = chr(96 + letter)
        if count == 1:
            return [(c, 0.0)]
        return [(c, DOUBLED if count == 2 else HELD_DOWN), (c + c, 0.0 if count == 2 else 2 * HELD_DOWN)]
    if spaced and sign in " .-_*":
        return [("", 0.0), (" ", REAL_SPACE * count)]
    out = [(c * k, AS_LEET + (0 if k == count else HELD_DOWN)) for c in LEET.get(sign, "") for k in {1, min(count, 2)}]
    out.append((sign * count, AS_SIGN * min(count, 3)))
    if not sign.isalnum():
        out.append(("", DROPPED * min(count, 3)))
    return out


def decode(observed: str, model: list[float], spaced: bool = False) -> str:
    """The likeliest text behind a lower-case string: Viterbi over the lattice, the last three letters being the state."""
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for sign, count in _runs(observed):
        after: dict[int, tuple[float, tuple]] = {}
        arcs = _arcs(sign, count, spaced)
        for context, (score, path) in states.items():
            for emitted, cost in arcs:
                at, now = context, score + cost
                for c in emitted:
                    number = ord(c) - 96 if "a" <= c <= "z" else 0
                    if number or at:
                        now += model[at * A + number]
                    at = (at * A + number) % _CONTEXT if number else 0
                if at not in after or now > after[at][0]:
                    after[at] = (now, (path, emitted))
        states = after
    _, path = max(((score + (model[at * A] if at else 0.0), path) for at, (score, path) in states.items()), key=lambda x: x[0])
    parts = []
    while path:
        path, emitted = path
        parts.append(emitted)
    return "".join(reversed(parts))


@dataclass
class Restorer:
    """Restores texts under a letter model; remembers the words it has decoded."""

    model: list[float]
    known: dict[str, str] = field(default_factory=dict)

    def word(self, word: str) -> str:
        """One word without white space, lower-case and restored."""
        found = self.known.get(word)
        if found is None:
            core = word.lower().strip(_EDGE).rstrip("!").strip(_EDGE)
            held = _HELD.search(core)
            if held and len(held[0]) > 2 and not held[0][0].isalnum():
                core = core[:held.start()].strip(_EDGE)
            found = decode(core, self.model) if _DISGUISED.search(core) else core
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def unspaced(self, text: str) -> str:
        """The text with spaced-out words joined."""
        return _SPACED.sub(lambda m: decode(m[0].lower(), self.model, spaced=True), text)

    def text(self, text: str) -> str:
        """The whole text, lower-case, every word restored; white space stays."""
        return re.sub(r"\S+", lambda m: self.word(m[0]), self.unspaced(text))

    def words(self, text: str | None) -> set[str]:
        """The different restored words of a text."""
        return {self.word(w) for w in set(self.unspaced(text).split())} if text else set()


def features_of(word: str) -> list[str]:
    """A word and its beginnings of four to six letters."""
    return [word] + [f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n]


@dataclass
class Scorer:
    """Weights of features, and the line that turns evidence into a probability."""

    weights: dict[str, float]
    slope: float = 0.0
    base: float = -2.0

    def evidence(self, words: set[str]) -> float:
        """The weights of the strongest words, each counted by its strongest feature."""
        best = (max((self.weights[f] for f in features_of(w) if f in self.weights), default=0.0) for w in words)
        return float(sum(sorted((b for b in best if b), reverse=True)[:STRONGEST]))

    def score(self, words: set[str]) -> float:
        return float(1 / (1 + np.exp(-(self.base + self.slope * self.evidence(words)))))


def _weights(counts: list, toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Log odds of features that toxic documents have oftener than chance explains, the number tried considered.

    Features in fewer than MIN_DOCUMENTS toxic documents could not pass and are not among the tried.
    """
    out = {}
    for row in counts:
        a, b = row.toxic, row.clean
        share, expected = a / (a + b), toxic / (toxic + clean)
        if share <= expected:
            continue
        gain = a * np.log(share / expected) + (b * np.log((1 - share) / (1 - expected)) if b else 0)
        if gain > np.log(max(tried, 2)) + 1:
            out[row.feature] = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    return out


def _line(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton's method with a weak pull to zero; `weight` is how many documents one
    stands for."""
    x = np.column_stack([evidence, np.ones(len(evidence))])
    at, pull = np.zeros(2), np.array([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (weight * (toxic - p)) - pull * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0.0)), float(at[1])


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _mapped(df: DataFrame, restorer: Restorer, schema: str, use) -> DataFrame:
    """Rows (text, ...) -> rows of `schema`: `use(restorer, batch)` gives a list of columns."""
    model = np.asarray(restorer.model, dtype=np.float32)  # the broadcast closure: 27**4 numbers

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(model.tolist())
        for batch in source:
            yield pa.RecordBatch.from_arrays(use(own, batch), names)

    names = [x.split()[0] for x in schema.split(", ")]
    return df.mapInArrow(batches, schema)


def fit(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, restorer: Restorer) -> Scorer:
    """A scorer from at most TRAIN_ROWS labelled documents, none of them held out.

    Each label is sampled by itself, so a rare one is learned at any size of the table; documents then weigh as many as
    they stand for. Conflicting labels of a key: toxic counts. Rows that share a key: one text of them is taken. Without
    toxic or without clean documents every score is the same.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic")))
    known = cut(known.select("key", (F.col("toxic") == 1).cast("int").alias("toxic")), "toxic-labels")
    labelled = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limits = [TRAIN_ROWS - min(labelled.get(1 - v, 0), TRAIN_ROWS // 2) for v in (0, 1)]
    picked = [hash_sample(known.where(F.col("toxic") == v), ["key"], limit) for v, limit in enumerate(limits)]
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = cut(texts.join(F.broadcast(picked[0].union(picked[1])), "key").groupBy("key").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")
    sizes = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Scorer({}, 0.0, 2.0 if toxic else -2.0)

    def found(own: Restorer, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([sorted({f for w in own.words(t) for f in features_of(w) if w}) for t in batch.column(0).to_pylist()],
                         pa.list_(pa.string()))]

    tried = cut(_mapped(sample.where("toxic = 1").repartition(8), restorer, "features array<string>", found)
                .select(F.explode("features").alias("feature")).groupBy("feature").count().where(f"count >= {MIN_DOCUMENTS}"),
                "toxic-features")
    top = {r.feature for r in tried.orderBy(F.desc("count"), "feature").limit(MODEL_FEATURES).collect()}

    def counted(own: Restorer, batch: pa.RecordBatch) -> list[pa.Array]:
        sums = (Counter(), Counter())
        for body, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[kind == 1].update({f for w in own.words(body) for f in features_of(w) if f in top})
        names = sorted(sums[0] | sums[1])
        return [pa.array(names, pa.string()), *(pa.array([sums[k][f] for f in names], pa.int64()) for k in (1, 0))]

    counts = (_mapped(sample.repartition(16), restorer, "feature string, toxic long, clean long", counted).groupBy("feature")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0").collect())
    scorer = Scorer(_weights(counts, toxic, clean, len(top)))

    def weighed(own: Restorer, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([scorer.evidence(own.words(t)) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)]

    seen = _mapped(sample.repartition(16), restorer, "evidence double, toxic int", weighed).toPandas()
    stands_for = np.array([max(1.0, labelled[v] / limit) for v, limit in enumerate(limits)])
    is_toxic = seen.toxic.to_numpy(int)
    scorer.slope, scorer.base = _line(seen.evidence.to_numpy(float), is_toxic.astype(float), stands_for[is_toxic])
    return scorer


def train(df: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[Restorer, Scorer]:
    """The letter model of all texts of `df`, and a scorer from those that are labelled and not held out."""
    restorer = Restorer(letter_model(df, text).tolist())
    return restorer, fit(df, labels, key, text, label, restorer)


def scored(df: DataFrame, text: str, restorer: Restorer, scorer: Scorer) -> DataFrame:
    """(row, score): every whole input row with its probability of being toxic.

    Null and empty texts have no evidence and get the lowest score. Rows repeat as they do in `df`; equal texts have equal
    scores. No column but the text is looked at.
    """
    rows = whole_row(df, F.col(text).cast("string").alias("text"))
    model = np.asarray(restorer.model, dtype=np.float32)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(model.tolist())
        for batch in source:
            scores = [scorer.score(own.words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def restored(df: DataFrame, text: str, restorer: Restorer) -> DataFrame:
    """(row, restored): every whole input row with its restored text; null stays null."""
    rows = whole_row(df, F.col(text).cast("string").alias("text"))
    model = np.asarray(restorer.model, dtype=np.float32)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(model.tolist())
        for batch in source:
            texts = [None if t is None else own.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "restored"])

    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, restored string")


def reject(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of `df` whose score is below 0.5, with its columns."""
    return scored(df, text, *train(df, labels, key, text, label)).where("score < 0.5").select("row.*")


def document_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every document. A null doc_id counts as an empty one for `held_out`."""
    narrow = documents.select("doc_id", "text")
    out = scored(narrow, "text", *train(narrow, labels, "doc_id", "text", "toxic"))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
