"""Secrets: training samples with rare or absent labels."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import secrets
from tests.llm.test_native import findings_table

ROWS = "doc_id long, text string, source string"


def test_clean_corpus_stays_as_it_is(spark):
    """Negatives only: no candidate has grounds to be a secret."""
    rows = [(i, f"write to person{i}.smith@mail{i}.example.com or see https://site.example/a{i}/page12345 now", "s") for i in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.text for r in secrets.redact(df, "doc_id", "text", "source").collect()} == {r[1] for r in rows}


def test_rare_label_is_sampled(spark, monkeypatch):
    """Few secrets among many labelled findings are in the sample all the same."""
    monkeypatch.setattr(secrets, "TRAIN_ROWS", 20)
    table = findings_table(spark).where("doc_id % 4 IN (1, 2) OR doc_id < 8")
    rows = secrets.scan(table, "doc_id", "text", "source").collect()
    assert len(rows) == 124 and all(r.kept == (r.key % 4 in (0, 3)) for r in rows)


def redacted(spark, rows):
    df = findings_table(spark).union(spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(rows)], ROWS))
    out = {r.doc_id: r.text for r in secrets.redact(df, "doc_id", "text", "source").collect()}
    return [out[1000 + i] for i in range(len(rows))]


def test_secrets_in_secrets_leave_nothing(spark):
    """Beginnings, ends and middles of other secrets, in any order, and repeated."""
    long = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    parts = [long[:32], long[16:48], long[-24:], long]
    texts = [" and ".join(f"token={p}" for p in order) + f" {long}{long}" for order in (parts, parts[::-1], parts[1:] + parts[:1] * 3)]
    got = redacted(spark, texts)
    for text in got:
        assert "token=[SECRET]" in text
        assert not any(long[i:i + 8] in text for i in range(len(long) - 7)), text


def test_named_credentials(spark):
    """Short values, signs in them, quoted names, and values in the next word; plain words and clean text stay."""
    got = redacted(spark, ["login with password=Tr0ub4dor&3 now", 'x {"password":"hunter2!hunter"} y', "passwd: hunter2hunter2 (old)",
                           "pwd: x1y2z3!k x", "DB_PASSWORD='s3cr3t!!' in .env", "password: please choose one",
                           "the token is missing", "secret=Garden", "my api-key = k9#mQ2$z"])
    for text, value in zip(got, ["Tr0ub4dor&3", "hunter2!hunter", "hunter2hunter2", "x1y2z3!k", "s3cr3t!!"]):
        assert value not in text and "[SECRET]" in text, text
    assert got[5:8] == ["password: please choose one", "the token is missing", "secret=Garden"]


def test_candidates_by_context(spark):
    df = spark.createDataFrame([("a password=Tr0ub4dor&3, b",), ('{"api_key":"a1!b2?c3"}',), ("pwd: x1y2z3 w",), ("token tok3n!",),
                                ("password=abc1",), ("author=Name99x",), ("x Authorization: Bearer ab12.cd34-ef y",)], "text string")
    got = [[(x.word, x["name"], x.value) for x in r[0]] for r in df.select(secrets.candidates(F.col("text"))).collect()]
    assert got == [[(1, "password", "Tr0ub4dor&3")], [(0, "api_key", "a1!b2?c3")], [(1, "", "x1y2z3")], [], [], [], [(3, "", "ab12.cd34-ef")]]


def test_words_of_the_corpus(spark, monkeypatch):
    """Dictionary and transitions come from all words, however rare or long."""
    texts = ["The the cat", "a cat Sat on 1the dot.", None, "", "supercalifragilistic the\tcat"]
    seen = Counter(w for t in texts if t for w in re.split(r"[ \t]+", t.lower()) if re.fullmatch("[a-z]{2,}", w))
    monkeypatch.setattr(secrets, "DICTIONARY_SHARE", 2 / sum(seen.values()))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = secrets.corpus_words(df, "text")
    assert known.words == tuple(sorted((w for w, n in seen.items() if n >= 2), key=lambda w: (-seen[w], w)))
    pairs = Counter()
    for word, n in seen.items():
        spots = [0, *(ord(c) - 96 for c in word), 0]
        for pair in zip(spots, spots[1:]):
            pairs[pair] += n
    for a in range(27):
        after = sum(pairs[a, b] for b in range(27))
        for b in range(27):
            assert known.transitions[a * 27 + b] == pytest.approx(math.log((pairs[a, b] + 1) / (after + 27)), abs=1e-6)
    none = secrets.corpus_words(df.limit(0), "text")
    assert none.words == () and len(set(none.transitions)) == 1
