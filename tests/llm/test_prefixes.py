"""The conversation trie against a trie built in Python, and running values over split keys."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "",
                                             hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        nodes.setdefault(("ends", path), []).append(c)
    ends = {k[1]: v for k, v in nodes.items() if k[:1] == ("ends",)}
    nodes = {k: v for k, v in nodes.items() if k[:1] != ("ends",)}
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        parents = {p[:-1] for p in nodes if p}
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(1 for p in nodes if len(p) == len(path) + 1 and p[:-1] == path), sum(1 for p in below if p not in parents),
                    sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in prefixes.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_small_conversations_with_nulls_and_ties(spark):
    draw = random.Random(5)
    rows = []
    for conv in [0, 1, 2, 3, 7, 99, 100, 101, 150, 205, 206, 250]:  # 200 is not there
        for turn in range(draw.randrange(1, 8)):
            rows.append((conv, draw.choice([turn, turn, 1, None]), draw.choice(["user", "assistant", None, ""]),
                         draw.choice(["a", "é\U0001F600", "", None])))
    rows += rows[:5] + [(None, 0, "user", "of no conversation")]
    assert got(spark, rows) == brute(rows)


def test_hot_conversation_and_long_one(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "_CHUNK", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(1, 60) for t in range(3)]
    rows += [(100 * c, t, "user", f"t{t}") for c in range(1, 90) for t in range(4)]
    rows += [(61, t, "user", f"t{t % 11}") for t in range(700)]
    assert got(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_one_conversation_without_turns_left(spark):
    rows = [(c, 0, "user", "x") for c in range(101, 140)]  # all turns may be among the first h, and 100 is not there
    out = got(spark, rows)
    assert out == brute(rows)
    assert any(r[1] == 0 for r in out)


def test_running_values_over_split_keys(spark):
    rows = [(k, i, (i * 7919 + k) % 1000003) for k, n in ((1, 3), (2, 2000), (3, 1), (4, 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(13)
    out = prefixes.running(df, "k", [F.col("i")], {"total": (F.sum, F.col("v")), "mix": (F.bit_xor, F.col("v"))}, "test").collect()
    want, total, mix, last = {}, 0, 0, None
    for k, i, v in sorted(rows):
        if k != last:
            total, mix, last = 0, 0, k
        want[k, i] = (total, mix)
        total, mix = total + v, mix ^ v
    assert {(r.k, r.i): (r.total, r.mix) for r in out} == want


@pytest.mark.parametrize("bound", [1, 2, 5])
def test_members_are_hashed_in_order(spark, monkeypatch, bound):
    monkeypatch.setattr(prefixes, "_CHUNK", bound)
    rows = [(0, 0, 0, k) for k in range(1000, 1033)] + [(1, 5, 6, 9)]
    df = spark.createDataFrame(rows, "depth long, a long, b long, key long").repartition(5)
    out = {r.depth: r.ends_sha256 for r in prefixes._members(df).collect()}
    assert out == {0: hashlib.sha256(",".join(str(k) for k in range(1000, 1033)).encode()).hexdigest(),
                   1: hashlib.sha256(b"9").hexdigest()}
