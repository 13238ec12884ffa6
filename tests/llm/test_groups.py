"""SimHash groups and vector links against brute force; components; quality statistics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import components, quality, simhash, vectors


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(3)
    nodes = draw.sample(range(10 ** 9), 600)
    links = [(nodes[i], nodes[i + 1]) for i in range(0, 199)]               # a chain
    links += [(nodes[300], nodes[i]) for i in range(301, 500)]              # a star
    links += [(nodes[550], nodes[550]), (nodes[301], nodes[300])]
    df = spark.createDataFrame(links + [(None, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    place = {x: i for i, x in enumerate(sorted(nodes))}
    order = sorted(nodes)
    want = union(600, [(place[a], place[b]) for a, b in links])
    assert got == {x: order[want[place[x]]] for a, b in links if a != b for x in (a, b)}
    assert components.components(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=60), st.integers(0, 3))
def test_bk_tree_finds_all(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 256, 17):
        assert sorted(tree.values[i] for i in tree.within(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def plain_fingerprint(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "É è ß x b", "a b c a b c a b c", "x " * 5000 + "y\x1cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % 2 ** 64 == plain_fingerprint(text)


def test_links_of_flipped_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)  # so large shards are dealt again
    draw = random.Random(5)
    values = set()
    for _ in range(60):
        v = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            values.add(v)
            for _ in range(draw.randint(1, 3)):
                v ^= 1 << draw.randrange(64)
    base = draw.getrandbits(64)  # many that share three of four bands
    values |= {base ^ (draw.getrandbits(16) << 16) for _ in range(150)}
    values = sorted(values)
    df = spark.createDataFrame([(v - 2 ** 64 if v >= 2 ** 63 else v,) for v in values], "fp long")
    found = [(r.u % 2 ** 64, r.v % 2 ** 64) for r in simhash.links(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in found)
    place = {v: i for i, v in enumerate(values)}
    want = [(i, j) for i, a in enumerate(values) for j in range(i) if (a ^ values[j]).bit_count() <= 2]
    assert union(len(values), [(place[a], place[b]) for a, b in found]) == union(len(values), want)
    with pytest.raises(ValueError):
        simhash.links(df, radius=3)


def test_groups_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(9, text), (4, text), (4, text), (7, text.upper()), (None, text), (1, "alone here now"), (2, ""), (3, None), (None, "null key only"),
            (5, "x " * 60000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, key string, fp int")
    got = simhash.document_groups(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        [(9, 4), (4, 4), (4, 4), (7, 4), (None, 4), (1, 1), (2, 2), (3, 2), (None, None), (5, 5)])
    assert {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"0" * 16}
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert Counter((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == Counter(
        [(4, text[:5]), (1, "alone"), (2, ""), (None, "null "), (5, "x x x")])
    assert simhash.document_groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0), "doc_id", "text").count() == 0


def vector_table(spark):
    draw = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = draw.normal(size=16)
        for _ in range(draw.integers(1, 30)):
            rows.append((centre + draw.normal(size=16) * draw.uniform(0.05, 0.45)).astype(np.float32).tolist())
    rows += [rows[0]] * 5 + [[x * 3 for x in rows[1]]]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [-0.0, 2.0], [0.0, 2.0]]
    order = draw.permutation(len(rows))
    return [(int(k), rows[i], "x") for k, i in enumerate(order)] + [(0, rows[order[0]], "x")]


@pytest.mark.parametrize("block", [7, 4096])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = vector_table(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string")
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    links = [(i, j) for i, (_, a, _) in enumerate(rows) for j, (_, b, _) in enumerate(rows[:i]) if good[i] and good[j] and len(a) == len(b)
             and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.9]
    degree = Counter(x for pair in links for x in pair)
    root = union(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 10 ** 9), rows[i][0])
    want = Counter((rows[i][0], degree[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))
    assert len(links) > 200
    assert Counter(tuple(r) for r in vectors.embedding_groups(df).collect()) == want
    assert vectors.embedding_groups(df.limit(0)).count() == 0


def test_vectors_null_keys(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in vectors.embedding_groups(df).collect()) == Counter(
        [(None, 1, 3, False), (3, 1, 3, True), (None, 0, None, False), (4, 0, 4, True)])


def plain_counts(text):
    space = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in (text or "") + " ":
        if c in space:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in space for c in line):
            double += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), double, len(marked))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|é\n\t 𝔘\x1c", max_size=80))
def test_quality_counts(text):
    assert tuple(quality.statistics(text.encode())[:5]) == (plain_counts(text) if plain_counts(text)[0] else (0,) * 5)


def test_isolation_forest_scores_outliers_higher():
    draw = np.random.default_rng(1)
    rows = np.vstack([draw.normal(size=(1000, 3)), draw.normal(size=(20, 3)) + 8])
    scores = quality.IsolationForest(rows).score(rows)
    assert scores[1000:].min() > np.quantile(scores[:1000], 0.95)


def test_quality_verdicts(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(120)) + ".") for i in range(400)]
    rows += [(i, " ".join(word() + "###" for _ in range(120))) for i in range(400, 440)]
    rows += [(500, None), (501, ""), (502, "few words"), (503, "same three words " * 40), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(0, 440, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.judge(df, labels)
    verdict = {(r.doc_id, r.n_words): r.kept for r in got.collect()}
    assert got.count() == len(rows)
    assert sum(verdict[i, 120] for i in range(400)) >= 380 and not any(verdict[i, 120] for i in range(400, 440))
    assert verdict[None, 120] == verdict[0, 120]
    assert not any(verdict[k] for k in ((500, 0), (501, 0), (502, 2), (503, 120)))
    assert quality.judge(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels.limit(0)).select("threshold").distinct().collect()[0][0] == quality.NO_LABELS
