"""Near words by composition against all pairs of words, and words of texts against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from sluice.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    longer, shorter = sorted((a, b), key=len, reverse=True)
    return any(longer[:i] + longer[i + 1:] == shorter for i in range(len(longer)))


def drawn(seed, n, letters="ab", most=9):
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(1, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_composition_accepts_each_pair_once(seed):
    words = drawn(seed, 60)
    found = list(variants.one_edit_pairs(variants.Acceptor(words)))
    pairs = {frozenset((words[i], words[j])) for i, j in found}
    assert len(pairs) == len(found)
    assert pairs == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_acceptor_is_minimal_and_takes_the_empty_word():
    acceptor = variants.Acceptor(["", "ab", "abc", "cb", "cbc"])
    assert len(acceptor.arcs) == 4 and acceptor.final[acceptor.start]
    assert list(variants.one_edit_pairs(variants.Acceptor([]))) == []


def test_long_words_are_not_deep():
    long = "a" * 50000
    assert len(list(variants.one_edit_pairs(variants.Acceptor([long, long + "a", long + "b"])))) == 3


@pytest.mark.parametrize("limit", [1, 4, 4096])
def test_near_words_whatever_the_partitions(spark, limit):
    words = drawn(9, 300, "abé\U0001F600", 8) + ["aaaaaaaaaaaa" + w for w in drawn(3, 40)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    out = [tuple(r) for r in variants.near_words(df, limit).collect()]
    assert len(out) == len(set(out))
    n = {w: i for i, w in enumerate(words)}
    assert set(out) == {(a, n[a], b, n[b]) for a in words for b in words if near(a, b)}


def test_forms_and_roots(spark):
    counts = {"colour": 5, "colours": 25, "colourse": 125, "colourx": 25, "distant": 7, "kettle": 10, "kettles": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants.groups(df).collect()}
    assert out == {"colour": ("colours", "colourse", 2, 25), "colours": ("colourse", "colourse", 3, 125),
                   "colourse": (None, "colourse", 1, None), "colourx": (None, "colourx", 2, None),
                   "distant": (None, "distant", 0, None), "kettle": (None, "kettle", 1, None),
                   "kettles": (None, "kettles", 1, None)}
    assert variants.groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.groups(df, ratio=1)


def test_vocabulary(spark):
    rows = [(i, "Straße überÀll X" * (i % 3) + " Anderson×ende lettering, Lettering LETTERING") for i in range(400)]
    rows += [(None, "lettering"), (5, None), (6, ""), (7, "ab " * 10)] + rows[:9]
    want = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, word int, n int")
    out = {r.word: r.n for r in variants.vocabulary(df, "doc_id", "text").collect()}
    assert out == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert len(out) > 3
