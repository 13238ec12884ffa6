"""Fingerprints against the same rule in Python, likeness against exact shares, and neighbours of documents."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from sluice.llm import minhash


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def of(*values, width="q"):
    """Spark's xxhash64 of integers: each seeds the next."""
    seed = 42
    for v, kind in zip(values, width * len(values) if len(width) == 1 else width):
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed)
    return signed(seed)


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if len(words) < 5:
        return [signed(xxhash.xxh64_intdigest(" ".join(words).encode(), 42))]
    return [of(*hashes[i:i + 5]) for i in range(len(words) - 4)]


def brute(text):
    least = {}
    for h in shingles(text):
        h &= ~1
        least[h >> 56] = min(h, least.get(h >> 56, h))
    bins = [least.get(b) for b in range(-128, 128)]
    dense = []
    for i, v in enumerate(bins):
        tries = (bins[of(t, i, width="i") % 256] for t in range(minhash.TRIES))
        rest = min((of(i, h >> 56, width="iq"), h) for h in bins if h is not None)[1]
        dense.append(next((x for x in (v, *tries) if x is not None), rest))
    return "".join(f"{of(v, i, width='qi') & 255:02x}" for i, v in enumerate(dense))


TEXTS = ["", None, " \t\n", "one", "one two three four", "one two three four five", "a b c d e f g h i j",
         " ".join(f"w{i % 97}" for i in range(400)), " ".join(f"w{i}" for i in range(5000)), "é ü ñ 日本 語 \U0001F600 x y z"]


def test_same_as_in_python(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)],
                               "`row` int, text string, `words.bins` string, Hashes int")
    out = minhash.fingerprint(df, "text", "print").select("*", minhash.hexadecimal("print").alias("hex")).collect()
    assert {r.row: r.hex for r in out} == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert out[0]["words.bins"] == "x"


def test_likeness_is_near_the_exact_share(spark):
    draw = random.Random(3)
    rows = []
    for n in (30, 200, 3000):
        for kept in (0.0, 0.3, 0.6, 0.8, 0.95, 1.0):
            a = [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]
            b = a[:int(n * kept)] + [f"w{draw.randrange(10 ** 9)}" for _ in range(n - int(n * kept))]
            x, y = set(shingles(" ".join(a))), set(shingles(" ".join(b)))
            rows.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "a string, b string, exact double")
    df = minhash.fingerprint(minhash.fingerprint(df, "a", "pa"), "b", "pb")
    errors = [abs(r.got - r.exact) for r in df.select("exact", minhash.likeness("pa", "pb").alias("got")).collect()]
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.03


def test_likeness_counts_equal_bytes(spark):
    draw = random.Random(1)
    a = [draw.randbytes(256) for _ in range(20)]
    b = [bytes(x if draw.random() < 0.5 else draw.randrange(256) for x in v) for v in a]
    longs = lambda v: list(struct.unpack(">32q", v))
    df = spark.createDataFrame([(i, longs(x), longs(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, x array<long>, y array<long>")
    for r in df.select("i", minhash.likeness("x", "y").alias("got")).collect():
        same = sum(x == y for x, y in zip(a[r.i], b[r.i])) / 256
        assert abs(r.got - max(0.0, (same - 1 / 256) / (1 - 1 / 256))) < 1e-12


def neighbours(rows):
    ordered = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), brute(text), brute(edited), text == edited, text == after)
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, part int, tie string").repartition(parts)
    out = minhash.document_fingerprints(df).collect()
    want = neighbours(rows)
    assert len(out) == len(rows)
    for r in out:
        n, sha, own, edited, same, alike = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, own, edited)
        assert (r.near_edited == 1.0 or not same) and (r.near_next == 1.0 or not alike) and 0 <= r.near_next <= 1


def test_documents_and_their_neighbours(spark):
    draw = random.Random(8)
    texts = TEXTS + ["日本語 é " * 20, "x" * 5000]
    check(spark, [(k, draw.choice(texts)) for k in draw.sample(range(-500, 500), 60)])


def test_one_and_no_document(spark):
    check(spark, [(4, "one two three four five six seven")], 1)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.document_fingerprints(df).count() == 0


def test_a_key_of_many_rows_is_dealt_out(spark):
    rows = [(7, f"text number {i % 5} of a key that many rows share") for i in range(300)] + [(i, "other words") for i in range(5)]
    df = spark.createDataFrame(rows + [(None, None)], "doc_id long, text string").repartition(6)
    parts = minhash._placed(df, "doc_id").where("doc_id = 7").groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(parts) > 4 and max(r.n for r in parts) < 150
    out = minhash.document_fingerprints(df)
    assert out.count() == 306 and out.where("near_edited IS NULL OR near_next IS NULL OR edited_sha256 IS NULL").count() == 0
