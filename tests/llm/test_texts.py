"""Toxicity, segmentations and archives: decoding, sampling, round trips, odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import pieces, toxicity, warc
from sluice.session import scratch_path


# Toxicity -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def restorer(spark, sf):
    return toxicity.Restorer(toxicity.letter_model(spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet"), "text").tolist())


@pytest.mark.parametrize("seen, meant", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("p4th3t1c", "pathetic"), ("sssscum", "scum"), ("cl0wn!!!", "clown"),
    ("looooser", "loser"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("you m 0 r 0 n.", "you moron"), ("the&&&", "the"),
    ("tr@sh", "trash"), ("Clean words stay", "clean words stay"), ("2021", "2021"), ("", "")])
def test_restoring(restorer, seen, meant):
    assert restorer.text(seen).rstrip(".") == meant


def test_letter_grams_count_within_words():
    grams, counts = toxicity.letter_grams(["ab ab", None, "Ä1"])
    a, b = 1, 2
    want = Counter({a: 3, a * 27 + b: 2, (a * 27 + b) * 27: 2, a * 27: 1})
    assert dict(zip(grams.tolist(), counts.tolist())) == dict(want)


def test_decoding_is_the_best_path(restorer):
    """Against all readings of a short lattice."""
    model = restorer.model
    for observed in ("1d10t", "a$$", "s5e3", "b*d", "ll1"):
        readings = [("", 0.0)]
        for sign, count in toxicity._runs(observed):
            readings = [(t + e, c + x) for t, c in readings for e, x in toxicity._arcs(sign, count, False)]

        def worth(text, cost):
            at = 0
            for c in text:
                n = ord(c) - 96 if "a" <= c <= "z" else 0
                cost += model[at * 27 + n] if n or at else 0.0
                at = (at * 27 + n) % 27 ** 3 if n else 0
            return cost + (model[at * 27] if at else 0.0)

        best = max(worth(t, c) for t, c in readings)
        got = toxicity.decode(observed, model)
        assert any(t == got and math.isclose(worth(t, c), best, abs_tol=1e-9) for t, c in readings)


def toxic_table(spark):
    bad = ["idiot", "moron", "scum", "loser"]
    fill = ["the cat sat on a mat", "rain falls in the north", "we read a long book today", "numbers and words agree"]
    rows = [(i, f"{fill[i // 4 % 4]} {i} and you " + (bad[i // 16 % 4] if i % 4 == 0 else "see") + " there") for i in range(400)]
    return rows, [(i, int(i % 4 == 0)) for i in range(300)]


def test_toxicity_learns_and_sees_through_disguises(spark):
    rows, labels = toxic_table(spark)
    rows += [(1000, "what an 1d10t he is"), (1001, "such a m o r o n today"), (1002, "sssccum of the north"), (1003, None), (1004, ""),
             (None, "idiot moron"), (1005, "the cat sat " * 20000), (1006, "the cat sat on a mat")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.document_toxicity(df, known).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert all(got[i].predicted == 1 for i in (1000, 1001, 1002, None)) and all(got[i].predicted == 0 for i in (1003, 1004, 1005, 1006))
    kept = toxicity.reject(df, known)
    assert kept.columns == df.columns and kept.count() == sum(1 for r in got.values() if not r.predicted)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.document_toxicity(df, none).collect()} == {0}
    assert toxicity.document_toxicity(df.limit(0), none).count() == 0
    restored = toxicity.restored(df.withColumn("restored", F.lit(1)), "text", toxicity.Restorer(toxicity.letter_model(df, "text").tolist()))
    assert [r.restored for r in restored.collect()] == ["x", "x"]


def test_held_out_rows_are_not_learned_from(spark):
    rows, labels = toxic_table(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.document_toxicity(df, known).collect()) == sorted(toxicity.document_toxicity(df, turned).collect())


# Segmentations ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.Vocabulary.read(), 1.0)


def every_segmentation(lattices, text):
    """Probabilities of all segmentations, from the pieces' weights alone."""
    v = lattices.vocabulary
    sentence = "▁" + text.replace(" ", "▁")

    def ways(at):
        if at == len(sentence):
            return [((), 0.0)]
        out = [((v.pieces[sentence[at:end]],), end) for end in range(at + 1, len(sentence) + 1) if sentence[at:end] in v.pieces]
        if sentence[at] not in v.pieces:
            out.append((tuple(v.bytes_from + b for b in sentence[at].encode()), at + 1))
        return [(ids + rest, sum(v.log_p[i] for i in ids) + w) for ids, end in out for rest, w in ways(end)]

    found = defaultdict(float)
    for ids, weight in ways(0):
        found[ids] += math.exp(weight)
    total = sum(found.values())
    return {ids: w / total for ids, w in found.items()}


def test_sampling_without_replacement(lattices):
    want, n = every_segmentation(lattices, "the cat"), 8000
    runs = pieces.segmentations(lattices, ["the cat"] * n, [str(i) for i in range(n)], 3, 5)
    assert all(len({tuple(s[0].tolist()) for s in r}) == 3 for r in runs)
    assert all(r[0][2] > r[1][2] > r[2][2] for r in runs)
    assert all(math.isclose(math.exp(s[1]), want[tuple(s[0].tolist())], rel_tol=1e-6) for r in runs[:200] for s in r)
    first, second = (Counter(tuple(r[k][0].tolist()) for r in runs) for k in (0, 1))
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:4]:
        q = sum(o * p / (1 - o) for other, o in want.items() if other != ids)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n)
        assert abs(second[ids] / n - q) < 4 * math.sqrt(q * (1 - q) / n)
    # Inclusion scores make sums over the sample unbiased.
    estimate = sum(math.exp(s[1]) / s[3] for r in runs for s in r) / n
    assert abs(estimate - 1) < 0.01


def test_all_segmentations_are_found_once(lattices):
    want = every_segmentation(lattices, "ab é")
    (ways,) = pieces.segmentations(lattices, ["ab é"], ["k"], 100, 1)
    assert Counter(tuple(w[0].tolist()) for w in ways) == Counter(want.keys())
    assert all(w[3] == 1.0 for w in ways) and [w[2] for w in ways] == sorted((w[2] for w in ways), reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(lattices, text):
    spelled = lattices.vocabulary.texts()
    (ways,) = pieces.segmentations(lattices, [text], ["k"], 3, 2)
    assert all(pieces.decode_pieces(w[0].tolist(), spelled) == text.replace("▁", " ") for w in ways)


def test_blocks_do_not_change_results(lattices, monkeypatch):
    texts, keys = [f"some text {i} é\n" * (i % 5) for i in range(40)], [str(i) for i in range(40)]
    whole = pieces.segmentations(lattices, texts, keys, 3, 9)
    monkeypatch.setattr(pieces, "LEARN_BLOCK", 10)
    monkeypatch.setattr(pieces, "CACHED_EDGES", 1)
    fresh = pieces.Lattices(lattices.vocabulary, 1.0)
    single = [pieces.segmentations(fresh, [t], [k], 3, 9)[0] for t, k in zip(texts, keys)]
    assert [[(w[0].tolist(), round(w[2], 9)) for w in r] for r in whole] == [[(w[0].tolist(), round(w[2], 9)) for w in r] for r in single]


def test_no_piece_goes_on_behind_a_chunk(lattices):
    vocabulary = pieces.Vocabulary({"▁": 0, "a": 1, "\0": 2, "a\0": 3, "\0▁": 4}, dict.fromkeys(range(300), -1.0), 20)
    own = pieces.Lattices(vocabulary, 1.0)
    for ways in pieces.segmentations(own, ["a a\0a", "a"], ["1", "2"], 9, 3):
        assert all(4 not in w[0].tolist() for w in ways)
    assert len(ways) == 1 and ways[0][0].tolist() == [0, 1]
    assert own.edges == sum(len(c) + 1 for c in own.chunks) + 1  # one edge for each sign, one more for the piece of two


def test_encode_and_decode(spark):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, ""), (3, None), (None, "null key"), (4, "x" * 60000), (5, "a▁b"), (6, "long text " * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string")
    out = pieces.encode(df, "doc_id", "text")
    by = defaultdict(list)
    for r in out.collect():
        by[r.key].append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 6, 2: 1, 3: 1, None: 3, 4: 3, 5: 3, 6: 3}
    assert by[2][0].ids == [] and by[3][0].ids is None and by[3][0].restored is None
    assert all(r.restored for k, v in by.items() if k not in (3, 5) for r in v) and not by[5][0].restored
    twice = Counter(tuple(r.ids) for r in by[1])
    assert set(twice.values()) == {2}
    back = pieces.decode(out, "ids", "key")
    assert {r.key for r in back.collect()} >= {"Hello  world", "", None, "a b"}
    assert pieces.document_pieces(df.limit(0)).count() == 0


# Archives -----------------------------------------------------------------------------------------------------------

def page_rows():
    big = "<p>" + "many words " * 50 + "</p>"
    return [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/ b\r\nx", "short"), (4, "u", "short"), (6, "u", None),
            (7, "u", ""), (None, "u", big), (8, "u", "é" * 60000), (10, "u", "WARC/1.1\r\n\r\n" * 20), (2, "http://a/2", big)]


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id long, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.round_trip(df).collect())
    want = Counter()
    for key, _, html in page_rows():
        data = (html or "").encode()
        refers = 2 if len(data) >= 100 and key != 2 and html == page_rows()[0][2] else None
        want[key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_frames_and_index(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("page "), F.col("id")), 40).alias("html"))
    folder = scratch_path(spark, "warc")
    index = warc.write(pages, folder, frame_bytes=2000, bundle_bytes=3000)
    places = index.collect()
    assert len(places) == 300 and len({p.bundle for p in places}) > 5 and max(p.frame for p in places) > 2
    wanted = spark.createDataFrame([(7,), (255,), (999,)], "id long")
    assert {(r.record_id, r.payload.decode()) for r in warc.fetch(index, wanted).collect()} == {("7", "page 7" * 40), ("255", "page 255" * 40)}
    one = next(p for p in places if p.record_id == "42")
    frame = warc.BundleReader(one.bundle).frame(one.frame)
    row, end = warc.parse(frame, one.start)
    assert row["record_id"] == "42" and end == one.start + one.length


def test_bundles_are_plain_zstandard(spark):
    import zstandard

    pages = spark.createDataFrame(page_rows()[:4], "page_id long, url string, html string")
    index = warc.write(pages.coalesce(1), scratch_path(spark, "warc"), frame_bytes=100)
    (path,) = {r.bundle for r in index.collect()}
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\nWARC-Type") == 4 and plain.count(b"WARC-Refers-To: <urn:page:2>") == 2
    assert b"http://a/%20b%0D%0Ax" in plain


def test_cut_off_archives_are_errors():
    data = warc.record("1", "u", b"payload", "d", None)
    assert warc.parse(data)[1] == len(data)
    for bad in (data[:-3], b"x" + data):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_rare_label_is_learned(spark, monkeypatch):
    """Few toxic documents among many labelled ones, and a bound on the sample far below their number."""
    docs = [(i, f"quiet words about gardens and rivers number {i % 97} here") for i in range(4000)]
    docs += [(4000 + i, f"you are a zorgblat and nothing but a zorgblat {i}") for i in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i >= 4000)) for i, _ in docs], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 120)
    got = {r.doc_id: r.predicted for r in toxicity.document_toxicity(df, known).collect()}
    assert all(got[i] == (i >= 4000) for i in got)


def test_remembered_lattices_stay_small():
    lattices, rng = pieces.Lattices(pieces.Vocabulary.read(), 1.0), np.random.default_rng(5)
    for _ in range(14):
        lattices.places([" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (10_000, 8)))])
        assert lattices.edges < 1_400_000  # 24 bytes each, and room for as many more
