"""Spelling variants: the vocabulary acceptor, composed with a one-edit transducer and with itself.

Two words one edit apart agree on their first or on their last half. So the vocabulary is dealt out by the state that a
shared half leads to: by first halves for pairs that differ behind, by last halves for pairs that differ in front. The
words of a partition go on from the same initial state; what is left of them becomes a minimised acceptor, which is
composed with the transducer and with itself, and the pairs that the composition accepts are the near words. A partition
that is still large is dealt again by halves of what is left of its words, down to single code points, so what one task
holds is bounded by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import broadcast_if_small, cut

RUN = r"[A-Za-zÀ-ÿ]"
PARTITION_WORDS = 4096  # a larger partition is dealt again; no result depends on it
MAX_ROUNDS = 64


def vocabulary(df: DataFrame, key: str, text: str, min_length: int = 6, min_count: int = 5, drop_every: int = 199) -> DataFrame:
    """(word, n): the words of all texts, with how often they occur.

    Words are longest runs of Latin letters, A-Z lower-cased. With h the unsigned CRC-32 of `<key>:<run>`, a run loses its
    code point h % length where `drop_every` divides h. Runs may be of any length. Null and empty texts have no words; a
    null key counts as an empty one. Words of fewer than `min_length` code points or `min_count` occurrences are left out.
    """
    # A run never grows, so shorter ones need not be looked at.
    runs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                     F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{min_length},}})"))).alias("raw"))
    upper, lower = ("".join(chr(base + i) for i in range(26)) for base in (65, 97))
    folded = F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", upper, lower))
    marked = runs.select("key", folded.alias("run")).select("run", F.crc32(F.concat_ws(":", "key", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(
        F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return marked.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(
        (F.length("word") >= min_length) & (F.col("n") >= min_count))


class Acceptor:
    """The minimised acceptor of sorted, different words. Arcs carry the number of words that come before theirs, so a path
    spells the number of its word."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._words: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def settle(keep: int) -> None:
            while len(path) > keep:
                arcs, final = path.pop()
                mark = (final, *arcs.items())
                state = known.get(mark)
                if state is None:
                    state = known[mark] = self._state(arcs, final)
                if path:
                    path[-1][0][last[len(path) - 1]] = state

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            settle(same + 1)
            path.extend(({}, False) for _ in word[same:])
            path[-1] = (path[-1][0], True)
            last = word
        settle(0)
        self.start = len(self.arcs) - 1

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        before, numbered = int(final), {}
        for letter, state in arcs.items():
            numbered[letter] = (state, before)
            before += self._words[state]
        self.arcs.append(numbered)
        self.final.append(final)
        self._words.append(before)
        return len(self.arcs) - 1


def one_edit_pairs(acceptor: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers of the words that the acceptor, the one-edit transducer and the acceptor accept together, each pair once.

    A state is the states of both acceptors, whether the edit is done, the numbers read so far, and a letter that must not
    follow: a letter taken out of a run of equal ones is always the last of the run.
    """
    arcs, final = acceptor.arcs, acceptor.final

    def alive(p: int, q: int) -> bool:
        return final[p] and final[q] or not arcs[p].keys().isdisjoint(arcs[q])

    stack = [(acceptor.start, acceptor.start, False, 0, 0, "")]
    while stack:
        p, q, edited, i, j, barred = stack.pop()
        if edited:
            if final[p] and final[q]:
                yield i, j
            ours, theirs = arcs[p], arcs[q]
            for letter in ours.keys() & theirs.keys():
                if letter != barred:
                    (a, m), (b, n) = ours[letter], theirs[letter]
                    stack.append((a, b, True, i + m, j + n, ""))
            continue
        steps = list(arcs[p].items())
        for number, (letter, (a, m)) in enumerate(steps):
            stack.append((a, a, False, i + m, i + m, ""))
            if alive(a, p):
                stack.append((a, p, True, i + m, i, letter))
            for _, (b, n) in steps[number + 1:]:
                if alive(a, b):
                    stack.append((a, b, True, i + m, i + n, ""))


def _halves(rest: Column, size: Column, key: Column) -> Column:
    """The two partitions of a word: by its first half with its end left over, and by its last half with its beginning.

    `size` is the length of the longer words of the partition; halves are measured on it, for longer and shorter alike.
    """
    front, back = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")
    left = F.length(rest) - back
    return F.array(
        F.struct(F.concat(key, F.lit(">"), F.substring(rest, F.lit(1), front)).alias("key"),
                 F.substring(rest, front + 1, F.length(rest)).alias("rest"), (size - front).alias("size")),
        F.struct(F.concat(key, F.lit("<"), F.substring(rest, left + 1, back)).alias("key"),
                 F.substring(rest, F.lit(1), left).alias("rest"), (size - back).alias("size")))


def _partitions(words: DataFrame, limit: int) -> DataFrame:
    """(key, size, rest, word, n): every word in the partitions where it may have a near word."""
    whole = F.col("word")
    # Pairs belong to the length of their longer word, so a word is among those of its length and among those one longer.
    parts = words.select("word", "n", F.explode(F.array(F.length(whole), F.length(whole) + 1)).alias("size"))
    dealt = cut(parts.select("word", "n", F.explode(_halves(whole, F.col("size"), F.col("size").cast("string"))).alias("s"))
                .select("s.*", "word", "n"), "partitions")
    done = []
    while True:
        large = cut(dealt.where("size > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
                    .select("key"), "large")
        if large.isEmpty():
            break
        side = broadcast_if_small(large)
        done.append(dealt.join(side, "key", "left_anti"))
        again = dealt.join(side, "key", "left_semi")
        dealt = cut(again.select("word", "n", F.explode(_halves(F.col("rest"), F.col("size"), F.col("key"))).alias("s"))
                    .select("s.*", "word", "n"), "partitions")
    for part in done:
        dealt = dealt.unionByName(part)
    return dealt


def near_words(words: DataFrame, limit: int = PARTITION_WORDS) -> DataFrame:
    """(word, n, near, near_n) for every two words of `words` (word, n) one edit apart, in both directions.

    Words must be different and not null; any code points will do. No words, no rows.
    """
    kind = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        size = group[0][1]
        if len(group) > 1 and any(len(r[2]) == size for r in group):
            for i, j in one_edit_pairs(Acceptor([r[2] for r in group])):
                x, y = group[i], group[j]
                if len(x[2]) == size or len(y[2]) == size:
                    yield x[3], x[4], y[3], y[4]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key and rest; the last partition of a batch may go on in the next one.
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        held: list[tuple] = []
        for batch in source:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found.extend(pairs(held))
                    held = []
                    if len(found) > 10000:
                        yield out(found)
                        found = []
                held.append(row)
            yield out(found)
        yield out(list(pairs(held)) if held else [])

    sorted_rows = _partitions(words, limit).select("key", "size", "rest", "word", "n").repartition("key").sortWithinPartitions("key", "rest")
    # A pair may agree on both halves, and then comes out twice.
    once = cut(sorted_rows.mapInArrow(batches, "word string, n long, near string, near_n long").distinct(), "near")
    return once.union(once.select("near", "near_n", "word", "n"))


def groups(words: DataFrame, ratio: int = 5, limit: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `words` (word, n).

    `form` is the near word that occurs most often (of equal ones the smallest), if it does so at least `ratio` times as
    often as the word; else null. `root` is where forms lead in the end. `ratio` is at least 2, so forms never go in a
    circle.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    near = near_words(words, limit).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    known = cut(near.select("word", "n_near", F.when(frequent, F.col("best.near")).alias("form"),
                            F.when(frequent, -F.col("best.less")).alias("form_n")), "forms")
    # Each round doubles the steps taken; every step multiplies the count, so there are few.
    up = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(MAX_ROUNDS):
        further = cut(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"no roots after {MAX_ROUNDS} rounds")
    return words.select("word", "n").join(known, "word", "left").join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def document_variants(documents: DataFrame) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return groups(cut(vocabulary(documents, "doc_id", "text"), "vocabulary"))


# CRC-32 is folded over the bytes with a table made by its rule; near words meet where one of their letters is left out.
DOCUMENT_VARIANTS_SQL = """
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2*i+1:2*i+2])::BIGINT)),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc),
vocab AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
gaps AS (SELECT word, n, i, word[1:i] || word[i+2:] AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, g.n, v.word, v.n FROM gaps g JOIN vocab v ON g.less = v.word
  UNION SELECT v.word, v.n, g.word, g.n FROM gaps g JOIN vocab v ON g.less = v.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY ALL),
forms AS (
  SELECT vocab.word, CASE WHEN near_n >= 5 * vocab.n THEN near END AS form, vocab.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * vocab.n THEN near_n END AS form_n
  FROM vocab LEFT JOIN best USING (word)),
walk(word, place, steps) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL)
SELECT forms.word, form, (SELECT last(place ORDER BY steps) FROM walk WHERE walk.word = forms.word) AS root, n, n_near, form_n
FROM forms
"""
