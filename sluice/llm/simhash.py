"""SimHash fingerprints, and near duplicates by BK-trees over shards of fingerprints.

Fingerprints that differ in at most two bits agree on at least two of four 16-bit bands, so a shard for every pair of
bands and every value of the two finds each link, and distant fingerprints never meet. In each shard a BK-tree (children
keyed by their distance to the parent) is built and asked, following only edges within the radius. A shard that is still
large is dealt again by pairs of the 8-bit quarters of its other 32 bits, after which it cannot hold more than 2**16
fingerprints; this is the proven bound on a tree. A tree is handed to the one task that has the queries of its shard:
broadcasting the trees of all shards to all tasks would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.tables import cut, whole_row

SEED = 42
RADIUS = 2
SHARD_ROWS = 1024
_PAIRS = list(combinations(range(4), 2))


def fingerprint(text: bytes | None, words_per_shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer; 0 for null and for texts without a word.

    A-Z is lower-cased, words end at ASCII white space, every occurrence of a shingle counts, and a bit is set if more
    than half of the shingle hashes have it. A text of fewer words is one shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i:i + 4096].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str, text: str, words_per_shingle: int = 3) -> DataFrame:
    """(key, fp) for every row."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            marks = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["key", "fp"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(batches, f"key {df.schema[key].dataType.simpleString()}, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius; by the triangle inequality no other edge can lead to one."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.children[node]
            for edge in range(max(1, distance - radius), distance + radius + 1):
                if edge in below:
                    stack.append(below[edge])
        return found

    def add(self, value: int) -> None:
        """Add a value that the tree does not hold yet."""
        self.values.append(value)
        self.children.append({})
        node, new = 0, len(self.values) - 1
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what the radius connects: at most one for each value."""
    tree, leader, links = BKTree(), [], []
    for number, value in enumerate(values):
        leader.append(number)
        for near in tree.within(value, radius):
            a, b = number, near
            while leader[a] != a:
                a = leader[a]
            while leader[b] != b:
                leader[b] = leader[leader[b]]
                b = leader[b]
            if a != b:
                leader[max(a, b)] = min(a, b)
                links.append((value, values[near]))
        tree.add(value)
    return links


def _slices(fp: Column, width: int, picked: tuple[int, int]) -> Column:
    """Two of the `width`-bit slices of a fingerprint, side by side."""
    mask = (1 << width) - 1
    high, low = (F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long")) for i in picked)
    return F.shiftleft(high, width).bitwiseOR(low)


def _shards(distinct: DataFrame) -> DataFrame:
    """(shard, fp): every fingerprint in each shard where it may have a link; shards of one fingerprint are left out."""
    def dealt(df: DataFrame, bits: Column, width: int, *before: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("pair"), _slices(bits, width, p).alias("band")) for i, p in enumerate(_PAIRS)))
        return df.select("fp", *before, F.explode(keys).alias("s")).select(
            "fp", F.struct(*before, "s.pair", "s.band").alias("shard"))

    def sized(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shard")

    first = cut(sized(dealt(distinct.select("fp"), F.col("fp"), 16)), "bands")
    small = first.where(F.col("n") <= SHARD_ROWS).select(
        "fp", "shard.pair", "shard.band", F.lit(-1).alias("pair2"), F.lit(0).cast("long").alias("band2"))
    # The other two bands of a large shard, as 32 bits.
    others = F.coalesce(*(F.when(F.col("shard.pair") == i, _slices(F.col("fp"), 16, tuple({0, 1, 2, 3} - set(p))))
                          for i, p in enumerate(_PAIRS)))
    large = first.where(F.col("n") > SHARD_ROWS).select("fp", F.col("shard").alias("outer"), others.alias("rest"))
    again = sized(dealt(large, F.col("rest"), 8, "outer")).select(
        "fp", "shard.outer.pair", "shard.outer.band", F.col("shard.pair").alias("pair2"), F.col("shard.band").alias("band2"))
    return small.union(again).select(F.struct("pair", "band", "pair2", "band2").alias("shard"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) pairs of different fingerprints that connect what links of at most `radius` bits connect."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"shards of two in four bands are complete for a radius of 0 to {RADIUS}")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard; the last shard of a batch may go on in the next one.
        def out(groups: list[np.ndarray]) -> pa.RecordBatch:
            pairs = [p for g in groups for p in spanning_links([int(v) for v in g], radius)]
            u, v = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([np.array(x, np.uint64).view(np.int64) for x in (u, v)], ["u", "v"])

        held_key, held = None, np.empty(0, np.uint64)
        for batch in source:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            values = np.asarray(batch.column(4)).astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            groups = np.split(values, starts[1:])
            if held_key is not None:
                if (keys[0] == held_key).all():
                    groups[0] = np.concatenate([held, groups[0]])
                else:
                    groups.insert(0, held)
            held_key, held = keys[-1], groups.pop()
            yield out(groups)
        yield out([held])

    shards = _shards(distinct)
    sorted_rows = shards.repartition("shard").sortWithinPartitions("shard").select("shard.*", "fp")
    return sorted_rows.mapInArrow(batches, "u long, v long")


def groups(df: DataFrame, key: str, text: str, words_per_shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component) for every row: component is the smallest key that links of at most `radius` bits reach.

    Equal fingerprints are linked; a fingerprint of zero is linked like any other. Rows repeat as they do in `df`. A null
    key has a fingerprint and a component, but is never the smallest one; a component of null keys only is null. An empty
    table gives no rows.
    """
    marked = cut(fingerprints(df, key, text, words_per_shingle), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    member = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(component, "root").select("fp", "component")
    return marked.join(by_fp, "fp").select("key", "fp", "component")


def document_groups(documents: DataFrame) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every document, by 3-word shingles and two bits."""
    found = groups(documents.select("doc_id", "text"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


def keep_one(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `df` without near duplicates: of each component the row with the smallest key stays.

    Ties of the smallest key (repeated rows) leave the one that is read first. Rows with a null key stay only where their
    component has no other.
    """
    rows = cut(whole_row(df, F.col(key).alias("key"), F.col(text).alias("text"),
                         F.monotonically_increasing_id().alias("number")), "rows")
    found = groups(rows.select("number", "text"), "number", "text")
    keyed = rows.select("number", "key").join(found.select(F.col("key").alias("number"), "component"), "number")
    first = keyed.groupBy("component").agg(F.min_by("number", F.struct(F.col("key").isNull(), "key", "number")).alias("number"))
    return rows.select("row", "number").join(first.select("number"), "number", "left_semi").select("row.*")
