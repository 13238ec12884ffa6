"""Conversation prefix trie: identical rebuilt conversations collapse into weighted sequences, leaves are the sequences
that no other goes beyond, and prefixes of the weighted sequences add up to the nodes of the trie.

A prefix is known by its length and the exclusive or of 120-bit digests of its turns, each digest taken together with the
place of the turn. So prefixes come out of running values, which are computed over ranges of the table: neither a long
conversation nor one that a third of all rows repeat has to meet in one task. From the collapse on, a sequence is handled
once, with its weight, however many conversations are equal to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import cut

NODE = ["depth", "a", "b"]  # what identifies a node
_CHUNK = 4096  # members joined into one string before they are hashed


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, tuple[Callable, Column]], label: str) -> DataFrame:
    """The rows of `df` with the values of all earlier rows of the same key, in this order; before the first row they are 0.

    `values` names columns and gives (F.sum or F.bit_xor, column). Rows equal in `order` keep the order in which they are
    read. Rows are dealt out by ranges of key and order, so one key may be spread over all tasks: a task's rows are added
    up on their own, and the totals of keys that go over the edge of a task (at most one for each task) supply what came
    before. Keys must not be null.
    """
    placed = cut(df.withColumn("tie", F.monotonically_increasing_id())
                 .withColumns({f"o{i}": c for i, (_, c) in enumerate(values.values())})
                 .repartitionByRange(F.col(key), *order, F.col("tie")).withColumn("part", F.spark_partition_id()), label)
    inside = Window.partitionBy("part", key).orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumns({name: F.coalesce(fn(f"o{i}").over(inside), F.lit(0))
                               for i, (name, (fn, _)) in enumerate(values.items())})
    # One row for each task, then the totals of the keys that end a task: their number is bounded by the tasks.
    edges = placed.groupBy("part").agg(F.max(key).alias(key)).select(key).distinct()
    totals = placed.join(F.broadcast(edges), key, "left_semi").groupBy(key, "part").agg(
        *(fn(f"o{i}").alias(f"t{i}") for i, (fn, _) in enumerate(values.values())))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "part", *(F.coalesce(fn(f"t{i}").over(earlier), F.lit(0)).alias(f"c{i}")
                                           for i, (fn, _) in enumerate(values.values())))
    whole = here.join(F.broadcast(carried), [key, "part"], "left")
    merged = {name: (F.col(name).bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) if fn is F.bit_xor
                     else F.col(name) + F.coalesce(f"c{i}", F.lit(0)))
              for i, (name, (fn, _)) in enumerate(values.items())}
    return whole.withColumns(merged).select(*df.columns, *values)


def rebuild(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            group: int = 100, shared: int = 6) -> DataFrame:
    """(key, place, item, size) of every turn of every rebuilt conversation, and (key, null, null, null) once for every key.

    Conversation c takes the first h turns of conversation c - c % group (all if it has fewer, none if it is not there),
    then its own turns after its first h; h is the unsigned CRC-32 of the decimal c, modulo `shared`. Turns are ordered by
    turn, nulls first; equal turns by role, then by the digest of the text. A null role or text is an empty one. Rows
    without a conversation id belong to no conversation and are left out. `item` is the SHA-256 of role and text, `size`
    the number of code points of the text. Repeated rows are turns like any others.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    label = F.coalesce(F.col(role), F.lit(""))
    narrow = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("key"), F.col(turn).alias("turn"), label.alias("role"),
        F.sha2(words, 256).alias("digest"), F.length(words).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # The length of the role keeps role and text apart.
    item = F.sha2(F.concat_ws(":", F.length("role"), "role", "digest"), 256)
    own = cut(running(narrow, "key", order, {"place": (F.sum, F.lit(1))}, "turns")
              .select("key", "place", item.alias("item"), "size"), "places")

    taken = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(shared))
    above = F.col("key") - F.col("key") % group
    heads = own.where((F.col("place") < shared - 1) & (F.col("key") % group == 0)).withColumnRenamed("key", "above")
    keys = own.where("place = 0").select("key")
    begun = keys.select("key", above.alias("above"), taken.alias("h")).join(heads, "above").where("place < h")
    lengths = heads.groupBy("above").agg(F.count("*").alias("length"))
    rest = own.select("*", above.alias("above"), taken.alias("h")).where("place >= h").join(lengths, "above", "left")
    moved = F.col("place") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))
    nothing = keys.select("key", *(F.lit(None).cast(t).alias(c) for c, t in
                                   (("place", "long"), ("item", "string"), ("size", "long"))))
    return (begun.select("key", "place", "item", "size")
            .union(rest.select("key", moved.alias("place"), "item", "size")).union(nothing))


def _half(digest: Column, half: int) -> Column:
    """Sixty bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1 + 15 * half, 15), 16, 10).cast("long")


def _members(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending decimal keys of each node, joined by commas.

    Ranges of sorted keys are joined into strings of some thousand, which the task of a node takes in one by one.
    """
    kind = "depth long, a long, b long, first long, keys string"

    def joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in source:
            out = []
            for *now, key in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (now != node or len(held) == _CHUNK):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = now
                held.append(key)
            yield _batch(out)
        yield _batch([(*node, held[0], ",".join(map(str, held)))] if held else [])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["depth", "a", "b", "first", "keys"])

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*NODE, "ends_sha256"])

        node, state = None, None
        for batch in source:
            out = []
            for *now, keys in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if now != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(keys.encode())
                else:
                    state.update(b"," + keys.encode())
            yield done(out)
        yield done([(*node, state.hexdigest())] if state else [])

    ranged = ends.select(*NODE, "key").repartitionByRange(*NODE, "key").sortWithinPartitions(*NODE, "key")
    strings = ranged.mapInArrow(joined, kind)
    return strings.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        hashed, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for every node of the trie of sequences: every different beginning of a sequence, from the empty one on.

    `rows` has (key, place, item, size): the items of each sequence at places 0, 1, ... and their sizes; a row with null
    place adds a key without items. Returned: key (smallest member), depth, parent_key (null at the root), n_members,
    n_children, n_leaves (childless nodes of the subtree), saved (over the subtree, members less one times the size of the
    node's last item) and ends_sha256 (over the members that end here). No rows give no nodes.
    """
    together = F.sha2(F.concat(F.col("place"), F.lit(":"), F.col("item")), 256)  # null without a place
    items = cut(rows.select("key", "place", "size", _half(together, 0).alias("x"), _half(together, 1).alias("y")), "items")

    # Whole sequences, then equal ones collapsed.
    wholes = cut(items.groupBy("key").agg(
        F.count("place").alias("depth"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("a"),
        F.coalesce(F.bit_xor("y"), F.lit(0)).alias("b"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")), "wholes")
    sequences = cut(wholes.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("key").alias("key"),
                                              F.min("total").alias("total")), "sequences")

    # Every prefix of every different sequence. `below` is the size of the items from this node's own on.
    listed = items.where("place IS NOT NULL").join(sequences.select("key", "weight", "total"), "key")
    steps = running(listed, "key", [F.col("place")], {"up_a": (F.bit_xor, F.col("x")), "up_b": (F.bit_xor, F.col("y")),
                                                      "passed": (F.sum, F.col("size"))}, "listed")
    roots = sequences.select("key", "weight", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"),
                             F.lit(0).cast("long").alias("b"), *(F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")),
                             F.col("total").alias("below"))
    prefixes = cut(steps.select(
        "key", "weight", (F.col("place") + 1).alias("depth"), F.col("up_a").bitwiseXOR(F.col("x")).alias("a"),
        F.col("up_b").bitwiseXOR(F.col("y")).alias("b"), "up_a", "up_b",
        (F.col("total") - F.col("passed")).alias("below")).union(roots), "prefixes")

    # Sequences that are proper prefixes of others go; the rest end in leaves.
    proper = prefixes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"),
                                                F.col("up_b").alias("b")).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("key", F.lit(1).alias("leaf"))

    # Weighted prefixes add up. Sizes of members: each of them counts with all that it has from the node on.
    nodes = cut(prefixes.join(leaves, "key", "left").groupBy(*NODE).agg(
        F.min("key").alias("key"), F.sum("weight").alias("n_members"), F.count("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("below")).alias("all_sizes"), F.min_by("below", "key").alias("below"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    # Sizes of different nodes: a node belongs to the sequence of its smallest member, and a sequence owns the end of its
    # path, so what it adds to a node above is the size of its own nodes from there on.
    owners = nodes.groupBy("key").agg(F.min("depth").alias("from"), F.min_by("below", "depth").alias("owned"))
    once = prefixes.join(owners, "key").groupBy(*NODE).agg(
        F.sum(F.when(F.col("depth") >= F.col("from"), F.col("below")).otherwise(F.col("owned"))).alias("node_sizes"))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    known = cut(nodes.join(children, NODE, "left").join(once, NODE).join(_members(wholes), NODE, "left"), "known")

    # A parent with very many children is one row on the right, so its children are split by skew handling.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           F.col("key").alias("parent_key"))
    return known.join(parents, ["depth", "up_a", "up_b"], "left").select(
        "key", "depth", "parent_key", "n_members", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("all_sizes") - F.col("node_sizes")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations, under the names of conversations."""
    return trie(rebuild(conversations)).select(
        F.col("key").alias("conv_id"), "depth", F.col("parent_key").alias("parent_conv_id"), F.col("n_members").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


# CRC-32 is folded over the digits with a table made by its rule; a node is its list of turns.
CONVERSATION_TRIE_SQL = """
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
turns AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS item,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS at
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS above, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(length(c::VARCHAR)), lambda i: ascii((c::VARCHAR)[i+1])::BIGINT)),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
seqs AS (
  SELECT v.c, v.h, coalesce((SELECT list(b.item ORDER BY b.at) FROM turns b WHERE b.c = v.above AND b.at < v.h), [])
           || coalesce((SELECT list(o.item ORDER BY o.at) FROM turns o WHERE o.c = v.c AND o.at >= v.h), []) AS p
  FROM convs v),
nodes AS (
  SELECT p[1:d] AS path, d, min(c) AS c, count(*) AS n, max(length(p[d].x)) AS size,
         list(c ORDER BY c) FILTER (len(p) = d) AS ends
  FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM seqs) GROUP BY ALL),
named AS (SELECT *, row_number() OVER () AS id FROM nodes),
up AS (SELECT u.id, u.c, u.path, p.id AS parent, p.c AS parent_c FROM named u
       LEFT JOIN named p ON u.d > 0 AND p.d = u.d - 1 AND p.path = u.path[1:u.d - 1]),
kids AS (SELECT parent AS id, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY 1),
chain(id, top) AS (
  SELECT id, id FROM up
  UNION ALL
  SELECT chain.id, up.parent FROM chain JOIN up ON up.id = chain.top WHERE up.parent IS NOT NULL),
sums AS (
  SELECT chain.top AS id, count(*) FILTER (kids.id IS NULL) AS leaves, sum((u.n - 1) * coalesce(u.size, 0)) AS saved
  FROM chain JOIN named u ON u.id = chain.id LEFT JOIN kids ON kids.id = chain.id GROUP BY 1)
SELECT named.c AS conv_id, named.d AS depth, up.parent_c AS parent_conv_id, named.n AS n_convs,
       coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens,
       sha256(coalesce(array_to_string(named.ends, ','), '')) AS ends_sha256
FROM named JOIN up USING (id) JOIN sums USING (id) LEFT JOIN kids USING (id)
"""
