"""Near duplicates among vectors, by an epsilon grid order join.

Unit vectors are turned to their principal dimensions, sorted by the grid cells (of side epsilon) they fall into, and cut
into blocks of the sorted sequence. Intervals of the sequence are joined recursively: a pair of intervals whose boxes are
further apart than epsilon is dropped with everything below it. What is left at the bottom are pairs of blocks, and each
is one matrix product. Turning keeps distances, so boxes over the leading dimensions never lose a link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.tables import cut, hash_sample

COSINE = 0.9
LEADING = 12          # principal dimensions in grid cells and boxes
FIT_ROWS = 8192       # vectors, picked by hash, that the principal dimensions are fitted on
BLOCK_ROWS = 4096
FANOUT = 8            # intervals of the sequence that make the next larger one
CLOSE = 1e-12         # a product so near the threshold is computed again in one precise sum


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow; rows must not be zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, digest, dim, vec): vec are the float64 bytes; digest is null for vectors that link with nothing."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for item in batch.column(1):
                values = item.values.to_numpy(zero_copy_only=False).astype(np.float64) if item.is_valid else np.empty(0)
                if values.any() and np.isfinite(values).all():
                    data = (values + 0.0).tobytes()  # -0.0 becomes 0.0
                    rows.append((hashlib.sha256(data).digest(), len(values), data))
                else:
                    rows.append((None, 0, None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "digest", "dim", "vec"])

    narrow = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return narrow.mapInArrow(batches, f"key {df.schema[key].dataType.simpleString()}, digest binary, dim int, vec binary")


def _principal(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal dimensions by length of vector, from a sample of at most FIT_ROWS; longer ones stay as they are
    where the sample has fewer than two vectors of a length."""
    sample = hash_sample(distinct, ["digest"], FIT_ROWS).select("dim", "vec").toPandas()
    out = {}
    for dim, own in sample.groupby("dim"):
        if len(own) > 1:
            rows = unit(np.frombuffer(b"".join(own.vec), np.float64).reshape(-1, dim))
            values, turned = np.linalg.eigh(np.cov(rows, rowvar=False).reshape(dim, dim))
            out[int(dim)] = turned[:, np.argsort(values)[::-1][:LEADING]]
    return out


def _leading(vectors: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    """LEADING coordinates of unit vectors, and the length of the rest; distances never grow."""
    lead = vectors @ turn if turn is not None else vectors[:, :LEADING]
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
    return np.column_stack([lead, np.zeros((len(lead), LEADING - lead.shape[1])), rest])


def _blocks(distinct: DataFrame, epsilon: float) -> DataFrame:
    """(seq, low, high, dim, vids, copies, vecs): blocks of the sequence in grid order, with their boxes."""
    turns = _principal(distinct)

    def cells(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            dims = np.asarray(batch.column("dim"))
            out = np.zeros((batch.num_rows, LEADING + 1), dtype=np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                rows = np.frombuffer(b"".join(batch.column("vec")[int(i)].as_py() for i in own), np.float64).reshape(-1, dim)
                out[own] = np.floor(_leading(unit(rows), turns.get(int(dim))) / epsilon)
            ends = pa.array(np.arange(batch.num_rows + 1) * (LEADING + 1), pa.int32())
            yield batch.append_column("cell", pa.ListArray.from_arrays(ends, pa.array(out.ravel(), pa.int32())))

    def blocked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), [], 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            dim = rows[0][1]
            vecs = b"".join(r[2] for r in rows)
            lead = _leading(unit(np.frombuffer(vecs, np.float64).reshape(-1, dim)), turns.get(dim))
            row = {"part": part, "number": number, "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(),
                   "dim": dim, "vids": np.array([r[0] for r in rows], np.int64).tobytes(),
                   "copies": np.array([r[3] for r in rows], np.int64).tobytes(), "vecs": vecs}
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in source:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vid", "dim", "vec", "copies"))):
                if held and (len(held) == BLOCK_ROWS or held[0][1] != row[1]):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    kind = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("low", pa.list_(pa.float64())),
                      ("high", pa.list_(pa.float64())), ("dim", pa.int32()), ("vids", pa.binary()), ("copies", pa.binary()),
                      ("vecs", pa.binary())])
    ordered = distinct.select("vid", "dim", "copies", "vec").mapInArrow(
        cells, "vid long, dim int, copies long, vec binary, cell array<int>").repartitionByRange("dim", "cell", "vid")
    blocks = cut(ordered.sortWithinPartitions("dim", "cell", "vid").mapInArrow(
        blocked, "part int, number int, low array<double>, high array<double>, dim int, vids binary, copies binary, vecs binary"),
        "blocks")
    # One narrow row per BLOCK_ROWS vectors.
    numbers = blocks.select("part", "number").withColumn("seq", F.row_number().over(Window.orderBy("part", "number")) - 1)
    return cut(blocks.join(numbers, ["part", "number"]).drop("part", "number"), "sequence")


def _apart(a: str, b: str) -> Column:
    """The square of the distance of two boxes."""
    gaps = (F.greatest(F.lit(0.0), F.col(f"{a}.low")[i] - F.col(f"{b}.high")[i], F.col(f"{b}.low")[i] - F.col(f"{a}.high")[i])
            for i in range(LEADING + 1))
    return reduce(lambda x, y: x + y, (g * g for g in gaps))


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) with a <= b: pairs of blocks whose boxes are within epsilon, found from the whole sequence downwards."""
    boxes = blocks.select("seq", "low", "high", "dim")
    last = boxes.agg(F.max("seq")).first()[0]
    levels = max(1, math.ceil(math.log(max(last or 0, 1) + 1, FANOUT)))

    def level(n: int) -> DataFrame:
        width = FANOUT ** n
        bounds = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(LEADING + 1)]
        bounds += [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(LEADING + 1)]
        return (boxes.groupBy(F.floor(F.col("seq") / width).alias("at")).agg(*bounds, F.min("dim").alias("d0"), F.max("dim").alias("d1"))
                .select("at", F.floor(F.col("at") / FANOUT).alias("above"),
                        F.struct(F.array(*(f"l{i}" for i in range(LEADING + 1))).alias("low"),
                                 F.array(*(f"h{i}" for i in range(LEADING + 1))).alias("high"), "d0", "d1").alias("box")))

    pairs = level(levels).select(F.col("at").alias("a"), F.col("at").alias("b"))
    for n in reversed(range(levels)):
        side = level(n)
        x = side.select(F.col("at").alias("a1"), F.col("above").alias("a"), F.col("box").alias("x"))
        y = side.select(F.col("at").alias("b1"), F.col("above").alias("b"), F.col("box").alias("y"))
        pairs = cut(pairs.join(x, "a").join(y, "b").where(
            (F.col("a1") <= F.col("b1")) & (F.col("x.d0") <= F.col("y.d1")) & (F.col("y.d0") <= F.col("x.d1"))
            & (_apart("x", "y") <= epsilon * epsilon + 1e-9)).select(F.col("a1").alias("a"), F.col("b1").alias("b")), "pairs")
    return pairs


def linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of `left` and `right` have at least this cosine."""
    product = left @ right.T
    out = product >= cosine
    for i, j in zip(*np.nonzero(np.abs(product - cosine) < CLOSE)):
        out[i, j] = math.fsum(left[i] * right[j]) >= cosine
    return out


def _compare(ids: tuple, copies: tuple, units: tuple, same: bool, cosine: float) -> tuple[dict, list]:
    """Numbers of linked rows by id, and links that connect what the block pair connects: at most one for each row."""
    (ids_a, ids_b), (copies_a, copies_b), (left, right) = ids, copies, units
    counts, links, group = {}, [], np.arange(len(ids_b))
    total_b = np.zeros(len(ids_b), dtype=np.int64)
    for start in range(0, len(ids_a), 512):
        mask = linked(left[start:start + 512], right, cosine)
        if same:
            mask[np.arange(len(mask)), np.arange(start, start + len(mask))] = False
        total_a = mask @ copies_b
        total_b += copies_a[start:start + 512] @ mask
        for i in np.flatnonzero(total_a):
            counts[int(ids_a[start + i])] = int(total_a[i])
            columns = np.flatnonzero(mask[i])
            met, first = np.unique(group[columns], return_index=True)
            if same:
                own = group[start + i]
                if len(met) == 1 and met[0] == own:
                    continue
                first, met = first[met != own], np.append(met, own)
            links += [(int(ids_a[start + i]), int(ids_b[columns[f]])) for f in first]
            if len(met) > 1:
                group[np.isin(group, met)] = met.min()
    if not same:
        for j in np.flatnonzero(total_b):
            counts[int(ids_b[j])] = int(total_b[j])
    return counts, links


def _compared(blocks: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """(u, v, n): with v null, u has n linked rows in one pair of blocks; else a link."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                a, b, dim, *data = (batch.column(c)[i].as_py() for c in
                                    ("a", "b", "dim", "vids", "vids_b", "copies", "copies_b", "vecs", "vecs_b"))
                whole = [np.frombuffer(x, np.int64) for x in data[:4]]
                units = tuple(unit(np.frombuffer(x, np.float64).reshape(-1, dim)) for x in data[4:])
                counts, links = _compare(whole[:2], whole[2:], units, a == b, cosine)
                u = list(counts) + [x for x, _ in links]
                v = [None] * len(counts) + [y for _, y in links]
                n = list(counts.values()) + [None] * len(links)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, n)], ["u", "v", "n"])

    one = blocks.select(F.col("seq").alias("a"), "dim", "vids", "copies", "vecs")
    two = blocks.select(F.col("seq").alias("b"), F.col("dim").alias("dim_b"), F.col("vids").alias("vids_b"),
                        F.col("copies").alias("copies_b"), F.col("vecs").alias("vecs_b"))
    matched = pairs.join(one, "a").join(two, "b").where("dim = dim_b")
    return cut(matched.mapInArrow(batches, "u long, v long, n long"), "compared")


def near_duplicates(df: DataFrame, key: str, vector: str, cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component, kept) of every row.

    n_links counts the other rows whose vectors have at least this cosine (0 < cosine <= 1) with the row's vector, equal
    vectors included; component is the smallest key that links reach; kept marks the rows with that key. Vectors that are
    null, empty or zero, or hold null, NaN or infinite parts, link with nothing, and vectors of different lengths never
    link. A null key is counted but is never the smallest; its row is not kept. Repeated rows link with each other and are
    kept together. An empty table gives no rows. Equal vectors are compared once, however many rows have them; a pair of
    blocks gives counts and a spanning set of links, never all pairs.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    epsilon = math.sqrt(2 - 2 * cosine) or 1e-9
    rows = cut(_prepared(df, key, vector), "vectors")
    distinct = cut(rows.where(F.col("digest").isNotNull()).groupBy("digest", "dim").agg(
        F.min("key").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        .withColumn("vid", F.monotonically_increasing_id()), "distinct")
    blocks = _blocks(distinct, epsilon)
    compared = _compared(blocks, _block_pairs(blocks, epsilon), cosine)
    counted = compared.where(F.col("v").isNull()).groupBy(F.col("u").alias("vid")).agg(F.sum("n").alias("n"))
    member = components(compared.where(F.col("v").isNotNull()).select("u", "v")).withColumnRenamed("node", "vid")
    known = cut(distinct.drop("vec").join(counted, "vid", "left").join(member, "vid", "left").select(
        "digest", "least", F.coalesce("root", "vid").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    reached = known.groupBy("root").agg(F.min("least").alias("component"))
    by_digest = known.join(reached, "root").select("digest", "n_links", "component")
    return rows.join(by_digest, "digest", "left").select(
        "key", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component")).alias("component")).withColumn(
        "kept", F.coalesce(F.col("key") == F.col("component"), F.lit(False)))


def embedding_groups(embeddings: DataFrame) -> DataFrame:
    """Links and components of all embeddings by cosine 0.9."""
    return near_duplicates(embeddings.select("vec_id", "embedding"), "vec_id", "embedding").withColumnsRenamed(
        {"key": "vec_id", "component": "component_id"})


EMBEDDING_GROUPS_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda v: coalesce(isfinite(v), false)))
    AND list_bool_or(list_transform(embedding, lambda v: v <> 0))),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9),
r(vec_id, reached) AS (SELECT u, v FROM l UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.reached = l.u),
m AS (SELECT vec_id, min(reached) AS low FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""
