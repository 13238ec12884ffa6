"""Contiguous shards of equal bytes, from a global prefix sum.

Rows are range-partitioned along a total order. Each partition sums its own bytes, the totals (one row per partition)
give every partition its offset, and a row's global byte position says which of the equal targets it falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import cut, text_bytes


def assign(df: DataFrame, shards: int, size: Column, order: list[str]) -> DataFrame:
    """The rows of `df` with `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard).

    The law is equal bytes: with B the bytes of all rows, row i goes where the middle of its byte interval falls among
    the targets B/shards, 2B/shards, ... Shards are contiguous in `order`, and each differs from B/shards by at most the
    largest row. A row larger than a target can leave a neighbouring shard empty.

    `size` must not be null or negative. Rows equal in `order` keep the order in which they are read, so one key that
    holds a third of the rows is cut like any other. Nulls sort first. All sizes zero: everything is in shard 0. An
    empty table gives no rows. Columns `shard` and `slot` of the input are replaced; no other name can clash. Pass a
    narrow frame and join wide columns afterwards: the rows are shuffled twice.
    """
    keys = [f"k{i}" for i in range(len(order))] + ["tie"]
    ranged = (df.select(F.struct("*").alias("row"), size.cast("long").alias("size"),
                        *(F.col(c).alias(f"k{i}") for i, c in enumerate(order)),
                        F.monotonically_increasing_id().alias("tie"))
              .repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut(ranged.select("row", "size", "part", (F.sum("size").over(inside) - F.col("size")).alias("before"),
                              (F.count("*").over(inside) - 1).alias("rank")), "shard")

    # One row per partition: its size is the number of partitions, whatever the number of rows.
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    everything = totals.agg(F.sum("bytes").alias("total"))
    middle = (F.lit(2) * (F.col("before") + F.col("bytes_before")) + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.coalesce(
        F.floor(middle * shards / F.nullif(F.lit(2) * F.col("total"), F.lit(0)).cast("decimal(20,0)")), F.lit(0)))
    placed = (local.join(F.broadcast(offsets), "part").crossJoin(F.broadcast(everything))
              .select("row", shard.cast("int").alias("shard"), (F.col("rank") + F.col("rows_before")).alias("at")))
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))  # one row per shard
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    return (placed.join(F.broadcast(starts), "shard")
            .select(*(F.col("row")[c].alias(c) for c in kept), "shard", (F.col("at") - F.col("start")).alias("slot")))


def write(df: DataFrame, path: str) -> None:
    """Write assigned rows as one folder per shard, rows in slot order within files.

    A shard is spread over tasks by ranges of its slots, so no task holds a whole shard.
    """
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Every document with the bytes and checksum of its text, its shard and its slot, in order of doc_id.

    A null text counts as an empty one: size 8, checksum 0. Rows that share a doc_id are ordered by checksum and size.
    """
    narrow = documents.select("doc_id", (text_bytes("text") + 8).alias("size"),
                              F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(narrow, shards, F.col("size"), ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 has no SQL function there: the checksum is folded over the bytes, with a table made by its rule.
DOCUMENT_SHARDS_SQL = """
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, length(h) // 2 + 8 AS size, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::BIGINT)),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS text_crc32
      FROM d, crc),
o AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM s
      WINDOW w AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(23, (2 * before + size) * 24 // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
       NULL::INT AS grown_shard
FROM p
"""
