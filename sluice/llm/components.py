"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import cut


def _toward_minimum(links: DataFrame) -> DataFrame:
    """Links (u, v) -> links (u, v, low): `low` is the smallest of u and all v beside it.

    The minimum is combined before the shuffle, and the join has one row per u on its right, so a node with very many
    links is split by skew handling, never gathered.
    """
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    return links.join(low, "u").select("u", "v", F.least("u", "low").alias("low"))


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `links` (u, v): root is the smallest node of its component.

    Links may point either way, repeat, or tie a node to itself; such rows change nothing, and a node with only a link
    to itself is left out, as are links with a null end. No links, no rows. The number of rounds grows with the logarithm
    of the longest chain; each round is written to the shared scratch folder.
    """
    edges = cut(links.where("u <> v").select("u", "v").distinct(), "links")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        small = _toward_minimum(large.distinct())
        edges = cut(small.select(F.col("v").alias("u"), F.col("low").alias("v"))
                    .union(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), "links")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        unfinished = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.max("root").alias("root")).where(
            "leaves > 1 OR (leaves = 1 AND root = 1)")
        if unfinished.isEmpty():
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
