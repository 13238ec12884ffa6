"""Helpers the operators share: tables written to cut a plan, and joins sized before they broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import broadcast_if_small, scratch_path

__all__ = ["broadcast_if_small", "cut", "hash_sample", "text_bytes", "whole_row"]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the cluster's shared scratch folder and read it back.

    What follows no longer depends on how the rows were made: a lost executor costs a reread, and columns fixed here
    (numbers of partitions, row numbers) stay as they are.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, *derived: Column) -> DataFrame:
    """The input row as one struct `row`, beside derived columns, so no name of the input can clash with ours."""
    return df.select(F.struct("*").alias("row"), *derived)


def hash_sample(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most `limit` rows with the smallest hashes of these columns: the same ones in every run.

    Rows are counted first, and only a share of them that holds some four times as many is looked at, so what tasks hand on
    does not grow with the table. Pass a table that is cheap to read twice.
    """
    share = min(1.0, (4 * limit + 1000) / max(df.count(), 1))
    spread = F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)
    picked = df.withColumn("_spread", spread).where(F.col("_spread") <= share)
    return picked.orderBy("_spread", *columns).limit(limit).drop("_spread")


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")
