"""The registered queries of the operators: (session, folder of the tables) -> frame, and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import (licenses, minhash, mixing, pieces, prefixes, quality, secrets, sharding, simhash, toxicity, variants,
                        vectors, warc)

Run = Callable[[SparkSession, str], DataFrame]


def _over(table: str, apply: Callable[[DataFrame], DataFrame]) -> Run:
    return lambda spark, folder: apply(spark.read.parquet(f"{folder}/{table}.parquet"))


QUERIES: dict[str, Run] = {
    "op1_toxicity": lambda spark, folder: toxicity.document_toxicity(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")),
    "op2_pieces": _over("documents", pieces.document_pieces),
    "op3_mix": _over("documents", mixing.document_mix),
    "op4_shards": _over("documents", sharding.document_shards),
    "op5_secrets": _over("documents", secrets.document_secrets),
    "op6_simhash": _over("documents", simhash.document_groups),
    "op7_quality": lambda spark, folder: quality.document_quality(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")),
    "op8_warc": _over("pages", warc.round_trip),
    "op9_vectors": _over("embeddings", vectors.embedding_groups),
    "op10_licenses": _over("documents", licenses.document_licenses),
    "op11_prefixes": _over("conversations", prefixes.conversation_trie),
    "op12_variants": _over("documents", variants.document_variants),
    "op13_minhash": _over("documents", minhash.document_fingerprints),
}

SQL: dict[str, str] = {
    "op3_mix": mixing.DOCUMENT_MIX_SQL,
    "op4_shards": sharding.DOCUMENT_SHARDS_SQL,
    "op8_warc": warc.ROUND_TRIP_SQL,
    "op9_vectors": vectors.EMBEDDING_GROUPS_SQL,
    "op10_licenses": licenses.DOCUMENT_LICENSES_SQL,
    "op11_prefixes": prefixes.CONVERSATION_TRIE_SQL,
    "op12_variants": variants.DOCUMENT_VARIANTS_SQL,
}
