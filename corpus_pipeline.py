"""A corpus from documents: toxic documents go, near duplicates go, secrets are blanked, sources are mixed, text is encoded.

STAGES lists (name, function); a function takes (spark, docs, folder of the tables) and returns a frame. All but the last
return the columns of documents. `run` writes each stage's rows to the shared scratch folder, and the next stage reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import mixing, pieces, secrets, simhash, toxicity
from sluice.llm.tables import cut

MIX_RATE = 0.5  # share of the tokens that mixing hands on, whatever the cells are


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not toxic; the letter model is that of all documents given."""
    return toxicity.reject(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return simhash.keep_one(docs, "doc_id", "text")


def blanked(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents; secrets are replaced by a mark, and n_chars follows the new text."""
    out = secrets.redact(docs, "doc_id", "text", "source")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with MIX_RATE of the tokens, drawn so that sources, languages and topics come near their tempered shares.

    None comes twice, since equal keys and texts would be segmented alike: documents of rare cells are all taken.
    """
    return mixing.sample(docs, "doc_id", "text", rate=MIX_RATE, repeat=False)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled segmentations of every document: (doc_id, rank, ids, log_prob, perturbed, inclusion, restored)."""
    return pieces.encode(docs, "doc_id", "text").withColumnRenamed("key", "doc_id")


STAGES = [("toxicity", clean), ("near duplicates", distinct), ("secrets", blanked), ("mixing", mixed), ("pieces", encoded)]

# A letter model, fingerprints, a fitted forest and sampled segmentations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
