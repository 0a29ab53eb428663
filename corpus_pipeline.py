"""A training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked,
and what is left is packed into sequences. Each stage is written as Parquet and read back before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.llm import packing, pii, simhash, toxicity
from ragcorpus.llm._common import save
from ragcorpus.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; rows and columns are otherwise as they were."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; of rows that repeat one doc_id, the first by text.

    Rows without a doc_id stay only if no member of their group has one, and then one does.
    """
    return simhash.first_of_each_group(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in the text and n_chars counted again where the text is not null."""
    masked = docs.select("doc_id", pii.redacted(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity_stage), ("simhash_dedup", simhash_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs)
    return docs


#: Fingerprints, trees and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
