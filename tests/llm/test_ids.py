"""Ids beyond 2^53, which a float cannot hold, stay as they are beside a null in the same batch."""

import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import bpe, fingerprints, html_crf, packing, pii, sharding, simhash, token_counts, toxicity
from ragcorpus.llm.queries import vocabulary

IDS = [2**53 + 1, None, -(2**62) - 1, 7]
WIDE = vocabulary("byte_bpe_multi_50k.tiktoken")
NARROW = vocabulary("byte_bpe_50k.tiktoken")


def labels(spark):
    return spark.createDataFrame([(7, 1)], "doc_id long, toxic int")


OPERATORS = {
    "op1": lambda spark, docs: sharding.shard_documents(docs, 2),
    "op3": lambda spark, docs: bpe.encode_documents(docs, WIDE),
    "op4": lambda spark, docs: html_crf.extract_pages(docs.withColumn("url", F.lit("u")), id_col="doc_id", html_col="text").withColumnRenamed("page_id", "doc_id"),
    "op5": lambda spark, docs: toxicity.score_documents(docs, labels(spark)),
    "op6": lambda spark, docs: fingerprints.fingerprint_documents(docs),
    "op7": lambda spark, docs: packing.pack_documents(docs, NARROW),
    "op8": lambda spark, docs: token_counts.count_tokens(docs, NARROW),
    "op9": lambda spark, docs: pii.find_personal_data(docs),
    "op10": lambda spark, docs: simhash.simhash_components(docs),
    "first": lambda spark, docs: simhash.first_of_each_group(docs),
    "toxic": lambda spark, docs: toxicity.without_toxic(docs, labels(spark)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids(spark, name):
    texts = ["alpha beta gamma delta one", "other words stand here now too", "a third text of its own kind", "and the last of them all is this"]
    docs = spark.createDataFrame(list(zip(IDS, texts, strict=True)), "doc_id long, text string").coalesce(1)
    assert sorted(str(r["doc_id"]) for r in OPERATORS[name](spark, docs).select("doc_id").collect()) == sorted(map(str, IDS))
