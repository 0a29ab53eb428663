"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.llm import bloom_search, bpe, conversation_repair, fingerprints, html_crf, packing, phrase_index, pii, pq_dedup, sharding, simhash, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_html_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_tree_sharding": op1_kd_tree_sharding,
    "op2_pq_near_dedup": op2_pq_near_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_html_field": op4_html_field,
    "op5_toxicity_trees": op5_toxicity_trees,
    "op6_bottom_k_fingerprints": op6_bottom_k_fingerprints,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii_candidates": op9_pii_candidates,
    "op10_simhash_covering": op10_simhash_covering,
    "op11_phrase_index": op11_phrase_index,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bloom_search": op13_bloom_search,
}

#: The words of a text in lower case, where only A-Z are lowered.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_phrase_index": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_bloom_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
totals AS (SELECT count(*) AS n_texts, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
posting AS (SELECT doc_id, len AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
wanted AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
weighed AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * n_texts + 2) / (2 * df + 1))) AS BIGINT) AS wt FROM wanted JOIN df USING (term), totals),
scored AS (SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_texts) // n_words)))) AS BIGINT) AS score
           FROM weighed JOIN posting USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
}
