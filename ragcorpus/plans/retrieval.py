"""Queries of lexical and dense retrieval, fusion, authority, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.functions.authority import authority_bonus, authority_rank, safe_score, source_type_label
from ragcorpus.functions.text import extract_snippet, tokenize
from ragcorpus.operators import dense, evaluation, fusion
from ragcorpus.operators.bm25 import Bm25Index, append_to_bm25_index, bm25_scores, bm25_topk, build_bm25_index, delete_from_bm25_index, read_bm25_index, store_bm25_index
from ragcorpus.plans.tables import BM25_SQL, BONUS_SQL, DENSE_SQL, HITS_SQL, KNN_SQL, META_SQL, RANK_SQL, TOPK_SQL, TYPE_SQL, chunks, hits, index, meta, query, query_vectors, questions, table, topk, typed, vectors
from ragcorpus.sources.scratch import new_path


def six(name: str) -> Column:
    """Six places of a value that is rounded to nine: the small addend decides halves alike in every engine."""
    return F.round(F.col(name) + 1e-10, 6).alias(name)


@query(r"""SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents)""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


#: Document frequencies alone, from the distinct words of each text.
TERMS_SQL = r"""WITH dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> ''))) AS term FROM documents) GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, (SELECT count(*) AS n FROM documents)), mean AS (SELECT avg(raw) AS m FROM raws)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END + 1e-10, 6) AS idf FROM raws, mean"""


@query(TERMS_SQL)
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).terms.select("term", "df", six("idf"))


@query(f"WITH {BM25_SQL} SELECT doc_id, term, tf, dl::INTEGER AS dl FROM post JOIN lens USING (doc_id)")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select(F.col("chunk_id").alias("doc_id"), "term", "tf", "dl")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score + 1e-10, 6) AS score FROM scores")
def bm25_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_scores(index(spark, sf_dir), questions(spark, sf_dir)).select("query_id", F.col("chunk_id").alias("doc_id"), six("score"))


@query(f"WITH {TOPK_SQL} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM topk")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark, sf_dir).select("query_id", "rank", "doc_id", six("score"))


#: The first five words of each text: short queries, of which most have stop-words.
SHORT_SQL = TOPK_SQL.replace("lower(text), '\\s+'), lambda t: t <> '')) AS term FROM benchmark", "lower(array_to_string(string_split(text, ' ')[1:5], ' ')), '\\s+'), lambda t: t <> '')) AS term FROM benchmark")


@query(f"WITH {SHORT_SQL} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM topk")
def bm25_short_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of few terms, of which postings are read by their bounds."""
    asked = questions(spark, sf_dir).withColumn("query", F.substring_index("query", " ", 5))
    return bm25_topk(index(spark, sf_dir), asked, pruned_from=0).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), six("score"))


#: The corpus in three steps: two parts, each a segment, and a third of the first taken out and added again with the second.
@query(TERMS_SQL)
def bm25_grown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir).terms.select("term", "df", six("idf"))


@query(f"WITH {TOPK_SQL} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM topk")
def bm25_grown_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 from an index that grew by segments."""
    return bm25_topk(_grown(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), six("score"))


def _grown(spark: SparkSession, sf_dir: str) -> Bm25Index:
    own, path = chunks(spark, sf_dir), new_path(spark)
    store_bm25_index(own.where("chunk_id % 2 = 0"), path)
    delete_from_bm25_index(own.where("chunk_id % 3 = 0"), path)
    append_to_bm25_index(own.where("chunk_id % 2 = 1 or chunk_id % 3 = 0"), path)
    return read_bm25_index(spark, path)


#: A corpus of one template, but for every 20th document: most terms are in over half of it, and their scores below 0.
TEMPLATE_SQL = TOPK_SQL.replace("lower(text), '\\s+'), lambda t: t <> '') AS tokens FROM documents", "lower(CASE WHEN doc_id % 20 = 19 THEN 'x ' || lang ELSE 'a b c' END), '\\s+'), lambda t: t <> '') AS tokens FROM documents").replace(
    "lower(text), '\\s+'), lambda t: t <> '')) AS term FROM benchmark", "lower(CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'a x' END), '\\s+'), lambda t: t <> '')) AS term FROM benchmark"
)


@query(f"WITH {TEMPLATE_SQL} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM topk")
def bm25_template_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that share no term with a query stand before those of scores below 0, wherever they are in the corpus."""
    text = F.when(F.col("chunk_id") % 20 == 19, F.concat(F.lit("x "), "lang")).otherwise("a b c")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("doc_order"), "lang")
    asked = questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 2 == 0, "a").otherwise("a x"))
    found = bm25_topk(build_bm25_index(docs.withColumn("content", text)), asked)
    return found.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), six("score"))


@query(f"WITH {KNN_SQL} SELECT query_id, rank, chunk_id, round(distance + 1e-10, 6) AS distance FROM near WHERE rank <= 20")
def knn_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.knn(vectors(spark, sf_dir), query_vectors(spark, sf_dir)).select("query_id", "rank", "chunk_id", six("distance"))


@query(f"WITH {KNN_SQL} SELECT query_id, rank, chunk_id, round(distance + 1e-10, 6) AS distance FROM near WHERE rank <= 20")
def knn_indexed_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_top20, from an index that is stored first."""
    own = dense.store_vector_index(vectors(spark, sf_dir), new_path(spark))
    return dense.knn_by_index(own, query_vectors(spark, sf_dir)).select("query_id", "rank", "chunk_id", six("distance"))


@query(f"WITH {KNN_SQL} SELECT query_id, rank, chunk_id, round(round(1 - distance / sqrt(2.0), 9) + 1e-10, 6) AS score FROM near WHERE rank <= 20")
def knn_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.knn(vectors(spark, sf_dir), query_vectors(spark, sf_dir), with_score=True).select("query_id", "rank", "chunk_id", six("score"))


@query(f"WITH {KNN_SQL} SELECT query_id, rank, chunk_id, round(distance + 1e-10, 6) AS score FROM near WHERE rank <= 5")
def knn_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.knn_by_vector(vectors(spark, sf_dir), query_vectors(spark, sf_dir)).select("query_id", "rank", "chunk_id", six("score"))


#: Five picks of each query, one a step: the most relevant first, then relevance against likeness to those chosen before.
MMR_SQL = f"""{KNN_SQL},
unit AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS x FROM embeddings),
c AS MATERIALIZED (SELECT query_id, chunk_id, rank, a.x, round(list_dot_product(a.x, b.x), 12) AS rel FROM near JOIN unit a ON a.vec_id = chunk_id JOIN unit b ON b.vec_id = query_id WHERE rank <= 20),
alike AS MATERIALIZED (SELECT a.query_id, a.chunk_id, b.chunk_id AS other, round(list_dot_product(a.x, b.x), 12) AS sim FROM c a JOIN c b USING (query_id)),
picks(query_id, pick, chosen) AS (SELECT query_id, 1, [chunk_id] FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) = 1
  UNION ALL SELECT query_id, pick + 1, list_append(chosen, chunk_id) FROM (
    SELECT p.query_id, pick, chosen, c.chunk_id, c.rank, 0.7::DOUBLE * any_value(rel) - (1 - 0.7::DOUBLE) * max(sim) AS value
    FROM picks p JOIN c ON c.query_id = p.query_id JOIN alike s ON s.query_id = p.query_id AND s.chunk_id = c.chunk_id AND list_contains(chosen, s.other)
    WHERE pick < 5 AND NOT list_contains(chosen, c.chunk_id) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank) = 1)"""


@query(f"WITH RECURSIVE {MMR_SQL} SELECT query_id, pick::INTEGER AS pick, chosen[pick] AS chunk_id FROM picks")
def mmr_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, asked = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    near = dense.knn(own, asked).join(own, "chunk_id").join(asked.withColumnRenamed("embedding", "query_embedding"), "query_id")
    return dense.mmr(near)


@query(r"SELECT doc_id, 64 AS dims, CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM documents")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dense.embed(chunks(spark, sf_dir))
    return own.select(F.col("chunk_id").alias("doc_id"), F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = vectors(spark, sf_dir).join(questions(spark, sf_dir).select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id")
    near = dense.knn(vectors(spark, sf_dir), asked)
    lexical = topk(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    found, own = fusion.with_chunks(near.select("query_id", "rank", "chunk_id", F.lit(0).alias("arm")).unionByName(lexical.select("query_id", "rank", "chunk_id", F.lit(1).alias("arm"))), chunks(spark, sf_dir).select("chunk_id", "content"))
    arms = found.join(own, "chunk_id")
    return arms.where("arm = 0"), arms.where("arm = 1")


RRF_SQL = f"""{HITS_SQL},
{DENSE_SQL},
darm AS (SELECT query_id, text AS content, 1.0::DOUBLE / (60 + max(rank)) AS part, 0 AS arm, min(rank) AS first, arg_max(doc_id, rank) AS doc_id FROM dense JOIN documents USING (doc_id) GROUP BY query_id, text),
larm AS (SELECT query_id, text AS content, sum(1.0::DOUBLE / (60 + rank)) AS part, 1 AS arm, min(rank) AS first, arg_min(doc_id, rank) AS doc_id FROM topk JOIN documents USING (doc_id) GROUP BY query_id, text),
fused AS (SELECT query_id, content, round(sum(part), 9) AS score, min((arm, first, doc_id)) AS best FROM (FROM darm UNION ALL FROM larm) GROUP BY query_id, content),
rrf AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best)::INTEGER AS rank, best[3] AS doc_id, content, score FROM fused)"""


@query(f"WITH {RRF_SQL} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM rrf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_arms(spark, sf_dir)).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), six("score"))


SELECT_SQL = f"""sel AS (SELECT query_id, doc_id, rank AS before, score AS raw, source_type, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END + {BONUS_SQL}, 9) AS authority_score
  FROM (SELECT p.*, source_type, min(score) OVER w AS lo, max(score) OVER w AS hi FROM pool p JOIN typed USING (doc_id) WINDOW w AS (PARTITION BY query_id))),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY authority_score DESC, raw DESC, before)::INTEGER AS rank FROM sel QUALIFY rank <= 5)"""


def hybrid(spark: SparkSession, sf_dir: str, scorer: object = None, strategy: str = "hybrid") -> DataFrame:
    own = typed(meta(spark, sf_dir)).withColumnRenamed("doc_id", "chunk_id").join(vectors(spark, sf_dir), "chunk_id", "left")
    asked = questions(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    own_index = index(spark, sf_dir) if strategy == "hybrid" else None
    return fusion.retrieve(own, asked, own_index, strategy, scorer=scorer).withColumnRenamed("chunk_id", "doc_id")


@query(f"WITH {RRF_SQL}, pool AS (SELECT query_id, rank, doc_id, score FROM rrf), {SELECT_SQL} SELECT query_id, rank, doc_id, source_type, round(raw + 1e-10, 6) AS score, round(authority_score + 1e-10, 6) AS authority_score FROM chosen")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "rank", "doc_id", "source_type", six("score"), six("authority_score"))


OVERLAP_SQL = r"""over AS (SELECT r.query_id, r.doc_id, r.rank AS before, round(len(list_intersect(qw, list_distinct(list_filter(string_split_regex(lower(r.content), '\s+'), lambda t: t <> '')))) / len(qw), 9) AS score
  FROM {source} r JOIN (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) AS qw FROM benchmark) USING (query_id)),
pool AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INTEGER AS rank FROM over)"""


@query(f"WITH {RRF_SQL}, {OVERLAP_SQL.format(source='rrf')}, {SELECT_SQL} SELECT query_id, rank, doc_id, source_type, round(raw + 1e-10, 6) AS score, round(authority_score + 1e-10, 6) AS authority_score FROM chosen")
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, fusion.overlap_scorer).select("query_id", "rank", "doc_id", "source_type", six("score"), six("authority_score"))


@query(f"""WITH {META_SQL}, {TYPE_SQL}, {DENSE_SQL}, dist AS (SELECT query_id, dense.doc_id, rank, round(1 - distance / sqrt(2.0), 9) AS score FROM dense JOIN dpairs USING (query_id, doc_id)),
pool AS (SELECT dist.* FROM dist JOIN documents USING (doc_id)), {SELECT_SQL} SELECT query_id, rank, doc_id, source_type, round(raw + 1e-10, 6) AS score, round(authority_score + 1e-10, 6) AS authority_score FROM chosen""")
def dense_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, strategy="dense").select("query_id", "rank", "doc_id", "source_type", six("score"), six("authority_score"))


@query(f"WITH {HITS_SQL}, {OVERLAP_SQL.format(source='(SELECT query_id, doc_id, pos AS rank, content FROM hits)')} SELECT query_id, rank, doc_id, round(score + 1e-10, 6) AS score FROM pool WHERE rank <= 10")
def reranked_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = hits(spark, sf_dir).withColumnRenamed("pos", "rank").join(questions(spark, sf_dir), "query_id")
    return fusion.rerank(pool, top_k=10).select("query_id", "rank", "doc_id", six("score"))


@query(f"WITH {HITS_SQL}, pool AS (SELECT query_id, doc_id, pos AS rank, score FROM hits), {SELECT_SQL} SELECT query_id, rank, doc_id, source_type, round(raw + 1e-10, 6) AS score, round(authority_score + 1e-10, 6) AS authority_score FROM chosen")
def authority_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fusion.select_with_authority(hits(spark, sf_dir).withColumnRenamed("pos", "rank"))
    return own.select("query_id", "rank", "doc_id", "source_type", six("score"), six("authority_score"))


@query(f"WITH {META_SQL}, {TYPE_SQL} SELECT doc_id, source_type, {RANK_SQL}::INTEGER AS authority_rank, {BONUS_SQL} AS bonus, CASE source_type WHEN 'faq' THEN 'FAQ' WHEN 'user_guide' THEN 'User Guide' ELSE upper(source_type[1]) || source_type[2:] END AS label FROM typed")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("source_type")
    return typed(meta(spark, sf_dir)).select("doc_id", kind, authority_rank(kind).alias("authority_rank"), authority_bonus(kind).alias("bonus"), source_type_label(kind).alias("label"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE NULL END AS DOUBLE), 0.0) AS score FROM events")
def safe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", safe_score(raw).alias("score"))


@query(rf"""WITH {HITS_SQL}, s AS (SELECT query_id, doc_id, content, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss, list_filter(string_split_regex(lower(b.text), '\s+'), lambda t: t <> '') AS terms FROM hits JOIN benchmark b ON b.item_id = query_id),
c AS (SELECT query_id, doc_id, unnest(list_transform(range(1, len(ss) + 1), lambda i: {{'hits': len(list_filter(terms, lambda t: contains(lower(ss[i]), t))), 'at': -i, 'sentence': ss[i]}})) AS x FROM s)
SELECT query_id, doc_id, max(x).sentence[1:160] AS snippet FROM c GROUP BY query_id, doc_id""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).select("query_id", "doc_id", "content").join(questions(spark, sf_dir), "query_id")
    return own.select("query_id", "doc_id", extract_snippet(F.col("content"), F.col("query")).alias("snippet"))


AUTH = "source_type IN ('act', 'rules', 'notification')"


@query(f"""WITH {HITS_SQL} SELECT item_id AS query_id, round(coalesce(avg(CASE WHEN pos <= 5 THEN ({AUTH})::INTEGER END), 0), 6) AS authority_at_top_k, round(coalesce(avg(CASE WHEN pos <= 1 THEN ({AUTH})::INTEGER END), 0), 6) AS authority_at_1,
round(coalesce(avg(CASE WHEN pos <= 3 THEN ({AUTH})::INTEGER END), 0), 6) AS authority_at_3, round(coalesce(avg(CASE WHEN pos <= 5 THEN ({AUTH})::INTEGER END), 0), 6) AS authority_at_5, min(CASE WHEN {AUTH} THEN pos END) AS first_rank,
count(*) FILTER ({AUTH}) AS n_authoritative, count(hits.doc_id) AS n_retrieved FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY item_id""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.retrieval_metrics(hits(spark, sf_dir).withColumnRenamed("pos", "rank"), questions(spark, sf_dir))
    shares = [six(c) for c in ("authority_at_top_k", "authority_at_1", "authority_at_3", "authority_at_5")]
    return found.select("query_id", *shares, "first_rank", "n_authoritative", "n_retrieved")


@query(f"WITH {HITS_SQL} SELECT item_id AS query_id, round(coalesce(avg(CASE WHEN pos <= 3 THEN ({AUTH})::INTEGER END), 0), 6) AS value, min(CASE WHEN {AUTH} THEN pos END) AS first_rank FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY item_id")
def authority_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, asked = hits(spark, sf_dir).withColumnRenamed("pos", "rank"), questions(spark, sf_dir)
    return evaluation.authority_at_k(own, asked, 3).join(evaluation.first_authoritative_rank(own, asked), "query_id").select("query_id", six("value"), "first_rank")


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN max(text) WHEN len(c) = 0 THEN 'No content found in search results.' ELSE array_to_string(c, E'\\n\\n') END AS text
FROM (SELECT conv_id, text, list_filter(list(CASE WHEN turn % 2 = 0 THEN text ELSE '' END ORDER BY turn) OVER (PARTITION BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[1:3], lambda t: t <> '') AS c FROM conversations) GROUP BY conv_id, c""")
def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    grouped = turns.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max("text").alias("answer"), F.sort_array(F.collect_list(F.struct("turn", content.alias("content")))).alias("results")
    )
    own = grouped.withColumn("answer", F.when(F.col("query_id") % 3 == 0, F.col("answer")))
    return fusion.combine_search_results(own).select(F.col("query_id").alias("conv_id"), "text")
