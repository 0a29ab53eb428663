"""Tables that the queries share, each beside the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.functions.authority import classify_source_type
from ragcorpus.operators.bm25 import Bm25Index, bm25_topk, store_bm25_index
from ragcorpus.sources.scratch import new_path, save

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Titles and domains that make every rule of the source types fire.
META_SQL = """meta AS (SELECT doc_id, text AS content,
  CASE doc_id % 8 WHEN 0 THEN 'FAQs on registration' WHEN 1 THEN 'Manual for returns' WHEN 2 THEN 'Notification 12' WHEN 3 THEN 'Circular 7'
    WHEN 4 THEN 'Rules of invoices' WHEN 5 THEN 'The Act' WHEN 6 THEN 'Overview' ELSE 'Practices' END AS title,
  'https://site' || (doc_id % 5)::VARCHAR || '.example.org/p/' || (doc_id // 3)::VARCHAR || '?v=' || (doc_id % 2)::VARCHAR AS url,
  CASE doc_id % 7 WHEN 0 THEN 'help.portal' WHEN 1 THEN 'tutorial.portal' WHEN 2 THEN 'cbt' ELSE 'portal' END AS domain,
  'src-' || (doc_id // 3)::VARCHAR AS source_id, (doc_id % 3)::INTEGER AS chunk_index, 3 AS total_chunks FROM documents)"""
TYPE_SQL = """typed AS (SELECT *, CASE
  WHEN lower(title) LIKE 'faq%' OR source_id LIKE '%faq%' THEN 'faq' WHEN lower(title) LIKE '%manual%' OR source_id LIKE '%manual%' THEN 'user_guide'
  WHEN regexp_matches(whole, '\\bnotification\\b') THEN 'notification' WHEN regexp_matches(whole, '\\bcircular\\b') THEN 'circular'
  WHEN regexp_matches(whole, '\\brules\\b') OR lower(title) LIKE 'rule%' THEN 'rules' WHEN regexp_matches(whole, '\\bact\\b') THEN 'act'
  WHEN domain LIKE '%userguide%' OR domain LIKE '%tutorial%' OR domain LIKE '%cbt%' THEN 'user_guide' WHEN domain LIKE '%help%' THEN 'help' ELSE 'other' END AS source_type
  FROM (SELECT *, lower(title || ' ' || url || ' ' || domain || ' ' || source_id) AS whole FROM meta))"""
RANK_SQL = "CASE source_type WHEN 'act' THEN 0 WHEN 'rules' THEN 1 WHEN 'notification' THEN 2 WHEN 'circular' THEN 3 WHEN 'faq' THEN 4 WHEN 'user_guide' THEN 5 WHEN 'help' THEN 6 ELSE 7 END"
BONUS_SQL = "CASE source_type WHEN 'act' THEN 0.08::DOUBLE WHEN 'rules' THEN 0.08 WHEN 'notification' THEN 0.06 WHEN 'circular' THEN 0.05 WHEN 'faq' THEN 0.02 WHEN 'user_guide' THEN 0.01 ELSE 0 END"


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda value, names, other: F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]), (value + 1).cast("int")), F.lit(other))
    third = F.expr("doc_id div 3").cast("string")
    return table(spark, sf_dir, "documents").select(
        d,
        F.col("text").alias("content"),
        pick(d % 8, ["FAQs on registration", "Manual for returns", "Notification 12", "Circular 7", "Rules of invoices", "The Act", "Overview"], "Practices").alias("title"),
        F.concat(F.lit("https://site"), (d % 5).cast("string"), F.lit(".example.org/p/"), third, F.lit("?v="), (d % 2).cast("string")).alias("url"),
        pick(d % 7, ["help.portal", "tutorial.portal", "cbt"], "portal").alias("domain"),
        F.concat(F.lit("src-"), third).alias("source_id"),
        (d % 3).cast("int").alias("chunk_index"),
        F.lit(3).alias("total_chunks"),
    )


def typed(df: DataFrame) -> DataFrame:
    return df.withColumn("source_type", classify_source_type(F.col("title"), F.col("url"), F.col("domain"), F.col("source_id")))


#: BM25 over documents for the benchmark's texts.
BM25_SQL = r"""tok AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '') AS tokens FROM documents),
lens AS (SELECT doc_id, len(tokens) AS dl FROM tok),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln((SELECT n FROM corpus) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
meanidf AS (SELECT avg(raw) AS m FROM raws),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raws, meanidf),
wanted AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM post JOIN wanted USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), corpus GROUP BY ALL)"""
TOPK_SQL = BM25_SQL + """,
every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN scores s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
topk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM every QUALIFY rank <= 20)"""
HITS_SQL = TOPK_SQL + ",\n" + META_SQL + ",\n" + TYPE_SQL + """,
hits AS (SELECT query_id, rank AS pos, doc_id, content, title, url, domain, source_id, source_type, chunk_index, total_chunks, score FROM topk JOIN typed USING (doc_id))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("doc_order"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_STORED: dict[tuple[str, str], Bm25Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    """The index of the documents, stored once for the queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = store_bm25_index(chunks(spark, sf_dir), new_path(spark))
    return _STORED[key]


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(index(spark, sf_dir), questions(spark, sf_dir)).withColumnRenamed("chunk_id", "doc_id").drop("doc_order")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 documents of each benchmark text with their metadata; pos is the rank. The best are a table before documents
    are read for them, so these are not shuffled, and the hits are one, as queries join them with themselves."""
    best, _ = save(topk(spark, sf_dir))
    return save(best.join(typed(meta(spark, sf_dir)), "doc_id").withColumnRenamed("rank", "pos"))[0]


#: Vectors with the documents of their number; queries are those of the benchmark's numbers.
KNN_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT query_id, vec_id AS chunk_id, round(list_sum(list_transform(range(1, len(qe) + 1), lambda i: (qe[i] - embedding[i]::DOUBLE) ** 2)), 9) AS distance FROM q, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INTEGER AS rank FROM pairs)"""
DENSE_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings JOIN benchmark ON vec_id = item_id),
dpairs AS (SELECT query_id, vec_id AS doc_id, round(list_sum(list_transform(range(1, len(qe) + 1), lambda i: (qe[i] - embedding[i]::DOUBLE) ** 2)), 9) AS distance FROM q, embeddings),
dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM dpairs QUALIFY rank <= 20)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


#: Assistant turns as answers: citations, source lists and finish reasons by the number of the turn.
ANSWERS_SQL = r"""ans AS (SELECT conv_id * 1000 + turn AS query_id, text AS query,
  text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [2][3] and [1]' WHEN 2 THEN ' [99]' WHEN 3 THEN ' [ 1 ]' WHEN 4 THEN ' could not find' WHEN 5 THEN E' [1]\nSources:\n[2] x' ELSE '' END AS answer,
  CASE WHEN turn % 2 = 0 THEN 'concise' ELSE 'detailed' END AS verbosity, CASE WHEN conv_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, (turn % 4)::INTEGER AS retry_count
  FROM conversations WHERE role = 'assistant'),
cit AS (SELECT query_id, (i + 1)::INTEGER AS citation_id, 'Title ' || i::VARCHAR AS title, 'https://c.example.org/' || i::VARCHAR AS url, 'portal' AS domain, 's' || i::VARCHAR AS source_id, 0 AS chunk_index, 1 AS total_chunks, 0.5::DOUBLE AS score
  FROM ans, range(0, 3) t(i) WHERE query_id % 6 > 0 AND i < query_id % 4 + 1)"""
VALID_SQL = ANSWERS_SQL + r""",
known AS (SELECT query_id, list_sort(list(citation_id::BIGINT)) AS source_ids FROM cit GROUP BY query_id),
bod AS (SELECT ans.*, coalesce(source_ids, []::BIGINT[]) AS source_ids, string_split_regex(answer, '\n\s*(?:Sources|References|स्रोत)\s*:?\s*\n')[1] AS body FROM ans LEFT JOIN known USING (query_id)),
cnt AS (SELECT *, list_transform(regexp_extract_all(body, '\[([0-9]+)\]', 1), lambda x: x::BIGINT) AS cited_ids, len(list_filter(string_split_regex(body, '\s+'), lambda w: w <> '')) AS word_count FROM bod),
fnd AS (SELECT *, CASE WHEN len(source_ids) = 0 THEN 'No citation sources available'
   WHEN regexp_matches(lower(body), 'could not find|not available|not found|not covered|does not contain|do not contain|no information|unable to find') THEN 'LLM indicated information not found in sources'
   WHEN len(cited_ids) = 0 THEN 'No inline citations in response body'
   WHEN len(list_filter(cited_ids, lambda x: NOT list_contains(source_ids, x))) > 0 THEN 'Response contains citations not found in sources' END AS e1,
  CASE WHEN regexp_matches(answer, '\[\s+[0-9]+\s*\]|\[\s*[0-9]+\s+\]') THEN 'Citation spacing should use compact [n] format' END AS w1,
  CASE WHEN verbosity = 'concise' AND word_count > 500 THEN 'Concise response has ' || word_count::VARCHAR || ' words' END AS w2,
  CASE WHEN finish_reason = 'length' THEN 'LLM response truncated by token cap' END AS e2 FROM cnt),
val AS (SELECT *, CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL THEN 'fail' WHEN w1 IS NOT NULL OR w2 IS NOT NULL THEN 'warn' ELSE 'pass' END AS status,
  list_filter([e1, e2], lambda x: x IS NOT NULL) AS errors, list_filter([w1, w2], lambda x: x IS NOT NULL) AS warnings,
  (e2 IS NOT NULL OR coalesce(e1 IN ('No inline citations in response body', 'Response contains citations not found in sources'), false)) AS retryable FROM fnd)"""
SCORED_SQL = VALID_SQL + r""",
lst AS (SELECT query_id, string_agg('[' || citation_id::VARCHAR || '] ' || title || ' - ' || url || chr(10), '' ORDER BY citation_id) AS source_list FROM cit GROUP BY query_id),
pre AS (SELECT val.*, source_list, coalesce(e1 IN ('No inline citations in response body', 'Response contains citations not found in sources'), false) AS defect, finish_reason = 'length' AS truncated, verbosity = 'concise' AND word_count > 500 AS length_warning FROM val LEFT JOIN lst USING (query_id)),
scored AS (SELECT query_id, query, verbosity, retry_count, truncated, length_warning, source_ids, status, warnings, defect AND NOT truncated AS forgiven,
  CASE WHEN defect AND NOT truncated THEN 0.8::DOUBLE WHEN length_warning THEN least(base, 0.5) ELSE base END AS confidence,
  (defect AND NOT truncated) OR status <> 'fail' AS citations_valid, retryable AND NOT (defect AND NOT truncated) AS retryable,
  CASE WHEN defect THEN answer || E'\n\n**Sources:**\n' || coalesce(source_list, '') ELSE answer END AS answer,
  CASE WHEN defect AND NOT truncated THEN list_filter([e2], lambda x: x IS NOT NULL) ELSE errors END AS errors
  FROM (SELECT *, CASE WHEN len(source_ids) = 0 THEN 0.0::DOUBLE WHEN e1 = 'LLM indicated information not found in sources' THEN 0.3 WHEN defect OR e2 IS NOT NULL THEN 0.4 ELSE 0.8 END AS base FROM pre))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    ends = [" [1]", " [2][3] and [1]", " [99]", " [ 1 ]", " could not find", " [1]\nSources:\n[2] x", ""]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        F.concat("text", end).alias("answer"),
        F.when(F.col("turn") % 2 == 0, "concise").otherwise("detailed").alias("verbosity"),
        F.when(F.col("conv_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"),
        (F.col("turn") % 4).cast("int").alias("retry_count"),
    )


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answers(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).where("query_id % 6 > 0 AND i < query_id % 4 + 1")
    number = F.col("i").cast("string")
    return own.select(
        "query_id",
        (F.col("i") + 1).alias("citation_id"),
        F.concat(F.lit("Title "), number).alias("title"),
        F.concat(F.lit("https://c.example.org/"), number).alias("url"),
        F.lit("portal").alias("domain"),
        F.concat(F.lit("s"), number).alias("source_id"),
        F.lit(0).alias("chunk_index"),
        F.lit(1).alias("total_chunks"),
        F.lit(0.5).alias("score"),
    )


