"""Queries of citations, contexts, prompts, conversations, answer validation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.functions import masking
from ragcorpus.functions import query as classes
from ragcorpus.operators import citations as cite
from ragcorpus.operators import evaluation, prompts, validation
from ragcorpus.plans.tables import ANSWERS_SQL, HITS_SQL, RANK_SQL, SCORED_SQL, VALID_SQL, answer_citations, answers, hits, query, questions, table

CITED_SQL = (
    HITS_SQL
    + f""",
placed AS (SELECT *, string_split(string_split(url, '#')[1], '?')[1] AS plain, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_SQL}, score DESC, url, title, pos)::INTEGER AS place FROM hits),
firsts AS (SELECT *, min(place) OVER (PARTITION BY query_id, source_id, plain, title) AS first FROM placed),
cited AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first)::INTEGER AS citation_id FROM firsts)"""
)
BLOCKS_SQL = (
    CITED_SQL
    + r""",
blocks AS (SELECT query_id, citation_id, '[' || citation_id::VARCHAR || E']\nSource ID: ' || arg_min(source_id, place) || E'\nTitle: ' || arg_min(title, place) || E'\nURL: ' || arg_min(url, place) || E'\nDomain: ' || arg_min(domain, place) || E'\n' ||
  string_agg('Chunk ' || chunk_index::VARCHAR || E':\n' || content, E'\n' ORDER BY chunk_index, place) AS block FROM cited GROUP BY query_id, citation_id)"""
)


@query(f"WITH {CITED_SQL} SELECT query_id, doc_id, place, citation_id FROM cited")
def citation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.assign_source_citations(hits(spark, sf_dir)).select("query_id", "doc_id", "place", "citation_id")


@query(f"WITH {CITED_SQL} SELECT query_id, citation_id, arg_min(title, place) AS title, arg_min(url, place) AS url, arg_min(domain, place) AS domain, arg_min(source_id, place) AS source_id, arg_min(chunk_index, place) AS chunk_index, arg_min(total_chunks, place) AS total_chunks, round(arg_min(score, place), 6) AS score FROM cited GROUP BY query_id, citation_id")
def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cite.citations(cite.assign_source_citations(hits(spark, sf_dir)))
    return own.withColumn("score", F.round("score", 6)).select("query_id", "citation_id", "title", "url", "domain", "source_id", "chunk_index", "total_chunks", "score")


@query(f"WITH {BLOCKS_SQL} SELECT query_id, citation_id, block FROM blocks")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.merged_blocks(cite.assign_source_citations(hits(spark, sf_dir)))


CONTEXT_SQL = BLOCKS_SQL + r""",
ctx AS (SELECT item_id AS query_id, text AS query, coalesce(context, '') AS context FROM benchmark LEFT JOIN (SELECT query_id, string_agg(block, E'\n\n---\n\n' ORDER BY citation_id) AS context FROM blocks GROUP BY query_id) ON query_id = item_id)"""


@query(f"WITH {CONTEXT_SQL} SELECT query_id, context, sha256(context)[1:12] AS context_hash FROM ctx")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.build_context(hits(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "context", "context_hash")


@query(
    f"WITH {HITS_SQL}"
    + r""" SELECT item_id AS query_id, string_agg('[' || pos::VARCHAR || E']\nSource ID: ' || source_id || E'\nTitle: ' || title || E'\nURL: ' || url || E'\nDomain: ' || domain || E'\n\nContent:\n' || content, E'\n\n---\n\n' ORDER BY score DESC, pos) AS context, count(*) AS n_sources FROM benchmark JOIN hits ON query_id = item_id GROUP BY item_id"""
)
def hit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cite.format_context(hits(spark, sf_dir), questions(spark, sf_dir))
    return own.where("mapping is not null").select("query_id", "context", F.size("mapping").cast("long").alias("n_sources"))


@query(f"WITH {HITS_SQL} SELECT query_id, min(pos) AS pos, string_split(string_split(url, '#')[1], '?')[1] AS plain, title, chunk_index FROM hits GROUP BY query_id, plain, title, chunk_index")
def display_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cite.dedupe_sources(hits(spark, sf_dir))
    return own.select("query_id", "pos", F.substring_index(F.substring_index("url", "#", 1), "?", 1).alias("plain"), "title", "chunk_index")


@query(f"WITH {ANSWERS_SQL} SELECT query_id, (list_reduce(list_prepend(answer, coalesce(m, [])), lambda t, c: replace(t, '[' || string_split(c, chr(1))[1] || ']', '<a href=\"' || string_split(c, chr(1))[2] || '\" target=\"_blank\" rel=\"noopener noreferrer\">[' || string_split(c, chr(1))[1] || ']</a>'))) AS linked FROM ans LEFT JOIN (SELECT query_id, list(citation_id::VARCHAR || chr(1) || url ORDER BY citation_id) AS m FROM cit GROUP BY query_id) USING (query_id)")
def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cite.linkify_citations(answers(spark, sf_dir), answer_citations(spark, sf_dir)).select("query_id", "linked")


@query(f"WITH {ANSWERS_SQL} SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'Sources: Web search results' ELSE coalesce(p, 'No sources yet...') END AS panel FROM ans LEFT JOIN (SELECT query_id, string_agg('**[' || citation_id::VARCHAR || ']** [' || title || '](' || url || ') — *' || domain || '* (source: ' || source_id || ')', E'\\n\\n' ORDER BY citation_id) AS p FROM cit GROUP BY query_id) USING (query_id)")
def source_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answers(spark, sf_dir).select("query_id", (F.col("query_id") % 5 != 0).alias("citations_valid"))
    return cite.format_sources(answer_citations(spark, sf_dir), own)


ENGLISH_SQL = """en AS (SELECT conv_id, turn, CASE turn % 9 WHEN 0 THEN 'Compare both schemes ' WHEN 1 THEN 'How to calculate it ' WHEN 2 THEN 'Which steps ' WHEN 3 THEN 'Is it allowed ' WHEN 4 THEN 'What is this ' WHEN 5 THEN 'What is the due date ' WHEN 6 THEN 'Definition of ' WHEN 7 THEN 'Explain ' ELSE '' END || text AS q FROM conversations)"""
CLASS_SQL = r"""tk AS (SELECT *, lower(q) AS low, list_concat(w, list_transform(list_filter(w, lambda x: len(x) > 1 AND x LIKE '%s'), lambda x: x[1:-2])) AS t FROM (SELECT *, regexp_extract_all(lower(q), '[a-z]+') AS w FROM en)),
cl AS (SELECT *, CASE WHEN list_has_any(t, ['compare','difference','analyse','analyze','why','how','procedure','step','calculation','basis','interpret','example','explain']) THEN 'detailed' ELSE 'concise' END AS verbosity,
  CASE WHEN list_has_any(t, ['compare','comparison','difference','differences','versus','vs']) THEN 'COMPARISON' WHEN list_has_any(t, ['calculate','calculation','compute','computed','computation']) THEN 'CALCULATION'
   WHEN list_has_any(t, ['procedure','process','step','steps','file','apply','register','submit','obtain']) THEN 'PROCEDURAL'
   WHEN list_has_any(t, ['interpret','interpretation','section','provision','legality','legal','valid','validity','allowed','entitled','permitted','admissible','whether']) THEN 'LEGAL_INTERPRETATION'
   WHEN (list_has_any(t, ['define','definition','meaning']) OR contains(low, 'what is') OR contains(low, 'what are') OR contains(low, 'whats') OR contains(low, 'what''s')) AND NOT list_has_any(t, ['due','deadline','rate','amount','limit','date','year','who','when','where']) THEN 'DEFINITION' ELSE 'FACTUAL' END AS question_type FROM tk)"""


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = ["Compare both schemes ", "How to calculate it ", "Which steps ", "Is it allowed ", "What is this ", "What is the due date ", "Definition of ", "Explain ", ""]
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("turn") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(start, "text").alias("q"))


@query(f"WITH {ENGLISH_SQL}, {CLASS_SQL} SELECT conv_id, turn, verbosity, question_type, least(16384, CASE WHEN verbosity = 'detailed' THEN 8192 ELSE 4096 END * 2 ** (turn % 4))::INTEGER AS budget FROM cl")
def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _english(spark, sf_dir).withColumns({"verbosity": classes.classify_verbosity(F.col("q")), "question_type": classes.classify_question_type(F.col("q"))})
    return own.select("conv_id", "turn", "verbosity", "question_type", classes.token_budget(F.col("verbosity"), (F.col("turn") % 4).cast("int")).alias("budget"))


LAYERS = ["Answer only from the sources.", "Question type: $question_type, $verbosity.", "  ", "Sources:\n$context\n\nQuestion: $question $unknown"]


@query(
    f"WITH {CONTEXT_SQL}, pr AS (SELECT query_id, 'Answer only from the sources.' || E'\\n\\n' || 'Question type: FACTUAL, concise.' || E'\\n\\n' || rtrim(E'Sources:\\n' || context || E'\\n\\nQuestion: ' || query || ' $unknown') AS prompt FROM ctx) SELECT query_id, prompt, sha256(prompt)[1:12] AS prompt_hash, 'default' AS pipeline_id, '1' AS pipeline_version FROM pr"
)
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    own = asked.withColumns({"verbosity": F.lit("concise"), "question_type": F.lit("FACTUAL")})
    return prompts.render_prompts(own, cite.build_context(hits(spark, sf_dir), asked), LAYERS)


@query(r"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN E'[Uploaded PDF content]\n' || text[1:20000] || E'\n\n[User question]\n' || role ELSE role END AS message FROM conversations")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classes.with_attachment(F.col("role"), F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("message"))


@query(r"""WITH m AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS t, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN last = 'user' THEN t ELSE t || E'\nuser: and ' || conv_id::VARCHAR END AS thread, CASE WHEN last = 'user' THEN n ELSE n + 1 END AS n FROM m""")
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id").distinct().withColumn("query", F.concat(F.lit("and "), F.col("conv_id").cast("string")))
    own = prompts.assemble_threads(turns, asked)
    return own.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("thread"), F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''), 'I could not generate a response.') AS text FROM conversations GROUP BY conv_id")
def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.last_assistant(table(spark, sf_dir, "conversations"))


@query(f"WITH {VALID_SQL} SELECT query_id, body, array_to_string(list_transform(cited_ids, lambda x: x::VARCHAR), ',') AS cited, word_count::INTEGER AS word_count, status, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings, retryable FROM val")
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = validation.validate_answers(answers(spark, sf_dir), answer_citations(spark, sf_dir))
    return own.select("query_id", "body", F.array_join(F.transform("cited_ids", lambda n: n.cast("string")), ",").alias("cited"), "word_count", "status", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "retryable")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = answer_citations(spark, sf_dir)
    return validation.score_answers(validation.validate_answers(answers(spark, sf_dir), cited), cited)


@query(f"WITH {SCORED_SQL} SELECT query_id, answer, confidence, citations_valid, retryable, truncated, length_warning, array_to_string(errors, '|') AS errors FROM scored")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "answer", "confidence", "citations_valid", "retryable", "truncated", "length_warning", F.array_join("errors", "|").alias("errors"))


@query(
    f"""WITH {SCORED_SQL} SELECT query_id, CASE WHEN ((NOT citations_valid AND retryable) OR truncated) AND retry_count < 2 AND answer <> '' AND NOT contains(answer, 'llm_service is required') THEN 'retry' ELSE 'finalize' END AS retry_route,
 CASE WHEN truncated AND retry_count < 2 THEN 'retry' WHEN NOT citations_valid AND retryable AND retry_count < 2 THEN 'retry' WHEN len(source_ids) = 0 THEN 'fallback' WHEN NOT citations_valid OR confidence < 0.5 THEN 'fallback' ELSE 'finalize' END AS fallback_route FROM scored"""
)
def answer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = validation.route_answers(_scored(spark, sf_dir), "retry").withColumnRenamed("route", "retry_route")
    return validation.route_answers(own, "fallback").select("query_id", "retry_route", F.col("route").alias("fallback_route"))


@query(
    f"""WITH {SCORED_SQL} SELECT query_id, query, answer AS response, CASE WHEN citations_valid THEN len(source_ids) ELSE 0 END::INTEGER AS n_sources, CASE WHEN citations_valid THEN coalesce(u, '') ELSE '' END AS urls, 1::BIGINT AS total_chunks_retrieved, citations_valid, truncated
FROM scored LEFT JOIN (SELECT query_id, string_agg(url, ',' ORDER BY citation_id) AS u FROM cit GROUP BY query_id) USING (query_id)"""
)
def final_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = answers(spark, sf_dir).select("query_id", F.lit(1).alias("pos"), F.col("query").alias("content"))
    own = validation.finalize_results(_scored(spark, sf_dir), answer_citations(spark, sf_dir), retrieved)
    return own.select("query_id", "query", "response", F.size("citation_map").alias("n_sources"), F.array_join(F.transform("slim_sources", lambda s: s["url"]), ",").alias("urls"), "total_chunks_retrieved", "citations_valid", "truncated")


@query(r"""SELECT conv_id AS query_id, bool_or(regexp_replace(o, '\s+', '', 'g') = '' OR regexp_matches(o, '(?i)(?:could not|cannot|couldn''t|unable to|no information|not found|not available)')) AS needs_fallback
FROM (SELECT conv_id, CASE (conv_id + turn) % 5 WHEN 0 THEN ' ' WHEN 1 THEN text || ' Could NOT say' ELSE text END AS o FROM conversations) GROUP BY conv_id""")
def fallback_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("conv_id") + F.col("turn")) % 5
    output = F.when(key == 0, " ").when(key == 1, F.concat("text", F.lit(" Could NOT say"))).otherwise(F.col("text"))
    return validation.needs_fallback(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), output.alias("output")))


#: Labels as judge scores; documents without a label have none.
SCORES_SQL = """sc AS (SELECT d.doc_id AS case_id, source AS metric, CASE WHEN l.doc_id IS NULL THEN NULL ELSE quality * 0.75 + toxic * 0.125 + (d.doc_id % 3) * 0.0625 END AS score, coalesce(toxic = 0, false) AS success FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    score = F.when(F.col("known"), F.col("quality") * 0.75 + F.col("toxic") * 0.125 + (F.col("doc_id") % 3) * 0.0625)
    own = docs.join(labels, "doc_id", "left")
    return own.select(F.col("doc_id").alias("case_id"), F.col("source").alias("metric"), score.alias("score"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("success"))


@query(f"WITH {SCORES_SQL} SELECT metric, round(avg(score), 6) AS mean, min(score)::DOUBLE AS min, max(score)::DOUBLE AS max, round(avg(success::INTEGER), 6) AS pass_rate, count(*) AS cases FROM sc WHERE score IS NOT NULL GROUP BY metric")
def metric_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = evaluation.aggregate_metrics(_judged(spark, sf_dir))
    return own.select("metric", F.round("mean", 6).alias("mean"), "min", "max", F.round("pass_rate", 6).alias("pass_rate"), "cases")


@query(f"WITH {SCORES_SQL} SELECT round(coalesce(avg(score), 0), 6) AS overall, round(coalesce(avg(score), 0), 9) >= 0.5 AS passed FROM sc")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overall_score(_judged(spark, sf_dir), 0.5).select(F.round("overall", 6).alias("overall"), "passed")


@query(
    f"""WITH {SCORES_SQL} SELECT item_id AS case_id, metric, score::DOUBLE AS score, CASE WHEN metric IS NULL THEN NULL WHEN metric = 'src0' THEN 0.75 ELSE 0.5 END::DOUBLE AS threshold,
CASE WHEN metric IS NOT NULL THEN coalesce(score >= CASE WHEN metric = 'src0' THEN 0.75 ELSE 0.5 END, false) END AS success FROM (SELECT 2 * item_id AS item_id FROM benchmark) LEFT JOIN sc ON case_id = item_id AND metric IN ('src0', 'src1', 'src2', 'src3')"""
)
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("src0", 0.75), ("src1", 0.5), ("src2", 0.5), ("src3", 0.5)], "metric string, threshold double")
    cases = table(spark, sf_dir, "benchmark").select((2 * F.col("item_id")).alias("case_id"))
    scores = evaluation.apply_thresholds(_judged(spark, sf_dir).drop("success"), limits)
    return evaluation.attach_scores(cases, scores).select("case_id", "metric", "score", "threshold", "success")


#: Sources as metrics with names that have a limit of their own; the second limit is another, and the first five count.
LIMITED = list(evaluation.THRESHOLDS)


@query(
    f"""WITH {SCORES_SQL}, named AS (SELECT case_id, list_value({', '.join(f"'{m}'" for m in LIMITED)})[1 + substr(metric, 4)::INTEGER] AS metric, score FROM sc)
SELECT case_id, metric, score::DOUBLE AS score, CASE WHEN metric = '{LIMITED[1]}' THEN 0.75 ELSE 0.5 END::DOUBLE AS threshold, coalesce(score >= CASE WHEN metric = '{LIMITED[1]}' THEN 0.75 ELSE 0.5 END, false) AS success
FROM named WHERE metric IN ({', '.join(f"'{m}'" for m in LIMITED[:5])})"""
)
def limited_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores held against the default limits, one of them overridden."""
    names = F.try_element_at(F.array(*[F.lit(m) for m in LIMITED]), F.substring("metric", 4, 2).cast("int") + 1)
    own = _judged(spark, sf_dir).drop("success").withColumn("metric", names)
    limits = evaluation.metric_thresholds(spark, {LIMITED[1]: 0.75}, LIMITED[:5])
    return evaluation.apply_thresholds(own, limits).select("case_id", "metric", "score", "threshold", "success")


@query("SELECT item_id AS id, line, question FROM (SELECT item_id, row_number() OVER (ORDER BY item_id)::INTEGER AS line, text AS question FROM benchmark) WHERE line > 5 AND line <= 30")
def selected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") + 1).cast("int").alias("line"), F.col("text").alias("question"), F.col("text").alias("expected_answer"))
    return evaluation.select_cases(golden.withColumn("id", F.col("id").cast("string")), 5, 25).select(F.col("id").cast("long").alias("id"), "line", "question")


IDENTITY_SQL = "idt AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' ABCDE1234F' WHEN 1 THEN text || ' 22ABCDE1234F1Z5 and PQRST6789K' WHEN 2 THEN '2345 6789 0123' WHEN 3 THEN text || ' 2345 6789 0123' ELSE text END AS t FROM documents)"


GSTIN_SQL, PAN_SQL, AADHAAR_SQL = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", "[A-Z]{5}[0-9]{4}[A-Z]", r"^[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}$"


@query(
    f"""WITH {IDENTITY_SQL}, marked AS (SELECT doc_id, t, regexp_replace(t, '([0-9]{{2}})({PAN_SQL})([1-9A-Z]Z[0-9A-Z])', '\\1' || chr(1) || '\\2\\3', 'g') AS m FROM idt)
SELECT doc_id, regexp_replace(replace(regexp_replace(m, '(^|[^' || chr(1) || '])({PAN_SQL})', '\\1[PAN_MASKED]', 'g'), chr(1), ''), '{AADHAAR_SQL}', '[AADHAAR_MASKED]') AS masked,
 regexp_replace(regexp_replace(regexp_replace(t, '{GSTIN_SQL}', '[GSTIN_MASKED]', 'g'), '{PAN_SQL}', '[PAN_MASKED]', 'g'), '{AADHAAR_SQL}', '[AADHAAR_MASKED]') AS logged FROM marked"""
)
def masked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = F.col("text"), F.col("doc_id") % 5
    own = F.when(d == 0, F.concat(t, F.lit(" ABCDE1234F"))).when(d == 1, F.concat(t, F.lit(" 22ABCDE1234F1Z5 and PQRST6789K"))).when(d == 2, "2345 6789 0123").when(d == 3, F.concat(t, F.lit(" 2345 6789 0123"))).otherwise(t)
    docs = table(spark, sf_dir, "documents").select("doc_id", own.alias("t"))
    return docs.select("doc_id", masking.mask_identities(F.col("t")).alias("masked"), masking.mask_identities(F.col("t"), for_logs=True).alias("logged"))


@query("SELECT r_name AS domain, n_name AS subcategory FROM region JOIN nation ON n_regionkey = r_regionkey")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    grouped = nations.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    regions = table(spark, sf_dir, "region").join(grouped, F.col("r_regionkey") == F.col("n_regionkey"))
    own = regions.select(
        F.col("r_name").alias("id"),
        F.col("r_name").alias("name"),
        F.when(F.col("r_regionkey") > 0, F.col("names")).alias("subcategories"),
        F.when(F.col("r_regionkey") == 0, F.map_from_arrays("names", "names")).alias("subcategory_map"),
    )
    return evaluation.taxonomy_table(own).select("domain", "subcategory")


def _three(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'n/a' ELSE printf('%.3f', {name}) END"


REPORT_SQL = f"""{SCORES_SQL},
agg AS (SELECT metric, round(avg(score), 9) AS mean, min(score) AS low, max(score) AS high, round(avg(success::INTEGER), 9) AS rate, count(*) AS cases FROM sc WHERE score IS NOT NULL GROUP BY metric),
lines AS (SELECT case_id, string_agg('| ' || metric || ' | ' || {_three("score")} || ' | 0.500 | ' || CASE WHEN success THEN 'yes' ELSE 'no' END || ' | a\\|' || metric || ' |', chr(10) ORDER BY metric) AS rows FROM sc GROUP BY case_id)"""


@query(rf"""WITH {REPORT_SQL}
SELECT 0 AS part, printf('| %s | %.3f | %.3f | %.3f | %.0f%% | %d |', metric, mean, low, high, rate * 100, cases) AS line FROM agg UNION ALL
SELECT 1, concat_ws(chr(10), '### ' || doc_id::VARCHAR, '', '- **Latency:** 0.0 ms', '- **Input:** ' || lang, '', '| Metric | Score | Threshold | Pass | Reason |', '|---|---|---|---|---|', rows) FROM documents JOIN lines ON case_id = doc_id""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _judged(spark, sf_dir).withColumns({"case_id": F.col("case_id").cast("string"), "threshold": F.lit(0.5), "reason": F.concat(F.lit("a|"), "metric")})
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("input"), F.lit(0.0).alias("latency_ms"))
    return evaluation.report_lines(cases, scores).select("part", "line")


@query(f"WITH {SCORED_SQL} SELECT query_id, NOT citations_valid OR contains(answer, 'I could not find this information') OR contains(answer, '{validation.NO_RETRIEVAL}') AS needs_fallback FROM scored")
def answer_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", validation.answer_needs_fallback(F.col("answer"), F.col("citations_valid")).alias("needs_fallback"))


@query(rf"""WITH {CITED_SQL}, ids AS (SELECT query_id, citation_id, arg_max(source_id, pos) AS source_id FROM cited GROUP BY query_id, citation_id),
maps AS (SELECT query_id, string_agg(citation_id::VARCHAR || '=' || source_id, ',' ORDER BY citation_id) AS mapping FROM ids GROUP BY query_id)
SELECT query_id, string_agg('[' || citation_id::VARCHAR || E']\nSource ID: ' || source_id || E'\nTitle: ' || title || E'\nURL: ' || url || E'\nDomain: ' || domain || E'\n\nContent:\n' || content, E'\n\n---\n\n' ORDER BY score DESC, pos) AS context, mapping
FROM cited JOIN maps USING (query_id) GROUP BY query_id, mapping""")
def shared_id_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of hits whose ids are those of their sources, so that several hits share one."""
    own = cite.format_context(cite.assign_source_citations(hits(spark, sf_dir)), questions(spark, sf_dir)).where("mapping is not null")
    pairs = F.array_sort(F.map_entries("mapping"))
    return own.select("query_id", "context", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("mapping"))
