"""Validation, confidence, routing and final rows for a table of generated answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and texts that decide.
NOT_FOUND = ("could not find", "not available", "not found", "not covered", "does not contain", "do not contain", "no information", "unable to find")
NO_SOURCES = "No citation sources available"
SAYS_NOT_FOUND = "LLM indicated information not found in sources"
NO_CITATIONS = "No inline citations in response body"
UNKNOWN_CITATIONS = "Response contains citations not found in sources"
BAD_SPACING = "Citation spacing should use compact [n] format"
TRUNCATED = "LLM response truncated by token cap"
NO_RETRIEVAL = "No authoritative source was found in the retrieved documents."
NO_SERVICE = "llm_service is required"
WORD_CAP = 500
MAX_RETRIES = 2
FALLBACK = r"(?i)(?:could not|cannot|couldn't|unable to|no information|not found|not available)"


def answer_body(answer: Column) -> Column:
    """The answer before its list of sources."""
    return F.get(F.split(answer, r"\n\s*(?:Sources|References|स्रोत)\s*:?\s*\n", 2), F.lit(0))


def cited_ids(body: Column) -> Column:
    """All [n] of a text in order, repeats kept; numbers beyond a bigint are null."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda n: n.try_cast("bigint"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _finding(status: str, error: Column | None = None, warning: Column | None = None, retryable: bool = False) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), (error if error is not None else none).alias("error"), (warning if warning is not None else none).alias("warning"), F.lit(retryable).alias("retryable"))


def citation_rule() -> Column:
    low = F.lower("body")
    said = F.lit(False)
    for phrase in NOT_FOUND:
        said = said | low.contains(phrase)
    return (
        F.when(F.size("source_ids") == 0, _finding("fail", F.lit(NO_SOURCES)))
        .when(said, _finding("fail", F.lit(SAYS_NOT_FOUND)))
        .when(F.size("cited_ids") == 0, _finding("fail", F.lit(NO_CITATIONS), retryable=True))
        .when(F.size(F.array_except("cited_ids", "source_ids")) > 0, _finding("fail", F.lit(UNKNOWN_CITATIONS), retryable=True))
        .otherwise(_finding("pass"))
    )


def formatting_rule() -> Column:
    return F.when(F.col("answer").rlike(r"\[\s+[0-9]+\s*\]|\[\s*[0-9]+\s+\]"), _finding("warn", warning=F.lit(BAD_SPACING))).otherwise(_finding("pass"))


def length_rule() -> Column:
    long = (F.coalesce("verbosity", F.lit("concise")) == "concise") & (F.col("word_count") > WORD_CAP)
    return F.when(long, _finding("warn", warning=F.concat(F.lit("Concise response has "), F.col("word_count").cast("string"), F.lit(" words")))).otherwise(_finding("pass"))


def truncation_rule() -> Column:
    return F.when(F.col("finish_reason") == "length", _finding("fail", F.lit(TRUNCATED), retryable=True)).otherwise(_finding("pass"))


RULES = (citation_rule, formatting_rule, length_rule, truncation_rule)


def validate_answers(answers: DataFrame, citations: DataFrame, rules: Sequence = RULES) -> DataFrame:
    """answers(query_id, answer, verbosity, finish_reason, ...) with body, cited_ids, source_ids, word_count, status,
    errors, warnings and retryable. A rule is a function that gives a struct column (status, error, warning, retryable)."""
    known = citations.groupBy("query_id").agg(F.sort_array(F.collect_set(F.col("citation_id").cast("bigint"))).alias("source_ids"))
    own = answers.join(known, "query_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<bigint>")))
    own = own.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("body", answer_body(F.col("answer")))
    own = own.withColumn("cited_ids", cited_ids(F.col("body"))).withColumn("word_count", word_count(F.col("body")))
    own = own.withColumn("_found", F.array(*[rule() for rule in rules]))
    has = lambda s: F.exists("_found", lambda r: r["status"] == s)
    return own.withColumns(
        {
            "status": F.when(has("fail"), "fail").when(has("warn"), "warn").otherwise("pass"),
            "errors": F.array_compact(F.transform("_found", lambda r: r["error"])),
            "warnings": F.array_compact(F.transform("_found", lambda r: r["warning"])),
            "retryable": F.exists("_found", lambda r: r["retryable"]),
        }
    ).drop("_found")


def source_list(citations: DataFrame) -> DataFrame:
    """(query_id, source_list): one `[n] title - url` a line."""
    line = F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] "), "title", F.lit(" - "), "url", F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct("citation_id", line.alias("line"))))
    return citations.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("source_list"))


def score_answers(validated: DataFrame, citations: DataFrame) -> DataFrame:
    """validated with confidence, citations_valid, truncated and length_warning; a citation defect appends the
    sources to the answer and, unless the answer was cut off, is forgiven."""
    has = lambda e: F.array_contains("errors", e)
    truncated = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    defect = has(NO_CITATIONS) | has(UNKNOWN_CITATIONS)
    long = (F.coalesce("verbosity", F.lit("concise")) == "concise") & (F.col("word_count") > WORD_CAP)
    base = F.when(F.size("source_ids") == 0, 0.0).when(has(SAYS_NOT_FOUND), 0.3).when(defect | has(TRUNCATED), 0.4).otherwise(0.8)
    forgiven = defect & ~truncated
    joined = validated.join(source_list(citations), "query_id", "left")
    scored = joined.withColumns(
        {
            "confidence": F.when(forgiven, 0.8).when(long, F.least(base, F.lit(0.5))).otherwise(base),
            "citations_valid": forgiven | (F.col("status") != "fail"),
            "retryable": F.col("retryable") & ~forgiven,
            "answer": F.when(defect, F.concat("answer", F.lit("\n\n**Sources:**\n"), F.coalesce("source_list", F.lit("")))).otherwise(F.col("answer")),
            "truncated": truncated,
            "length_warning": long,
            "errors": F.when(forgiven, F.array_except("errors", F.array(F.lit(NO_CITATIONS), F.lit(UNKNOWN_CITATIONS)))).otherwise(F.col("errors")),
        }
    )
    return scored.drop("source_list")


def route_answers(scored: DataFrame, mode: str = "retry", max_retries: int = MAX_RETRIES) -> DataFrame:
    """scored with `route`: retry or finalize (mode `retry`), or retry, fallback or finalize (mode `fallback`)."""
    left = F.coalesce("retry_count", F.lit(0)) < max_retries
    again = ~F.col("citations_valid") & F.col("retryable")
    if mode == "retry":
        usable = (F.col("answer") != "") & ~F.contains(F.col("answer"), F.lit(NO_SERVICE))
        route = F.when((again | F.col("truncated")) & left & usable, "retry").otherwise("finalize")
    elif mode == "fallback":
        route = (
            F.when(F.col("truncated") & left, "retry")
            .when(again & left, "retry")
            .when(F.size("source_ids") == 0, "fallback")
            .when(~F.col("citations_valid") | (F.col("confidence") < 0.5), "fallback")
            .otherwise("finalize")
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return scored.withColumn("route", route)


def finalize_results(scored: DataFrame, citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query, response, sources, citation_map, raw_chunks, total_chunks_retrieved, citations_valid, truncated,
    slim_sources); sources and map are empty for answers that are not valid."""
    fields = ["citation_id", "title", "url", "domain", "source_id", "chunk_index", "total_chunks", "score"]
    sources = citations.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all_sources"))
    chunks = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("_c"))
    joined = scored.join(sources, "query_id", "left").join(chunks, "query_id", "left")
    kept = F.when(F.col("citations_valid") & F.col("all_sources").isNotNull(), F.col("all_sources")).otherwise(F.array().cast(sources.schema["all_sources"].dataType))
    return joined.withColumn("sources", kept).select(
        "query_id",
        "query",
        F.col("answer").alias("response"),
        "sources",
        F.map_from_entries(F.transform("sources", lambda s: F.struct(s["citation_id"], s))).alias("citation_map"),
        F.coalesce(F.transform("_c", lambda c: c["content"]), F.array().cast("array<string>")).alias("raw_chunks"),
        F.coalesce(F.size("_c"), F.lit(0)).cast("long").alias("total_chunks_retrieved"),
        "citations_valid",
        "truncated",
        F.transform("sources", lambda s: F.struct(*[s[f].alias(f) for f in ("citation_id", "title", "url", "domain", "score")])).alias("slim_sources"),
    )


def needs_fallback(tool_results: DataFrame) -> DataFrame:
    """(query_id, needs_fallback): true where any output is blank or says that nothing was found, or any tool failed."""
    output = F.col("output")
    blank = F.regexp_replace(output, r"\s+", "") == ""
    failed = F.col("error").isNotNull() if "error" in tool_results.columns else F.lit(False)
    flag = F.coalesce(blank | output.rlike(FALLBACK) | failed, F.lit(False))
    return tool_results.groupBy("query_id").agg(F.bool_or(flag).alias("needs_fallback"))


def answer_needs_fallback(answer: Column, citations_valid: Column) -> Column:
    return ~citations_valid | answer.contains("I could not find this information") | answer.contains(NO_RETRIEVAL)
