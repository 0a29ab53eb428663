"""Retrieval metrics, evaluation cases, aggregates, reports and the domain taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragcorpus.functions.authority import AUTHORITATIVE

# Metrics and the score from which on they pass.
THRESHOLDS = {"faithfulness": 0.5, "answer_relevancy": 0.5, "contextual_relevancy": 0.5, "contextual_precision": 0.5, "contextual_recall": 0.5, "hallucination": 0.5, "correctness": 0.5}


def _authoritative() -> Column:
    return F.col("source_type").isin(*AUTHORITATIVE)


def _share(k: int) -> Column:
    return F.coalesce(F.avg(F.when(F.col("rank") <= k, F.when(_authoritative(), 1.0).otherwise(0.0))), F.lit(0.0))


def authority_at_k(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, value): share of authoritative hits among the first k present; 0 for queries without hits."""
    return queries.select("query_id").join(hits.groupBy("query_id").agg(_share(k).alias("value")), "query_id", "left").fillna(0.0, ["value"])


def first_authoritative_rank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank): rank of the first authoritative hit, null where there is none."""
    found = hits.groupBy("query_id").agg(F.min(F.when(_authoritative(), F.col("rank"))).alias("first_rank"))
    return queries.select("query_id").join(found, "query_id", "left")


def retrieval_metrics(hits: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """Per query the shares at top_k, 1, 3 and 5, the first authoritative rank, and counts, in one pass over hits."""
    found = hits.groupBy("query_id").agg(
        *[_share(k).alias(n) for n, k in (("authority_at_top_k", top_k), ("authority_at_1", 1), ("authority_at_3", 3), ("authority_at_5", 5))],
        F.min(F.when(_authoritative(), F.col("rank"))).alias("first_rank"),
        F.count_if(_authoritative()).alias("n_authoritative"),
        F.count("*").alias("n_retrieved"),
    )
    return queries.select("query_id").join(found, "query_id", "left").fillna(0, ["authority_at_top_k", "authority_at_1", "authority_at_3", "authority_at_5", "n_authoritative", "n_retrieved"])


def select_cases(golden: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The golden(line, ...) rows of a range in file order. An empty range, or a blank question or answer, is an error
    when the result is read."""
    own = golden.orderBy("line").offset(offset)
    own = own.limit(limit) if limit is not None else own
    if own.limit(1).count() == 0:
        raise ValueError("no cases selected")
    for name in ("question", "expected_answer"):
        own = own.withColumn(name, F.when(F.btrim(F.coalesce(name, F.lit(""))) == "", F.raise_error(F.concat(F.lit(f"blank {name} in case "), "id"))).otherwise(F.col(name)))
    return own


def attach_scores(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """cases(case_id, ...) with one row for each of their metric scores; a case without any keeps one row of nulls."""
    return cases.join(scores, "case_id", "left")


def aggregate_metrics(scores: DataFrame) -> DataFrame:
    """(metric, mean, min, max, pass_rate, cases) over the scores that are not null."""
    known = scores.where("score is not null")
    rate = F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))
    return known.groupBy("metric").agg(F.round(F.avg("score"), 9).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.round(rate, 9).alias("pass_rate"), F.count("*").alias("cases"))


def overall_score(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: mean over all scores that are not null (0 when none), and whether it reaches the threshold."""
    mean = F.coalesce(F.round(F.avg("score"), 9), F.lit(0.0))
    passed = F.lit(True) if threshold is None else F.col("overall") >= threshold
    return scores.agg(mean.alias("overall")).withColumn("passed", passed)


def metric_thresholds(spark: SparkSession, overrides: Mapping[str, float] | None = None, include: Sequence[str] | None = None) -> DataFrame:
    """(metric, threshold): the defaults with overrides, only the included ones where given."""
    values = THRESHOLDS | dict(overrides or {})
    rows = [(m, float(t)) for m, t in values.items() if include is None or m in include]
    return spark.createDataFrame(rows, "metric string, threshold double")


def apply_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scores(case_id, metric, score, reason) with threshold and success; metrics without a threshold are left out."""
    joined = scores.join(thresholds, "metric")
    return joined.withColumn("success", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))


def taxonomy_table(domains: DataFrame) -> DataFrame:
    """(domain, name, subcategory, description) from domains(id, name, subcategories array, subcategory_map map)."""
    from_list = domains.select(F.col("id").alias("domain"), "name", F.explode("subcategories").alias("subcategory"), F.lit(None).cast("string").alias("description"))
    from_map = domains.select(F.col("id").alias("domain"), "name", F.explode("subcategory_map").alias("subcategory", "description"))
    return from_list.unionByName(from_map)


def _three(value: Column) -> Column:
    """Three places, halves to the even one."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", F.bround(value, 3)))


def report_lines(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """(part, at, line): the Markdown report's lines in order of part and at: aggregate table, then case blocks.

    cases(case_id, input, latency_ms); scores(case_id, metric, score, threshold, success, reason).
    """
    number = F.row_number().over(Window.orderBy("metric"))  # one row a metric
    table = aggregate_metrics(scores).select(
        F.lit(0).alias("part"),
        number.cast("long").alias("at"),
        F.format_string("| %s | %.3f | %.3f | %.3f | %.0f%% | %d |", "metric", *[F.bround(c, 3) for c in ("mean", "min", "max")], F.bround(F.col("pass_rate") * 100), "cases").alias("line"),
    )
    row = F.concat(F.lit("| "), "metric", F.lit(" | "), _three(F.col("score")), F.lit(" | "), _three(F.col("threshold")), F.lit(" | "), F.when(F.col("success"), "yes").otherwise("no"), F.lit(" | "), F.replace(F.coalesce("reason", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" |"))
    rows = scores.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("metric", row.alias("line")))).alias("rows"))
    head = F.array(F.concat(F.lit("### "), "case_id"), F.lit(""), F.format_string("- **Latency:** %.1f ms", "latency_ms"), F.concat(F.lit("- **Input:** "), "input"))
    metrics = F.concat(F.array(F.lit(""), F.lit("| Metric | Score | Threshold | Pass | Reason |"), F.lit("|---|---|---|---|---|")), F.transform("rows", lambda r: r["line"]))
    block = F.when(F.col("rows").isNull(), head).otherwise(F.concat(head, metrics))
    blocks = cases.join(rows, "case_id", "left").select(F.lit(1).alias("part"), F.xxhash64("case_id").alias("at"), F.array_join(block, "\n").alias("line"))
    return table.unionByName(blocks)


def write_report(cases: DataFrame, scores: DataFrame, path: str) -> None:
    """Write path/report (JSON lines: one aggregate row and the cases) and path/summary (Markdown), as files in order of
    their names: ranges of cases, so that no task holds them all."""
    aggregate = aggregate_metrics(scores).agg(F.sort_array(F.collect_list(F.struct("metric", "mean", "min", "max", "pass_rate", "cases"))).alias("aggregate"))
    overall = overall_score(scores).select("overall")
    per_case = cases.join(scores.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in scores.columns if c != "case_id"]))).alias("metric_scores")), "case_id", "left")
    head = aggregate.crossJoin(overall).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.to_json(F.struct("aggregate", "overall")).alias("value"))  # one row each
    body = per_case.select(F.lit(1).alias("part"), F.col("case_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
    head.unionByName(body).orderBy("part", "key").select("value").write.mode("overwrite").text(f"{path}/report")
    lines = report_lines(cases, scores).select("part", F.when(F.col("part") == 0, F.lpad(F.col("at").cast("string"), 6, "0")).otherwise(F.col("line")).alias("key"), F.col("line").alias("value"))
    title = cases.sparkSession.createDataFrame(
        [(-1, "0", "# Evaluation Report\n"), (-1, "1", "## Aggregate\n"), (-1, "2", "| Metric | Mean | Min | Max | Pass rate | Cases |\n|---|---|---|---|---|---|"), (0, "~", "\n## Per-case\n")], "part int, key string, value string"
    )
    lines.unionByName(title).orderBy("part", "key").select("value").write.mode("overwrite").text(f"{path}/summary")
