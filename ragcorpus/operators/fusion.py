"""Fusion of rankings, reranking, authority-biased selection, and whole retrieval strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragcorpus.functions.authority import authority_bonus, safe_score
from ragcorpus.operators.bm25 import Bm25Index, bm25_topk
from ragcorpus.operators.dense import knn
from ragcorpus.sources.scratch import save

RRF_K = 60
Scorer = Callable[[list[str], list[str]], list[float]]


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, rank, content, chunk_id, score): reciprocal rank fusion of two arms(query_id, rank, chunk_id,
    content), keyed on the content.

    Content that the dense arm holds twice counts by its last rank, in the lexical arm the parts add up. The kept row is
    the last dense one, else the first lexical one. Ties: dense first, in order of first appearance.
    """
    key = ["query_id", F.xxhash64("content").alias("hash"), "content"]
    a = dense.groupBy(*key).agg(F.max("rank").alias("last"), F.min("rank").alias("first"), F.max_by("chunk_id", "rank").alias("chunk_id"))
    b = lexical.groupBy(*key).agg(F.sum(1 / (k + F.col("rank"))).alias("part"), F.min("rank").alias("first"), F.min_by("chunk_id", "rank").alias("chunk_id"))
    a = a.select("query_id", "hash", "content", (1 / (k + F.col("last"))).alias("part"), F.lit(0).alias("arm"), "first", "chunk_id")
    b = b.select("query_id", "hash", "content", "part", F.lit(1).alias("arm"), "first", "chunk_id")
    fused = a.unionByName(b).groupBy("query_id", "hash", "content").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("arm", "first", "chunk_id")).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best.arm", "best.first", "best.chunk_id")
    return fused.select("query_id", F.row_number().over(order).alias("rank"), "content", F.col("best.chunk_id").alias("chunk_id"), "score")


def with_chunks(arms: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arms(query_id, rank, chunk_id, ...) and the chunks that they name, as tables. The arms have few rows a query, so chunks
    are picked where they are; all of them would be shuffled if the arms' size were not known."""
    found, _ = save(arms)
    return found, save(chunks.join(found.select("chunk_id"), "chunk_id", "left_semi"))[0]


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Share of the query's distinct words that the text has."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return out


def rerank(candidates: DataFrame, scorer: Scorer = overlap_scorer, top_k: int | None = None) -> DataFrame:
    """candidates(query_id, rank, query, content, ...) with rank and score replaced by a pair scorer; ties keep
    their order."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(scorer(list(q), list(t)), dtype=float)

    scored = candidates.withColumn("score", F.round(score("query", "content"), 9)).withColumn("reranked", F.lit(True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_before")
    ranked = scored.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order)).drop("_before")
    return ranked.where(F.col("rank") <= top_k) if top_k is not None else ranked


def select_with_authority(candidates: DataFrame, top_k: int = 5, bonuses: Mapping[str, float] | None = None, enabled: bool = True) -> DataFrame:
    """The top_k candidates(query_id, rank, score, source_type, ...) by score scaled to 0..1 within the query plus the
    source type's bonus. score stays raw; authority_score is added; rank is the new one."""
    pool = Window.partitionBy("query_id")
    raw = safe_score(F.col("score"))
    scored = candidates.withColumn("_raw", raw)
    low, high = F.min("_raw").over(pool), F.max("_raw").over(pool)
    if enabled:
        scaled = F.when(high > low, (F.col("_raw") - low) / (high - low)).otherwise(F.lit(1.0))
        scored = scored.withColumn("authority_score", F.round(scaled + authority_bonus(F.col("source_type"), bonuses), 9))
        order = Window.partitionBy("query_id").orderBy(F.desc("authority_score"), F.desc("_raw"), "_before")
    else:
        scored = scored.withColumn("authority_score", F.col("_raw"))
        order = Window.partitionBy("query_id").orderBy(F.desc("_raw"), "_before")
    ranked = scored.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_k).drop("_raw", "_before")


def retrieve(chunks: DataFrame, queries: DataFrame, index: Bm25Index | None = None, strategy: str = "hybrid", fetch_k: int = 20, top_k: int = 5, scorer: Scorer | None = overlap_scorer, bonuses: Mapping[str, float] | None = None, authority: bool = True) -> DataFrame:
    """Retrieval for many queries in one job: `hybrid` (dense and BM25, fused), or `dense`; reranked unless scorer is
    None; then the authority-biased selection.

    chunks(chunk_id, content, source_type, embedding, ...); queries(query_id, query, embedding).
    """
    if strategy not in ("hybrid", "dense"):
        raise ValueError(f"unknown strategy {strategy!r}")
    near, own = knn(chunks, queries, fetch_k, with_score=True), chunks.drop("embedding", "score")
    if strategy == "hybrid":
        if index is None:
            raise ValueError("hybrid retrieval needs a BM25 index")
        lexical = bm25_topk(index, queries, fetch_k)
        # one join brings the contents of both arms, at most 2 x fetch_k rows a query
        found, own = with_chunks(near.select("query_id", "rank", "chunk_id", F.lit(0).alias("arm")).unionByName(lexical.select("query_id", "rank", "chunk_id", F.lit(1).alias("arm"))), own)
        arms = found.join(own.select("chunk_id", "content"), "chunk_id")
        pool = rrf(arms.where("arm = 0"), arms.where("arm = 1"))
    else:
        found, own = with_chunks(near, own)
        pool = found.join(own.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "content", "chunk_id", "score")
    if scorer is not None:
        pool = rerank(pool.join(queries.select("query_id", "query"), "query_id"), scorer).drop("query")
    return select_with_authority(pool.join(own.drop("content"), "chunk_id"), top_k, bonuses, authority)


def combine_search_results(results: DataFrame) -> DataFrame:
    """(query_id, text) from results(query_id, answer, results array of struct with content)."""
    top = F.slice(F.coalesce("results", F.array().cast(results.schema["results"].dataType)), 1, 3)
    contents = F.filter(F.transform(top, lambda r: r["content"]), lambda c: F.coalesce(c, F.lit("")) != "")
    text = (
        F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer"))
        .when(F.coalesce(F.size("results"), F.lit(0)) <= 0, "No search results found.")
        .when(F.size(contents) > 0, F.array_join(contents, "\n\n"))
        .otherwise("No content found in search results.")
    )
    return results.select("query_id", text.alias("text"))
