"""Citation ids, citation rows, and contexts for hits of many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragcorpus.functions.authority import authority_rank, classify_source_type
from ragcorpus.functions.text import escape_html, extract_snippet, normalize_url

SEPARATOR = "\n\n---\n\n"


def flatten_hits(hits: DataFrame) -> DataFrame:
    """hits with missing fields filled: source_id from source, url from citation_url, and defaults."""
    have = set(hits.columns)
    first = lambda names, default: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(default))
    filled = {
        "source_id": first(["source_id", "source"], "unknown"),
        "title": first(["title"], "Unknown"),
        "url": first(["citation_url", "url"], "unknown"),
        "domain": first(["domain"], "unknown"),
        "chunk_index": first(["chunk_index"], 0),
        "total_chunks": first(["total_chunks"], 1),
        "score": first(["score"], 0.0),
        "citation_id": first(["citation_id"], 1),
    }
    return hits.withColumns(filled)


def _type(hits: DataFrame) -> Column:
    have = set(hits.columns)
    url = F.coalesce(*[F.col(c) for c in ("citation_url", "url") if c in have], F.lit(""))
    return classify_source_type(F.col("title"), url, F.col("domain"), F.col("source_id"), F.col("source_type") if "source_type" in have else None)


def citation_order(hits: DataFrame) -> DataFrame:
    """hits(query_id, pos, ...) with `place`, 1 ..: authority, score, url, title, then the hit's own position."""
    order = Window.partitionBy("query_id").orderBy(F.col("_rank"), F.desc("score"), "url", "title", "pos")
    return hits.withColumn("_rank", authority_rank(_type(hits))).withColumn("place", F.row_number().over(order)).drop("_rank")


def assign_source_citations(hits: DataFrame) -> DataFrame:
    """hits with `place` and citation_id: one id for all chunks of a source, in order of its first place."""
    placed = citation_order(hits).withColumn("_url", normalize_url(F.col("url")))
    first = F.min("place").over(Window.partitionBy("query_id", "source_id", "_url", "title"))
    numbered = placed.withColumn("_first", first)
    return numbered.withColumn("citation_id", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))).drop("_url", "_first")


def citations(cited: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row a source from assign_source_citations: the fields of its first hit, and a snippet where queries
    (query_id, query) are given."""
    fields = ["title", "url", "domain", "source_id", "chunk_index", "total_chunks", "score", "content"]
    best = cited.groupBy("query_id", "citation_id").agg(F.min_by(F.struct(*fields), "place").alias("f")).select("query_id", "citation_id", "f.*")
    if queries is None:
        return best.drop("content")
    joined = best.join(queries.select("query_id", "query"), "query_id", "left")
    return joined.withColumn("snippet", extract_snippet(F.col("content"), F.coalesce("query", F.lit("")))).drop("content", "query")


def merged_blocks(cited: DataFrame) -> DataFrame:
    """(query_id, citation_id, block): a source's heading and its chunks by chunk_index."""
    chunks = F.sort_array(F.collect_list(F.struct("chunk_index", "place", "content")))
    grouped = cited.groupBy("query_id", "citation_id").agg(F.min_by(F.struct("source_id", "title", "url", "domain"), "place").alias("f"), chunks.alias("chunks"))
    head = F.format_string("[%d]\nSource ID: %s\nTitle: %s\nURL: %s\nDomain: %s", "citation_id", "f.source_id", "f.title", "f.url", "f.domain")
    body = F.transform("chunks", lambda c: F.concat(F.lit("Chunk "), c["chunk_index"].cast("string"), F.lit(":\n"), c["content"]))
    return grouped.select("query_id", "citation_id", F.concat_ws("\n", head, F.array_join(body, "\n")).alias("block"))


def build_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context, context_hash, documents): blocks in citation order and a fingerprint, for every query."""
    cited = assign_source_citations(flatten_hits(hits))
    blocks = merged_blocks(cited).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_id", "block"))).alias("b"))
    joined = blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), SEPARATOR).alias("context"))
    documents = citations(cited).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_id", "source_id", "chunk_index", "score"))).alias("documents"))
    every = queries.select("query_id").join(joined, "query_id", "left").join(documents, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return every.withColumn("context_hash", F.substring(F.sha2("context", 256), 1, 12)).select("query_id", "context", "context_hash", "documents")


def assign_citation_ids(hits: DataFrame) -> DataFrame:
    """hits with citation_id locked in input order (pos); an id that is set stays."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return hits.withColumn("citation_id", F.coalesce("citation_id", number) if "citation_id" in hits.columns else number)


def format_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context, mapping): one block a hit, best score first, ids locked before; empty for no hits.

    mapping has the source of each id, that of the last hit in input order where hits share an id.
    """
    flat = flatten_hits(assign_citation_ids(hits))
    block = F.format_string("[%d]\nSource ID: %s\nTitle: %s\nURL: %s\nDomain: %s\n\nContent:\n%s", "citation_id", "source_id", "title", "url", "domain", "content")
    blocks = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"), block.alias("block"))))
    listed = F.sort_array(F.collect_list(F.struct("citation_id", "pos", "source_id")))
    grouped = flat.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), SEPARATOR).alias("context"), listed.alias("listed"))
    # of hits that share an id the last names its source
    last = F.filter("listed", lambda x, i: F.coalesce(F.get("listed", i + 1)["citation_id"] != x["citation_id"], F.lit(True)))
    mapping = F.map_from_entries(F.transform(last, lambda x: F.struct(x["citation_id"], x["source_id"])))
    grouped = grouped.select("query_id", "context", mapping.alias("mapping"))
    return queries.select("query_id").join(grouped, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """The first of the sources(query_id, pos, url, title, chunk_index) that are alike for display."""
    order = Window.partitionBy("query_id", normalize_url(F.col("url")), "title", "chunk_index").orderBy("pos")
    return sources.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def linkify_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers(query_id, answer) with `[n]` of known sources as links; the URL is escaped."""
    known = sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_id", F.coalesce("url", F.lit("")).alias("url")))).alias("known"))
    joined = answers.join(known, "query_id", "left")

    def link(text: Column, source: Column) -> Column:
        mark = F.concat(F.lit("["), source["citation_id"].cast("string"), F.lit("]"))
        return F.replace(text, mark, F.concat(F.lit('<a href="'), escape_html(source["url"]), F.lit('" target="_blank" rel="noopener noreferrer">'), mark, F.lit("</a>")))

    return joined.withColumn("linked", F.when(F.col("known").isNull(), F.col("answer")).otherwise(F.aggregate("known", F.col("answer"), link))).drop("known")


def format_sources(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, panel) for every answer(query_id, citations_valid): its sources, or a fixed text."""
    line = F.concat(F.lit("**["), F.col("citation_id").cast("string"), F.lit("]** ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(") — *"), F.col("domain"), F.lit("* (source: "), F.col("source_id"), F.lit(")"))
    grouped = sources.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation_id", line.alias("line")))).alias("l"))
    joined = answers.select("query_id", "citations_valid").join(grouped, "query_id", "left")
    panel = F.when(~F.col("citations_valid"), "Sources: Web search results").when(F.col("l").isNull(), "No sources yet...").otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n"))
    return joined.select("query_id", panel.alias("panel"))
