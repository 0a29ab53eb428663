"""Incremental ingest: page files become chunks of a store; the newest version of every page is kept, whenever it comes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragcorpus.operators.chunking import chunk_markdown, conform_metadata
from ragcorpus.operators.parse import parse_pages
from ragcorpus.sources.io import chunk_id, stored_content
from ragcorpus.sources.scratch import exists

PAGES = "url string, site string, html string, crawled_at timestamp"
#: Parts of the table of versions by URL. A batch reads only the parts that its URLs are in.
PARTS = 256


def page_chunks(pages: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Chunks of pages(url, site, html), parsed and split, with their ids."""
    parsed = parse_pages(pages.select("url", "site", "html"))
    docs = parsed.select("url", "title", F.col("site").alias("domain"), F.col("url").alias("source_id"), F.col("markdown").alias("content"))
    chunks = conform_metadata(chunk_markdown(docs, size, overlap))
    return chunks.withColumn("content", stored_content(chunks)).withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("content")))


def _newer() -> Column:
    """What orders versions of a page: the time of the crawl, null first, then the hash of what was crawled."""
    return F.struct(F.col("crawled_at").isNotNull().alias("timed"), "crawled_at", "content_hash")


def _newest(versions: DataFrame) -> DataFrame:
    """The newest version of each URL; of equal ones the first that was stored, so that a repeat changes nothing."""
    order = Window.partitionBy("url").orderBy(F.desc("newer"), "batch_id")
    return versions.withColumn("newer", _newer()).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "newer")


def stream_ingest(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, files: int = 20) -> DataFrame:
    """Take all files that are new below in_path into the store and stop; ingest_log of the store.

    No page is lost by its time: each batch is merged with the table of versions, a row for each page that a batch took
    in. Of the rows of one URL in a batch the newest counts. A page is `new` where its URL has no version, `changed` where it
    is newer than the newest one and has other content, `same` where it is newer and has the same (its chunks stay),
    `older` where it is not newer, and then changes nothing. Rows without a URL count as pages of the URL null.

    A batch is written to partitions of its own, chunks before versions, and compared only with earlier ones, so a
    batch that is repeated after a failure replaces itself, and half a batch is never seen by read_ingested.
    """
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(in_path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.withColumns({"content_hash": F.sha2(F.coalesce("html", F.lit("")), 256), "part": F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int"), "newer": _newer()})
        own = own.persist()
        try:
            rows = own.groupBy("url", "part").agg(F.count("*").alias("n_rows"), F.max("newer").alias("newer"))
            taken = rows.select("url", "part", "n_rows", "newer.crawled_at", "newer.content_hash")
            known = _known(batch.sparkSession, out_path, batch_id, [r["part"] for r in rows.select("part").distinct().collect()])  # at most PARTS rows
            versions = _statuses(taken, known, batch_id)
            fresh = own.join(versions.where("status in ('new', 'changed')").select(F.col("url").alias("_url"), F.col("content_hash").alias("_hash")), F.col("url").eqNullSafe(F.col("_url")) & (F.col("content_hash") == F.col("_hash")), "left_semi").dropDuplicates(["url"])
            page_chunks(fresh).write.mode("overwrite").parquet(f"{out_path}/chunks/batch_id={batch_id}")
            versions.write.mode("overwrite").partitionBy("part").parquet(f"{out_path}/versions/batch_id={batch_id}")
        finally:
            own.unpersist()

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return ingest_log(spark, out_path)


def _known(spark: SparkSession, out_path: str, batch_id: int, parts: list[int]) -> DataFrame | None:
    """The newest versions before a batch of the URLs in some parts, or None before the first."""
    if not exists(spark, f"{out_path}/versions"):
        return None
    earlier = spark.read.parquet(f"{out_path}/versions").where((F.col("batch_id") < batch_id) & F.col("part").isin(parts))
    return _newest(earlier.where("status <> 'older'"))


def _statuses(taken: DataFrame, known: DataFrame | None, batch_id: int) -> DataFrame:
    """The batch's pages with their status and chunk_batch, the batch that has their chunks."""
    if known is None:
        return taken.withColumns({"status": F.lit("new"), "chunk_batch": F.lit(batch_id).cast("long")})
    before = known.select(F.col("url").alias("_url"), _newer().alias("_newer"), F.col("content_hash").alias("_hash"), F.col("chunk_batch").alias("_batch"))
    joined = taken.join(before, F.col("url").eqNullSafe(F.col("_url")), "left")
    # a version of the same time and content is not newer; of the same time and another content the greater hash is
    status = F.when(F.col("_newer").isNull(), "new").when(_newer() <= F.col("_newer"), "older").when(F.col("content_hash") == F.col("_hash"), "same").otherwise("changed")
    batch = F.when(F.col("status").isin("new", "changed"), F.lit(batch_id).cast("long")).otherwise(F.col("_batch"))
    return joined.withColumn("status", status).withColumn("chunk_batch", batch).select(*taken.columns, "status", "chunk_batch")


def read_versions(spark: SparkSession, out_path: str) -> DataFrame:
    """(url, crawled_at, content_hash, status, chunk_batch, ...): the version of each page that stands."""
    return _newest(spark.read.parquet(f"{out_path}/versions").where("status <> 'older'"))


def read_ingested(spark: SparkSession, out_path: str) -> DataFrame:
    """The chunks of the versions that stand. Chunks that a changed page had before are in the store but not among them."""
    versions = read_versions(spark, out_path).select(F.coalesce("url", F.lit("")).alias("source_id"), F.col("chunk_batch").alias("batch_id"))
    return spark.read.parquet(f"{out_path}/chunks").join(versions, ["source_id", "batch_id"], "left_semi")


def replaced_chunks(spark: SparkSession, out_path: str) -> DataFrame:
    """(chunk_id): chunks that no version has any more, as an index should drop."""
    return spark.read.parquet(f"{out_path}/chunks").select("chunk_id").distinct().join(read_ingested(spark, out_path).select("chunk_id"), "chunk_id", "left_anti")


def ingest_log(spark: SparkSession, out_path: str) -> DataFrame:
    """(batch_id, n_pages, n_rows, n_new, n_changed, n_same, n_older): what became of every row of each batch; n_rows counts repeats."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return spark.read.parquet(f"{out_path}/versions").groupBy("batch_id").agg(F.count("*").alias("n_pages"), F.sum("n_rows").alias("n_rows"), *[status(s) for s in ("new", "changed", "same", "older")])
