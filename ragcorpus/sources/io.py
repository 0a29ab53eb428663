"""Reading and writing of pages, URL maps, Markdown documents, chunk stores and golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragcorpus.operators._order import numbered
from ragcorpus.sources.keyed import BUCKETS, append_keyed, read_keyed

GOLDEN = "id string, question string, expected_answer string, retrieved_documents array<struct<id string, title string, authority string, relevant_text string>>, question_type string, verbosity string, expected_citations array<string>, expected_authorities array<string>"
DOCUMENT = "doc_id string, content string, source string, site string, title string, url string, crawled_at timestamp"


def read_pages(spark: SparkSession, path: str, names: str = "*.html") -> DataFrame:
    """(site, path, filename, html) of every file of these names below path; the site is the first directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    inner = _below(F.col("path"), path)
    return files.select(_site(inner), inner.alias("path"), F.substring_index("path", "/", -1).alias("filename"), F.decode("content", "UTF-8").alias("html"))


#: Files that one task writes: making one costs as much as reading many rows, so rows alone, packed in few parts, keep few tasks busy.
FILES_PER_TASK = 1_000


def write_pages(pages: DataFrame, path: str, end: str = "\n") -> None:
    """pages(site, value) as a file each with `end` behind its text, in folders of their sites below path, which is new. Pages are
    dealt by their number, and tasks put their own files in place; else the driver would, one after the other."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-pages.count() // (FILES_PER_TASK * cores)))
    writer = pages.select("site", "value").repartition(parts, F.xxhash64("value")).write.option("maxRecordsPerFile", 1).option("lineSep", end)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("site").text(path)


def _below(path: Column, root: str) -> Column:
    """A file's path below root, whatever the scheme that it is listed with."""
    base = root.split("://", 1)[-1].split("/", 1)[-1].strip("/") if "://" in root else root.strip("/")
    return F.regexp_replace(F.substring_index(path, base + "/", -1), "^/", "")


def _site(inner: Column) -> Column:
    parts = F.split(inner, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("unknown").alias("site")


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """(filename, url, title, key_order) of a JSON object filename -> {url, title}."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, struct<url: string, title: string>>")
    return text.select(F.posexplode(F.map_entries(entries)).alias("key_order", "e")).select(F.col("e.key").alias("filename"), "e.value.url", "e.value.title", "key_order")


def url_map(items: DataFrame) -> DataFrame:
    """(filename, url, title) of items(filename, url, title, skipped, position); skipped ones are left out, the last of
    a filename wins."""
    return items.where("not skipped").groupBy("filename").agg(F.max_by(F.struct("url", "title"), "position").alias("v")).select("filename", "v.url", "v.title")


def write_url_map(items: DataFrame, path: str) -> None:
    """The sidecar as one JSON object; it is one site's, and so small."""
    entries = F.sort_array(F.collect_list(F.struct("filename", F.struct("url", "title"))))
    url_map(items).agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def resolve_urls(files: DataFrame, urls: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """files(site, path, filename, ...) with url and link_base: by a map key that ends the path, else that is the
    path, else that ends in the filename; link_base falls back to the site's base_url.

    A key that ends the path, unless it is a part of the filename only, has the filename as its last part: an equi-join.
    Keys that are such parts are joined by the ends of filenames, of the lengths that these keys have; keys that end in
    the filename by the ends of their last part, for the files that nothing else has matched.
    """
    last = F.substring_index("filename", "/", -1)
    keys = urls.where("filename <> ''").select(F.col("filename").alias("_key"), last.alias("_last"), F.col("url").alias("_url"), "key_order")
    own = files.select("site", "path", "filename")
    whole = own.join(keys, F.col("filename") == F.col("_last")).where(F.endswith(F.col("path"), F.col("_key")) | (F.col("path") == F.col("_key")))
    ends = lambda name, n: F.transform(F.filter(n, lambda i: i < F.char_length(name)), lambda i: F.substr(F.col(name), F.char_length(name) - i + 1))
    sizes = lambda df, name: df.agg(F.collect_set(F.char_length(name)).alias("_sizes"))  # noqa: E731 - one row, as many numbers as names have lengths
    bare = keys.where("_key = _last")
    part = own.crossJoin(F.broadcast(sizes(bare, "_key"))).withColumn("_end", F.explode(ends("filename", F.col("_sizes")))).drop("_sizes").join(bare, F.col("_end") == F.col("_key"))
    first = whole.drop("_last").unionByName(part.drop("_last", "_end")).withColumn("_tier", F.lit(1))
    rest = own.join(first.select("site", "path"), ["site", "path"], "left_anti")
    equal = rest.join(keys, F.col("filename") == F.col("_last")).drop("_last")
    longer = keys.crossJoin(F.broadcast(sizes(rest, "filename"))).withColumn("_end", F.explode(ends("_last", F.col("_sizes")))).drop("_sizes", "_last")
    third = equal.unionByName(rest.join(longer, F.col("filename") == F.col("_end")).drop("_end")).withColumn("_tier", F.lit(3))
    matched = first.unionByName(third)
    best = matched.groupBy("site", "path").agg(F.min_by("_url", F.struct("_tier", "key_order")).alias("url"))
    out = files.drop("url").join(best, ["site", "path"], "left")
    if sites is None:
        return out.withColumn("link_base", F.col("url"))
    return out.join(sites.select(F.col("name").alias("site"), "base_url"), "site", "left").withColumn("link_base", F.coalesce("url", "base_url")).drop("base_url")


def front_matter(text: Column) -> tuple[Column, Column]:
    """(metadata map, body) of Markdown with a block of `key: value` lines between `---` lines."""
    pattern = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z"
    block, body = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    has = text.rlike(pattern)
    lines = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[\w-]+:"))
    clean = lambda v: F.regexp_replace(F.btrim(v), r"""^(['"])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda line: F.struct(F.substring_index(line, ":", 1), clean(F.regexp_replace(line, r"^[\w-]+:", ""))))
    # of a key that repeats the last value stands
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["col1"]), F.create_map(p["col1"], p["col2"])))
    return F.when(has, unique).otherwise(F.create_map().cast("map<string,string>")), F.when(has, F.btrim(body, F.lit("\r\n "))).otherwise(text)


def read_markdown(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """(site, source_path, metadata, content, url) of Markdown files below path, of one site where given."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    inner = _below(F.col("_metadata.file_path"), path)
    metadata, body = front_matter(F.col("value"))
    own = text.select(_site(inner), inner.alias("source_path"), metadata.alias("metadata"), body.alias("content"))
    own = own.withColumn("url", F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("source_url")), F.lit("")), F.try_element_at("metadata", F.lit("source_file"))))
    return own.where(F.col("site") == site) if site else own


def document_text(documents: DataFrame) -> Column:
    """A document as Markdown with front matter: its header block, `# title`, and the body."""
    have = documents.columns
    fields = [("source_file", "path"), ("title", "title"), ("domain", "site"), ("parse_timestamp", "parsed_at"), ("parser", "parser"), ("source_url", "url")]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for name, c in fields if c in have]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n\n# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("markdown", F.lit("")))


def write_documents(documents: DataFrame, path: str, as_text: bool = False) -> None:
    """Parsed documents as Parquet by site; as_text adds their Markdown form in a column `document`."""
    own = documents.withColumn("document", document_text(documents)) if as_text else documents
    own.write.mode("overwrite").partitionBy("site").parquet(path)


def output_path(path: Column) -> Column:
    """Where a document goes: its nested path with .md where it has two parts or more, else its name."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".md"))


def site_index(documents: DataFrame) -> DataFrame:
    """(site, n_pages, pages): one sorted array of (title, source, output) a site; a site's pages are one row by contract."""
    entry = F.struct(F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("path").alias("source"), output_path(F.col("path")).alias("output"))
    return documents.groupBy("site").agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list(entry)).alias("pages"))


def site_entries(documents: DataFrame) -> DataFrame:
    """(site, n_pages, at, title, source, output): site_index with a row for each page, numbered from 0 within its site in
    the same order, for sites of any size."""
    title, output = F.coalesce("title", F.lit("Untitled")), output_path(F.col("path"))
    own = documents.select("site", title.alias("title"), F.col("path").alias("source"), output.alias("output"))
    placed = numbered(own, ["site", "title", "source"], "place")
    sites = placed.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("n_pages"), F.min("place").alias("_first"))
    joined = placed.join(sites, F.col("site").eqNullSafe(F.col("_site")))
    return joined.select("site", "n_pages", (F.col("place") - F.col("_first")).alias("at"), "title", "source", "output")


def chunk_id(source_id: Column, chunk_index: Column, content: Column) -> Column:
    """An id that a chunk keeps when it is made again."""
    return F.sha2(F.concat_ws("\u0001", source_id, chunk_index.cast("string"), content), 256)


def stored_content(chunks: DataFrame) -> Column:
    """content, else the first of the other text columns that is not blank, else a note with the source id."""
    named = [c for c in ("content", "text", "body", "page_content", "full_text") if c in chunks.columns]
    usable = [F.when(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") != "", F.col(c)) for c in named]
    return F.coalesce(*usable, F.concat(F.lit("Empty document: "), F.coalesce("source_id", F.lit(""))))


def write_chunks(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append chunks with their id to a store, Parquet by domain in buckets of the id. A chunk_id that the store holds is not
    written again, so that a repeated run adds nothing; what other runs wrote stays, and is not shuffled."""
    spark = chunks.sparkSession
    own = chunks.withColumn("content", stored_content(chunks)).withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("content"))).dropDuplicates(["chunk_id"])
    stored = read_keyed(spark, path, "chunk_id", buckets, ("domain",))
    if stored is not None:
        own = own.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    append_keyed(own, path, "chunk_id", buckets, ("domain",))


def read_chunks(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return read_keyed(spark, path, "chunk_id", buckets, ("domain",))


def get_chunks(chunks: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The chunks of these ids, given as a list, which reads only their buckets, or as a table (chunk_id), which alone is shuffled."""
    if isinstance(ids, DataFrame):
        return chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi")
    return chunks.where(F.col("chunk_id").isin(list(ids)))


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): cases of a JSON-lines file, and (line, error) of lines that are none. Line numbers count from 1.

    A file that is missing or has no lines but blank ones is an error. Golden sets are small, and are read whole.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "line")).select((F.col("at") + 1).alias("line"), F.regexp_replace("line", r"\s+$", "").alias("raw")).where(F.btrim("raw") != "")
    if lines.limit(1).count() == 0:
        raise ValueError(f"no cases in {path}")
    checked = lines.select("line", "raw", F.from_json("raw", GOLDEN).alias("r"), F.try_parse_json("raw").alias("v"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") == ""
    text_at = lambda p: F.when(kind(p) == "STRING", F.try_variant_get("v", p, "string"))
    error = (
        F.when(F.col("v").isNull(), "invalid JSON")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "record must be a JSON object")
        .when(blank(text_at("$.question")), "missing non-empty 'question'")
        .when(blank(text_at("$.expected_answer")), "missing non-empty 'expected_answer'")
        .when(~F.coalesce(kind("$.retrieved_documents").startswith("ARRAY"), F.lit(False)), "'retrieved_documents' must be a list")
        .when(F.coalesce(text_at("$.id"), F.lit("")) == "", "missing non-empty 'id'")
    )
    checked = checked.withColumn("error", error)
    relevant = F.filter(F.transform("r.retrieved_documents", lambda d: d["relevant_text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    good = checked.where("error is null").select("line", "r.*", relevant.alias("retrieval_context"))
    return good, checked.where("error is not null").select("line", F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": "), "error").alias("error"))


def validate_golden(good: DataFrame) -> DataFrame:
    """(id, n): ids that more than one case has."""
    return good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def documents_to_json(documents: DataFrame) -> DataFrame:
    """(value): documents as JSON with an ISO timestamp; missing titles and URLs are empty."""
    filled = documents.withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit("")), "crawled_at": F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})
    return filled.select(F.to_json(F.struct(*[f.name for f in T.StructType.fromDDL(DOCUMENT)])).alias("value"))


def documents_from_json(lines: DataFrame) -> DataFrame:
    """Documents from JSON in a column `value`; missing titles and URLs are empty, a missing time is null."""
    raw = lines.select(F.from_json("value", DOCUMENT.replace("timestamp", "string")).alias("d")).select("d.*")
    return raw.withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit("")), "crawled_at": F.col("crawled_at").try_cast("timestamp")})
