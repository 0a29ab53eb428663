"""Queries of pages, links, parsing, chunking, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragcorpus.functions import text as fx
from ragcorpus.operators import chunking, parse, web
from ragcorpus.plans.tables import META_SQL, meta, query, table
from ragcorpus.sources import io
from ragcorpus.sources.scratch import new_path
from ragcorpus.streaming.ingest import page_chunks, read_ingested, read_versions, stream_ingest

HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their host as their site."""
    return table(spark, sf_dir, "pages").withColumn("site", F.try_parse_url("url", F.lit("HOST")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site a host, which allows itself."""
    own = pages(spark, sf_dir).groupBy("site").agg(F.min("page_id").alias("first"))
    return own.select(F.col("site").alias("name"), F.concat(F.lit("https://"), "site").alias("base_url"), F.array("site").alias("allowed_domains"))


UNESC = r"""replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"""
RAW_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, CASE WHEN {RAW_TITLE} = '' THEN 'Untitled' ELSE {UNESC.format(TRIM.format(RAW_TITLE))} END AS title, {UNESC.format(TRIM.format(RAW_TITLE))} AS crawl_title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.page_title(F.col("html")).alias("title"), fx.crawl_title(F.col("html")).alias("crawl_title"))


#: The pages' one script stands in their head.
JS_SQL = "(string_split({0}, '<script>')[1] || array_to_string(string_split(array_to_string(string_split({0}, '<script>')[2:], '<script>'), '</script>')[2:], '</script>'))"


#: What the handlers and links that are written into the paragraphs leave.
@query(f"SELECT page_id, replace({JS_SQL.format('html')}, '<p>', CASE WHEN page_id % 2 = 0 THEN '<p title=''t''>' ELSE '<a href=\"#\">' END) AS html FROM pages")
def pages_without_javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.replace("html", F.lit("<p>"), F.when(F.col("page_id") % 2 == 0, "<p onclick=\"x()\" title='t'>").otherwise('<a href="javascript:go()">'))
    return table(spark, sf_dir, "pages").select("page_id", fx.remove_javascript(own).alias("html"))


STRIP_SQL = r"regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, {STRIP_SQL.format('html')} AS text FROM pages")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.strip_tags(F.col("html")).alias("text"))


#: By the pages' one layout: the title, the menu's items, the advert, the heading, the paragraphs and the footer.
CLEAN_SQL = rf"""shown AS (SELECT page_id, string_split(html, '<body>') AS halves FROM pages),
parts AS (SELECT page_id, regexp_extract(halves[1], '(?s)<title>(.*?)</title>', 1) AS title, array_to_string(halves[2:], '<body>') AS body FROM shown),
marked AS (SELECT page_id, title, list_transform(string_split(string_split(body, '</ul>')[1], '<li>')[2:], lambda x: '• ' || string_split(x, '</li>')[1]) AS items,
  regexp_extract(body, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_extract(body, '(?s)</h1>(.*)$', 1) AS rest FROM parts)"""


@query(f"WITH {CLEAN_SQL} SELECT page_id, {STRIP_SQL.format("title || ' ' || array_to_string(items, ' ') || ' ' || ad || ' # ' || head || ' ' || rest")} AS text FROM marked")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.basic_clean_html(F.col("html")).alias("text"))


PATH_SQL = r"trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')"


@query(f"""SELECT page_id, string_split(string_split(url, '#')[1], '?')[1] AS normal, CASE WHEN {PATH_SQL} = '' THEN 'index' ELSE {PATH_SQL} END AS filename,
ends_with(lower(url), '.pdf') OR contains(string_split(lower(url), '/')[-1], 'pdf') AS is_pdf, CASE WHEN contains({PATH_SQL}, '/') THEN string_split({PATH_SQL}, '/')[1] ELSE 'unknown' END AS domain FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        fx.normalize_url(url).alias("normal"),
        fx.url_to_filename(url).alias("filename"),
        fx.is_pdf_url(url).alias("is_pdf"),
        fx.path_domain(F.concat(F.lit("/data/"), fx.url_to_filename(url)), "/data").alias("domain"),
    )


LINKS_SQL = f"""lk AS (SELECT {HOST_SQL} AS site, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
links AS (SELECT site, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link FROM lk)"""


@query(f"WITH {LINKS_SQL} SELECT site, url, link FROM links")
def outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.extract_links(pages(spark, sf_dir), sites(spark, sf_dir))


@query(f"WITH {LINKS_SQL} SELECT site, url, link FROM links")
def outlinks_of_subdomains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.extract_links(pages(spark, sf_dir), sites(spark, sf_dir), "subdomain")


@query(f"SELECT {HOST_SQL} AS site, url, 'https://' || {HOST_SQL} || '/help/index.html#t=topic' || page_id::VARCHAR || '.html#x' AS link, 'https://' || {HOST_SQL} || '/help/topic' || page_id::VARCHAR || '.html' AS target FROM pages WHERE page_id % 3 > 0")
def fragment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    number = F.col("page_id").cast("string")
    # every third link names no file and is dropped
    name = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("topic"), number, F.lit(".html"))).otherwise("")
    links = own.select("site", "url", F.concat(F.lit("https://"), "site", F.lit("/help/index.html#t="), name, F.lit("#x")).alias("link"))
    return web.rewrite_fragment_links(links, sites(spark, sf_dir))


@query(
    """WITH RECURSIVE edges AS (SELECT DISTINCT doc_id AS u, doc_id * 2 + 1 AS v FROM documents UNION SELECT DISTINCT doc_id, doc_id * 2 + 2 FROM documents),
walk AS (SELECT min(doc_id) AS url, 0 AS depth FROM documents UNION SELECT v, depth + 1 FROM walk JOIN edges ON u = url WHERE depth < 6)
SELECT url::VARCHAR AS url, min(depth)::INTEGER AS depth FROM walk GROUP BY url"""
)
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, seeds = _numbered_links(spark, sf_dir)
    return web.crawl_frontier(links, seeds, 6)


@query(
    """WITH RECURSIVE edges AS (SELECT DISTINCT doc_id AS u, doc_id * 2 + 1 AS v FROM documents UNION SELECT DISTINCT doc_id, doc_id * 2 + 2 FROM documents),
walk AS (SELECT min(doc_id) AS url, 0 AS depth FROM documents UNION SELECT v, depth + 1 FROM walk JOIN edges ON u = url)
SELECT url::VARCHAR AS url, min(depth)::INTEGER AS depth FROM walk GROUP BY url"""
)
def whole_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As frontier, without a limit: every page that can be reached."""
    return web.crawl_frontier(*_numbered_links(spark, sf_dir))


def _numbered_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links from the page of each number to two others, and the least number as the seed."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    links = docs.select(F.col("doc_id").cast("string").alias("url"), F.explode(F.array((F.col("doc_id") * 2 + 1).cast("string"), (F.col("doc_id") * 2 + 2).cast("string"))).alias("link"))
    return links, docs.agg(F.min("doc_id").cast("string").alias("url"))


SKIP_SQL = f"sk AS (SELECT page_id, {HOST_SQL} AS site, CASE WHEN {PATH_SQL} = '' THEN 'index' ELSE {PATH_SQL} END || '.html' AS filename FROM pages), ex AS (SELECT DISTINCT site, filename FROM sk WHERE page_id % 4 = 1)"


@query(f"WITH {SKIP_SQL} SELECT page_id, sk.filename, ex.site IS NOT NULL AS skipped FROM sk LEFT JOIN ex ON sk.site = ex.site AND sk.filename = ex.filename")
def skipped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("page_id", "filename", "skipped")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    existing = own.where("page_id % 4 = 1").select("site", F.concat(fx.url_to_filename(F.col("url")), F.lit(".html")).alias("filename"))
    return web.mark_skipped(own, existing)


@query(f"WITH {SKIP_SQL} SELECT sk.site, count(*) FILTER (ex.site IS NULL) AS saved, count(*) FILTER (ex.site IS NOT NULL) AS skipped FROM sk LEFT JOIN ex ON sk.site = ex.site AND sk.filename = ex.filename GROUP BY sk.site")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.crawl_summary(_items(spark, sf_dir))


#: What a reader sees of the pages' one layout: a menu, an advert, an article of a heading and paragraphs, and a footer.
CHARS = r"""replace(replace(replace(replace({0}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""
ONE_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _texts_sql(html: str) -> str:
    """The stripped text nodes of a piece of a page as a list."""
    return f"list_filter(list_transform(string_split_regex({html}, '<[^>]*>'), lambda x: {TRIM.format(CHARS.format('x'))}), lambda x: x <> '')"


PARSED_SQL = rf"""parts AS (SELECT page_id, html, {TRIM.format(CHARS.format(RAW_TITLE))} AS title, regexp_extract(html, '(?s)<div[^>]*>(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head,
  string_split(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<p>')[2:] AS ps FROM pages),
bare AS (SELECT *, list_transform(ps, lambda p: starts_with(p, '<b>')) AS bold, list_transform(ps, lambda p: {ONE_LINE.format(CHARS.format("regexp_replace(p, '</p>|<br>|<b>', '', 'g')"))}) AS texts FROM parts),
marked AS (SELECT page_id, title, list_filter(list_concat([{ONE_LINE.format(CHARS.format('ad'))}, '# ' || {ONE_LINE.format(CHARS.format('head'))}], list_transform(list_zip(bold, texts), lambda z: CASE WHEN z[2] = '' THEN '' WHEN z[1] THEN '**' || z[2] || '**' ELSE z[2] END)), lambda x: x <> '') AS blocks FROM bare)"""


@query(f"WITH {PARSED_SQL} SELECT page_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, array_to_string(blocks, E'\n\n') AS markdown FROM marked")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_pages(pages(spark, sf_dir)).select("page_id", "title", "markdown")


#: Selectors that all choose the pages' article, and one that chooses nothing; a site's are those of the length of its name.
SELECTORS = [
    ("article", "//title", ["nav", "footer", "script", "style"], True),
    ("html > body > article", "//article/h1", ["nav", "script, style", "div[class~=ad]"], False),
    ("main, div.ad + article", "body h1", [], False),
    ("section[role='main']", "//body//h1", ["nav > ul", "div.ad", "html footer", "script"], True),
    ("div article, p.intro.wide", "/html/head/title", ["nav"], False),
]


@query(f"""WITH {PARSED_SQL}, chosen AS (SELECT marked.page_id, title, blocks[CASE WHEN {ONE_LINE.format(CHARS.format('ad'))} = '' THEN 1 ELSE 2 END:] AS article, {TRIM.format(CHARS.format('head'))} AS head, length({HOST_SQL}) % 5 AS kind
  FROM marked JOIN parts USING (page_id, title) JOIN pages USING (page_id))
SELECT page_id, CASE WHEN kind IN (0, 4) THEN CASE WHEN title = '' THEN 'Untitled' ELSE title END ELSE head END AS title, CASE WHEN kind = 4 THEN '' ELSE array_to_string(article, E'\n\n') END AS markdown FROM chosen""")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed with the selectors of their sites."""
    kind = F.length("name") % 5
    config = lambda i: F.struct(F.lit(SELECTORS[i][0]).alias("content_selector"), F.lit(SELECTORS[i][1]).alias("title_selector"), F.array(*[F.lit(x) for x in SELECTORS[i][2]]).cast("array<string>").alias("strip_selectors"), F.lit(SELECTORS[i][3]).alias("fallback_to_body"))
    parser = F.element_at(F.array(*[config(i) for i in range(5)]), (kind + 1).cast("int"))
    own = sites(spark, sf_dir).withColumn("parser", parser)
    return parse.parse_pages(pages(spark, sf_dir), own).select("page_id", "title", "markdown")


@query(
    rf"""SELECT page_id, array_to_string(list_concat(CASE WHEN t = '' THEN [] ELSE [t] END, list_filter([{TRIM.format("regexp_extract(html, '(?s)<style>(.*?)</style>', 1)")}, {TRIM.format("regexp_extract(html, '(?s)<script>(.*?)</script>', 1)")}], lambda x: x <> ''),
{_texts_sql("regexp_extract(html, '(?s)<body>(.*)$', 1)")}), chr(10)) AS text FROM (SELECT *, {TRIM.format(CHARS.format(RAW_TITLE))} AS t FROM pages)"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parse.page_text("html").alias("text"))


@query(
    """WITH b AS (SELECT conv_id, turn, text, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations),
g AS (SELECT conv_id, sum(n) AS total, coalesce(string_agg(text, E'\\n\\n' ORDER BY turn) FILTER (n > 0 AND before < 400), '') AS t FROM b GROUP BY conv_id)
SELECT conv_id, CASE WHEN total > 400 THEN t[1:400] || E'\\n\\n[Truncated at 400 characters]' ELSE t END AS text FROM g"""
)
def capped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.assemble_capped_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", cap=400)


@query("SELECT doc_id, i // 800 AS chunk_index, text[i + 1 : i + 1000] AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents) WHERE i // 800 < 50")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.fixed_windows(F.col("text"), 1000, 200)).alias("at", "content"))
    return chunking.limit_chunks(own.withColumnRenamed("at", "chunk_index"), 50).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = chunking.recursive_split(F.col("text"), 1000, 200)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split).alias("chunk_index", "content"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: every line in some is a heading."""
    text = F.regexp_replace("text", r"\n", "\n\n## Part\n\n")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("# "), "source", F.lit("\n\n"), text).alias("content"))


@query(
    r"""WITH p AS (SELECT 'd' || doc_id::VARCHAR AS source_id, source, string_split(text, chr(10)) AS ps FROM documents),
s AS (SELECT source_id, source, unnest(range(0, len(ps))) AS i, unnest(ps) AS line FROM p)
SELECT source_id, i::INTEGER AS section_id, CASE WHEN i = 0 THEN '{"H1":' || to_json(source)::VARCHAR || '}' ELSE '{"H1":' || to_json(source)::VARCHAR || ',"H2":"Part"}' END AS headers,
regexp_replace(CASE WHEN i = 0 THEN '# ' || source ELSE '## Part' END || E'\n\n' || line, '^\s+|\s+$', '', 'g') AS content FROM s"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.split_markdown_headers(_markdown(spark, sf_dir))
    return own.select("source_id", "section_id", F.to_json("headers").alias("headers"), "content")


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.chunk_markdown(_markdown(spark, sf_dir))
    return own.select("source_id", "section_id", "start_index", "chunk_index", "total_chunks", "content")


@query()
def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_html(table(spark, sf_dir, "pages")).select("page_id", "route", "chunk_index", "content")


SECTION_SQL = rf"""js AS (SELECT page_id, {JS_SQL.format('html')} AS html FROM pages),
sized AS (SELECT page_id, html, {TRIM.format('html')} AS trimmed, {STRIP_SQL.format('html')} AS plain FROM js),
cut AS (SELECT *, list_transform(list_filter(string_split_regex(regexp_extract(html, '(?s)<body>(.*?)<h1>', 1), '<[^>]*>'), lambda x: regexp_replace(x, '\s+', '', 'g') <> ''), lambda x: {ONE_LINE.format(CHARS.format('x'))}) AS above,
  {ONE_LINE.format(CHARS.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS head,
  list_transform(list_filter(string_split_regex(regexp_extract(html, '(?s)</h1>(.*)$', 1), '<[^>]*>'), lambda x: regexp_replace(x, '\s+', '', 'g') <> ''), lambda x: {ONE_LINE.format(CHARS.format('x'))}) AS below FROM sized),
routed AS (SELECT *, CASE WHEN length(trimmed) < 100 THEN 'short' WHEN length(plain) <= 1000 THEN 'small' ELSE '{{mode}}' END AS route FROM cut),
chunks AS (SELECT page_id, route, 0 AS chunk_index, CASE WHEN route = 'short' THEN trimmed ELSE plain END AS content, '{{{{}}}}' AS metadata FROM routed WHERE route IN ('short', 'small')
  UNION ALL SELECT page_id, route, 0, array_to_string(above, chr(10)), '{{{{}}}}' FROM routed WHERE route = '{{mode}}' AND len(above) > 0
  UNION ALL SELECT page_id, route, (len(above) > 0)::INTEGER, {{lead}} || array_to_string(below, chr(10)), '{{{{"Header 1":' || to_json(head)::VARCHAR || '}}}}' FROM routed WHERE route = '{{mode}}' AND len(below) > 0)"""


@query(f"WITH {SECTION_SQL.format(mode='header', lead=chr(39) * 2)} SELECT page_id, route, chunk_index, content, metadata FROM chunks")
def html_header_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.chunk_html(table(spark, sf_dir, "pages"), mode="header")
    return own.select("page_id", "route", "chunk_index", "content", F.to_json("metadata").alias("metadata"))


@query(f"WITH {SECTION_SQL.format(mode='section', lead='head || chr(10)')} SELECT page_id, route, chunk_index, content, metadata FROM chunks")
def html_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.chunk_html(table(spark, sf_dir, "pages"), mode="section")
    return own.select("page_id", "route", "chunk_index", "content", F.to_json("metadata").alias("metadata"))


@query(f"WITH {META_SQL} SELECT doc_id, source_id, (row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1)::INTEGER AS chunk_index, count(*) OVER (PARTITION BY source_id)::INTEGER AS total_chunks FROM meta")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.number_chunks(meta(spark, sf_dir), order="doc_id").select("doc_id", "source_id", "chunk_index", "total_chunks")


PREPARED_SQL = r"""pm AS (SELECT doc_id, text, lang || '/' || source || '-' || doc_id::VARCHAR || '.md' AS source_path, CASE WHEN doc_id % 3 = 0 THEN 'https://a.example.org/' || doc_id::VARCHAR ELSE '' END AS s, CASE WHEN doc_id % 2 = 0 THEN 'https://b.example.org/' || doc_id::VARCHAR END AS u FROM documents),
prep AS (SELECT doc_id, string_split(regexp_replace(source_path, '\.md$', ''), '/')[-1] AS source_id, string_split(source_path, '/')[-1] AS file_name, nullif(s, '') AS s, u FROM pm WHERE regexp_replace(text, '\s+', '', 'g') <> '')"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    own = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        F.concat("lang", F.lit("/"), "source", F.lit("-"), d, F.lit(".md")).alias("source_path"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://a.example.org/"), d)).otherwise("").alias("source_url"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://b.example.org/"), d)).alias("url"),
    )
    return chunking.prepare_metadata(own)


@query(f"WITH {PREPARED_SQL} SELECT doc_id, source_id, file_name, coalesce(s, u) AS source_url, coalesce(u, s) AS url, coalesce(s, u) AS citation_url FROM prep")
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _prepared(spark, sf_dir)
    return chunking.with_citation_url(own).select("doc_id", "source_id", "file_name", "source_url", "url", "citation_url")


@query(f"WITH {PREPARED_SQL} SELECT doc_id, '' AS title, coalesce(u, s, '') AS url, '' AS domain, source_id, '' AS source_type, coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id END, 0)::INTEGER AS chunk_index, 0 AS total_chunks, 0.0::DOUBLE AS score FROM prep")
def conformed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _prepared(spark, sf_dir)
    index = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id").cast("string")).otherwise("n/a")
    return chunking.conform_metadata(own.withColumns({"chunk_index": index, "extra": F.lit(1)}), keep=("doc_id",))


@query(
    r"""WITH c AS (SELECT doc_id, 'src-' || (doc_id % 10)::VARCHAR AS source_id, CASE WHEN doc_id % 4 > 0 THEN text ELSE ' ' END AS content, CASE WHEN doc_id % 8 = 0 THEN lang END AS body FROM documents)
SELECT doc_id, sha256(source_id || chr(1) || doc_id::VARCHAR || chr(1) || k) AS chunk_id, k AS content FROM (SELECT *, CASE WHEN regexp_replace(content, '\s+', '', 'g') <> '' THEN content WHEN body IS NOT NULL THEN body ELSE 'Empty document: ' || source_id END AS k FROM c)"""
)
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that went through the store and back."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(
        "doc_id",
        F.concat(F.lit("src-"), (F.col("doc_id") % 10).cast("string")).alias("source_id"),
        F.when(F.col("doc_id") % 4 > 0, F.col("text")).otherwise(" ").alias("content"),
        F.when(F.col("doc_id") % 8 == 0, F.col("lang")).alias("body"),
        F.col("lang").alias("domain"),
        F.col("doc_id").alias("chunk_index"),
    )
    path = new_path(spark)
    io.write_chunks(own, path)
    return io.read_chunks(spark, path).select("doc_id", "chunk_id", "content")


FILES_SQL = f"files AS (SELECT page_id, {HOST_SQL} AS site, 'p' || page_id::VARCHAR || '.html' AS filename, url FROM pages)"


@query(f"WITH {FILES_SQL} SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url END AS url, coalesce(CASE WHEN page_id % 3 < 2 THEN url END, 'https://' || site) AS link_base FROM files")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir).select("page_id", "site", "url", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"))
    files = own.withColumn("path", F.concat("site", F.lit("/"), "filename")).drop("url")
    items = own.withColumns({"skipped": F.col("page_id") % 3 == 2, "position": F.col("page_id"), "title": F.lit("t"), "filename": F.concat("site", F.lit("/"), "filename")})
    urls = io.url_map(items).withColumn("key_order", F.xxhash64("filename"))
    return io.resolve_urls(files, urls, sites(spark, sf_dir)).select("page_id", "url", "link_base")


@query(f"SELECT {HOST_SQL} AS site, count(*) AS n_pages, arg_min('t' || page_id::VARCHAR || '|a/' || page_id::VARCHAR || '.html|a/' || page_id::VARCHAR || '.md', 't' || page_id::VARCHAR) AS first FROM pages GROUP BY ALL")
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    own = pages(spark, sf_dir).select("site", F.concat(F.lit("t"), number).alias("title"), F.concat(F.lit("a/"), number, F.lit(".html")).alias("path"))
    first = F.get("pages", F.lit(0))
    return io.site_index(own).select("site", "n_pages", F.concat_ws("|", first["title"], first["source"], first["output"]).alias("first"))


@query(f"""SELECT {HOST_SQL} AS site, count(*) OVER (PARTITION BY {HOST_SQL}) AS n_pages, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY 't' || (page_id % 7)::VARCHAR, page_id::VARCHAR || '.html') - 1 AS at,
't' || (page_id % 7)::VARCHAR AS title, page_id::VARCHAR || '.md' AS output FROM pages""")
def site_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    own = pages(spark, sf_dir).select("site", F.concat(F.lit("t"), (F.col("page_id") % 7).cast("string")).alias("title"), F.concat(number, F.lit(".html")).alias("path"))
    return io.site_entries(own).select("site", "n_pages", "at", "title", "output")


@query("SELECT doc_id, text AS content, '' AS title, 'https://a.example.org/' || doc_id::VARCHAR AS url, source FROM documents")
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to JSON and back."""
    d = F.col("doc_id").cast("string")
    own = table(spark, sf_dir, "documents").select(
        d.alias("doc_id"), F.col("text").alias("content"), "source", F.lit("s").alias("site"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("https://a.example.org/"), d).alias("url"), F.lit(None).cast("timestamp").alias("crawled_at")
    )
    back = io.documents_from_json(io.documents_to_json(own))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "content", "title", "url", "source")


@query("SELECT item_id::VARCHAR AS id, text AS question FROM benchmark WHERE item_id % 5 > 0")
def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good cases of a golden file written from the benchmark; every fifth has no question."""
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 5 > 0, F.col("text")).alias("question"), F.col("text").alias("expected_answer"), F.array(F.struct(F.col("text").alias("relevant_text"))).alias("retrieved_documents"))
    path = new_path(spark)
    table(spark, sf_dir, "benchmark").select(F.to_json(item).alias("value")).repartition(1).write.text(path)
    good, _ = io.read_golden(spark, path)
    return good.select("id", "question")


#: Two drops of page files. The second brings pages that are older than all of the first, new versions, the same again, and
#: stale ones; some have no time.
DROPS_SQL = """drops AS (SELECT 1 AS n, url, html, CASE WHEN page_id % 5 > 0 THEN TIMESTAMP '2024-06-01' + INTERVAL 1 MINUTE * page_id END AS seen FROM pages WHERE page_id % 3 > 0
  UNION ALL SELECT 2, url, html, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * page_id FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT 2, url, html || CASE WHEN page_id % 4 = 2 THEN '' ELSE '<p>' || page_id::VARCHAR || '</p>' END, TIMESTAMP '2024-07-01' - INTERVAL 1 YEAR * (page_id % 4 = 3)::INTEGER FROM pages WHERE page_id % 3 > 0 AND page_id % 4 > 0),
versions AS (SELECT n, url, seen, sha256(html) AS h, row_number() OVER (PARTITION BY n, url ORDER BY seen IS NOT NULL DESC, seen DESC, sha256(html) DESC) AS k FROM drops),
paired AS (SELECT coalesce(a.url, b.url) AS url, a.url IS NULL AS late, a.seen AS at1, a.h AS h1, b.seen AS at2, b.h AS h2,
  b.url IS NOT NULL AND (a.url IS NULL OR (b.seen IS NOT NULL AND (a.seen IS NULL OR b.seen > a.seen)) OR (b.seen IS NOT DISTINCT FROM a.seen AND b.h > a.h)) AS second
  FROM (FROM versions WHERE n = 1 AND k = 1) a FULL JOIN (FROM versions WHERE n = 2 AND k = 1) b ON a.url = b.url)"""


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Where a store stands that took both drops in."""
    own = pages(spark, sf_dir).select("page_id", "url", "site", "html")
    hours = lambda start: F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + 60 * F.col("page_id"))
    first = own.where("page_id % 3 > 0").withColumn("crawled_at", F.when(F.col("page_id") % 5 > 0, hours("2024-06-01 00:00:00")))
    late = own.where("page_id % 3 = 0").withColumn("crawled_at", hours("2024-01-01 00:00:00"))
    again = own.where("page_id % 3 > 0 and page_id % 4 > 0").withColumn("crawled_at", F.when(F.col("page_id") % 4 == 3, F.lit("2023-07-01")).otherwise("2024-07-01").cast("timestamp"))
    again = again.withColumn("html", F.when(F.col("page_id") % 4 == 2, F.col("html")).otherwise(F.concat("html", F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>"))))
    root = new_path(spark)
    for drop in (first, late.unionByName(again)):
        drop.drop("page_id").write.mode("append").parquet(f"{root}/in")
        stream_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    return f"{root}/out"


@query(f"""WITH {DROPS_SQL} SELECT url, CASE WHEN second THEN at2 ELSE at1 END AS crawled_at, CASE WHEN second THEN h2 ELSE h1 END AS content_hash,
CASE WHEN NOT second OR late THEN 'new' WHEN h1 = h2 THEN 'same' ELSE 'changed' END AS status, true AS chunked FROM paired""")
def ingested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that stands of each page, and whether the store has its chunks."""
    path = _ingested(spark, sf_dir)
    chunked = read_ingested(spark, path).select(F.col("source_id").alias("url"), F.lit(True).alias("chunked")).distinct()
    return read_versions(spark, path).join(chunked, "url", "left").select("url", "crawled_at", "content_hash", "status", F.coalesce("chunked", F.lit(False)).alias("chunked"))


@query("SELECT line, 'missing non-empty ''question''' AS error FROM (SELECT item_id, row_number() OVER (ORDER BY item_id)::INTEGER AS line FROM benchmark) WHERE item_id % 5 = 0")
def golden_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad lines of the golden file of golden_cases, in order of its items."""
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 5 > 0, F.col("text")).alias("question"), F.col("text").alias("expected_answer"), F.array(F.struct(F.col("text").alias("relevant_text"))).alias("retrieved_documents"))
    path = new_path(spark)
    table(spark, sf_dir, "benchmark").repartition(1).sortWithinPartitions("item_id").select(F.to_json(item).alias("value")).write.text(path)
    _, bad = io.read_golden(spark, path)
    return bad.select("line", F.regexp_replace("error", r"^.*:\d+: ", "").alias("error"))


@query("SELECT 'p' || page_id::VARCHAR || '.html' AS filename, url, 't' || page_id::VARCHAR AS title FROM pages WHERE page_id % 4 > 0")
def sidecar_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL map of the pages, written as a sidecar and read again; skipped pages are not in it."""
    number = F.col("page_id").cast("string")
    items = pages(spark, sf_dir).select(F.concat(F.lit("p"), number, F.lit(".html")).alias("filename"), "url", F.concat(F.lit("t"), number).alias("title"), (F.col("page_id") % 4 == 0).alias("skipped"), F.col("page_id").alias("position"))
    path = new_path(spark)
    io.write_url_map(items, path)
    return io.read_url_map(spark, path).select("filename", "url", "title")


@query(f"""WITH lk AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link, count(*) AS times FROM lk GROUP BY ALL""")
def content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links in the Markdown of whole bodies, made absolute on their page's URL."""
    config = F.struct(F.lit("body").alias("content_selector"), F.array(F.lit("script")).alias("strip_selectors"))
    own = parse.parse_pages(pages(spark, sf_dir), sites(spark, sf_dir).withColumn("parser", config))
    links = own.select("page_id", F.explode(F.regexp_extract_all("markdown", F.lit(r"\]\(<([^>]*)>\)"), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("times"))


@query()
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the versions that stand."""
    return read_ingested(spark, _ingested(spark, sf_dir)).select("source_id", "chunk_index", "total_chunks", "title", "content", "chunk_id")


@query()
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_chunks(pages(spark, sf_dir)).select("source_id", "chunk_index", "total_chunks", "title", "content", "chunk_id")


@query(
    r"""WITH c AS (SELECT doc_id, 'src-' || (doc_id % 10)::VARCHAR AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run, text FROM documents WHERE text <> '')
SELECT doc_id, sha256(source_id || chr(1) || doc_id::VARCHAR || chr(1) || text) AS chunk_id FROM c WHERE regexp_replace(text, '\s+', '', 'g') <> ''"""
)
def appended_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into the same domains of a store, the second with some of the first's chunks again."""
    docs = table(spark, sf_dir, "documents").where(F.regexp_replace("text", r"\s+", "") != "")
    own = docs.select("doc_id", F.concat(F.lit("src-"), (F.col("doc_id") % 10).cast("string")).alias("source_id"), F.col("text").alias("content"), F.lit("d").alias("domain"), F.col("doc_id").alias("chunk_index"))
    path = new_path(spark)
    io.write_chunks(own.where("doc_id % 2 = 0"), path)
    io.write_chunks(own.where("doc_id % 2 = 1 or doc_id % 10 = 0"), path)
    return io.read_chunks(spark, path).select("doc_id", "chunk_id")


@query(r"SELECT doc_id, text AS content FROM documents WHERE doc_id % 20 = 0 AND regexp_replace(text, '\s+', '', 'g') <> ''")
def fetched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of given ids."""
    docs = table(spark, sf_dir, "documents").where(F.regexp_replace("text", r"\s+", "") != "")
    own = docs.select("doc_id", F.lit("s").alias("source_id"), F.col("text").alias("content"), F.lit("d").alias("domain"), F.col("doc_id").alias("chunk_index"))
    path = new_path(spark)
    io.write_chunks(own, path)
    ids = own.where("doc_id % 20 = 0").select(io.chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))
    return io.get_chunks(io.read_chunks(spark, path), ids).select("doc_id", "content")


@query(r"""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'p' || page_id::VARCHAR || '.html' END AS source_file, CASE WHEN page_id % 3 > 0 THEN 'T: ' || page_id::VARCHAR END AS title,
CASE WHEN page_id % 3 > 0 THEN trim('# T' || E'\n\n' || url, E'\r\n ') ELSE '# T' || E'\n\n' || url END AS body FROM pages""")
def front_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with and without front matter, read as metadata and body."""
    number = F.col("page_id").cast("string")
    body = F.concat(F.lit("# T\n\n"), "url")
    head = F.concat(F.lit("---\nsource_file: p"), number, F.lit(".html\ntitle: 'T: "), number, F.lit("'\n---\n\n"))
    text = F.when(F.col("page_id") % 3 > 0, F.concat(head, body)).otherwise(body)
    metadata, rest = io.front_matter(text)
    own = table(spark, sf_dir, "pages").select("page_id", metadata.alias("m"), rest.alias("body"))
    return own.select("page_id", F.try_element_at("m", F.lit("source_file")).alias("source_file"), F.try_element_at("m", F.lit("title")).alias("title"), "body")


@query(f"""SELECT page_id, '---' || chr(10) || 'source_file: ' || page_id::VARCHAR || '.html' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'title: t' || page_id::VARCHAR || chr(10) ELSE '' END || 'domain: ' || {HOST_SQL} || chr(10) || 'source_url: ' || url || chr(10) || '---' ||
chr(10) || chr(10) || '# ' || CASE WHEN page_id % 2 = 0 THEN 't' || page_id::VARCHAR ELSE 'Untitled' END || chr(10) || chr(10) || html AS document FROM pages""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were written with their Markdown form and read again."""
    number = F.col("page_id").cast("string")
    own = pages(spark, sf_dir).select("page_id", "site", "url", F.concat(number, F.lit(".html")).alias("path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), number)).alias("title"), F.col("html").alias("markdown"))
    path = new_path(spark)
    io.write_documents(own, path, as_text=True)
    return spark.read.parquet(path).select("page_id", "document")


@query(f"SELECT page_id, {HOST_SQL} AS site, html FROM pages")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files in folders of their sites, read again."""
    path = new_path(spark)
    own = pages(spark, sf_dir).select("site", F.concat(F.col("page_id").cast("string"), F.lit("|"), "html").alias("value"))
    io.write_pages(own, path, "|")
    back = io.read_pages(spark, path, "part-*")
    number = F.substring_index("html", "|", 1)
    html = F.substr("html", F.char_length(number) + 2, F.char_length("html") - F.char_length(number) - 2)
    return back.select(number.cast("long").alias("page_id"), F.regexp_replace("site", "^site=", "").alias("site"), html.alias("html"))


@query(f"""WITH s AS (SELECT DISTINCT {HOST_SQL} AS name FROM pages), w AS (SELECT name FROM s ORDER BY name LIMIT 3)
SELECT name, true AS known FROM w UNION ALL SELECT 'nowhere.example.net', false""")
def chosen_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sites by name, and one that is not there."""
    own = sites(spark, sf_dir)
    names = [r["name"] for r in own.select("name").orderBy("name").limit(3).collect()]
    known, unknown = web.select_sites(own, [*names, "nowhere.example.net"])
    return known.select("name", F.lit(True).alias("known")).unionByName(unknown.withColumn("known", F.lit(False)))
