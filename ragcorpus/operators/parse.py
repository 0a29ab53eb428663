"""Pages to cleaned documents: parsing by site configuration, and text of capped length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragcorpus.operators import _html
from ragcorpus.operators._batches import few_rows

STRIP = ("nav", "footer", "script", "style")
CONTENT, TITLE = "main", "//title"
ERROR_TITLE, ERROR_BODY = "Error Parsing Page", "Error parsing the HTML content"
CAP = 50_000


def parse_page(html: str | None, base: str, content: str = CONTENT, strip: tuple[str, ...] = STRIP, fallback: bool = True, drop_tail: bool = False, title: str | None = None) -> tuple[str, str]:
    """(title, Markdown) of one page; what cannot be parsed gives fixed texts. A selector that cannot be read is a ValueError.

    Selectors are those of _html.selector. The title is that of the page as it came, but for what is stripped.
    """
    chooses, names = _html.selector(content), _html.selector(title or TITLE)
    unwanted = tuple(steps for s in strip for steps in _html.selector(s))
    try:
        if html is None:
            raise ValueError("no page")
        root = _html.read(html)
        _html.strip(root, unwanted, drop_tail)
        node = _html.first(root, names)
        raw = node.text() if node else ""
        _html.absolutize(root, base)
        chosen = _html.first(root, chooses) or (_html.first(root, _html.selector("body")) if fallback else None)
        if chosen is None:
            body = html if fallback else ""
            return (raw.strip() if raw else "Untitled"), _html.markdown(_html.read(body)) if body else ""
        return (raw.strip() if raw else "Untitled"), _html.markdown(chosen)
    except Exception:  # noqa: BLE001 - one bad page gives its error text, by contract
        return ERROR_TITLE, ERROR_BODY


def parse_pages(pages: DataFrame, sites: DataFrame | None = None, drop_tail: bool = False) -> DataFrame:
    """pages(url, site, html, ...) with title and markdown, a map over the pages.

    sites(name, base_url, parser struct<content_selector, title_selector, strip_selectors, fallback_to_body>) is joined;
    pages of no known site use the defaults.
    """
    own = pages.drop("title", "markdown")
    if sites is not None:
        config = sites.select(F.col("name").alias("_name"), F.col("base_url").alias("_base"), F.to_json("parser").alias("_config"))
        own = own.join(config, F.col("site") == F.col("_name"), "left").drop("_name")
    else:
        own = own.withColumns({"_base": F.lit(None).cast("string"), "_config": F.lit(None).cast("string")})
    base = F.coalesce("url", "_base", F.lit(""))

    @F.pandas_udf("struct<title:string,markdown:string>")
    def parse(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import json

        for html, at, config in few_rows(parts):
            rows = []
            for h, b, c in zip(html, at, config, strict=True):
                own = json.loads(c) if c else {}
                rows.append(parse_page(h, b, own.get("content_selector") or CONTENT, tuple(own.get("strip_selectors", STRIP)), own.get("fallback_to_body", True), drop_tail, own.get("title_selector")))
            yield pd.DataFrame(rows, columns=["title", "markdown"])

    parsed = own.withColumn("_p", parse("html", base, "_config"))
    return parsed.withColumns({"title": F.col("_p.title"), "markdown": F.col("_p.markdown")}).drop("_p", "_base", "_config")


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """Visible text: stripped text nodes, one a line."""
    return html.map(lambda h: _html.visible_text(_html.read(h)) if h else "")


@F.pandas_udf(T.StringType())
def absolutize(link: pd.Series, base: pd.Series) -> pd.Series:
    """Links made absolute on their page's URL; kept as they are where that is impossible or not wanted."""

    def one(value: str | None, at: str | None) -> str | None:
        if value is None or value.startswith((*_html.KEPT_LINKS, "tel:", "data:")):
            return value
        try:
            return _html.urljoin(at or "", value)
        except ValueError:
            return value

    return pd.Series([one(v, b) for v, b in zip(link, base, strict=True)], dtype=object)


def assemble_capped_text(page_texts: DataFrame, key: str = "doc_id", order: str = "page", text: str = "text", cap: int = CAP) -> DataFrame:
    """(key, text): non-empty page texts in order until the length before a page reaches the cap; cut and marked where
    all pages together exceed it. A document is one window partition, bounded by its pages."""
    own = page_texts.withColumn("_len", F.char_length(F.coalesce(F.col(text), F.lit(""))))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_before", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    kept = F.when((F.col("_len") > 0) & (F.col("_before") < cap), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    grouped = placed.groupBy(key).agg(F.sum("_len").alias("_total"), F.count(order).alias("_pages"), F.sort_array(F.collect_list(kept)).alias("_t"))
    joined = F.array_join(F.transform("_t", lambda x: x["t"]), "\n\n")
    marked = F.when(F.col("_total") > cap, F.concat(F.substring(joined, 1, cap), F.lit(f"\n\n[Truncated at {cap} characters]"))).otherwise(joined)
    return grouped.select(key, F.when(F.col("_pages") == 0, F.lit("PDF contains no pages.")).otherwise(marked).alias("text"))


def is_error(title: Column) -> Column:
    return title == ERROR_TITLE
