"""Column functions for URLs, HTML and plain text. Regular expressions use ASCII classes, as Spark's engine does."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def normalize_url(url: Column) -> Column:
    """The URL up to its fragment and its query."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def url_to_filename(url: Column) -> Column:
    """The URL's path without slashes at its ends; `index` where that is empty."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(F.nullif(F.btrim(path, F.lit("/")), F.lit("")), F.lit("index"))


def is_pdf_url(url: Column) -> Column:
    """True where the URL ends in .pdf or its last path segment speaks of one."""
    low = F.lower(url)
    return low.endswith(".pdf") | F.contains(F.substring_index(low, "/", -1), F.lit("pdf"))


def path_domain(path: Column, root: str) -> Column:
    """The first directory below root, else `unknown`."""
    below = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2)))
    parts = F.split(below, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit("unknown"))


def unescape_basic(text: Column) -> Column:
    """The five character references of markup, and the non-breaking space."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def page_title(html: Column) -> Column:
    """The first title's text, stripped; `Untitled` where there is none or it is empty."""
    raw = F.regexp_extract(html, TITLE, 1)
    return F.when(raw == "", F.lit("Untitled")).otherwise(unescape_basic(F.regexp_replace(raw, r"^\s+|\s+$", "")))


def crawl_title(html: Column) -> Column:
    """The first title's text, stripped, or the empty text."""
    return unescape_basic(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"^\s+|\s+$", ""))


def remove_javascript(html: Column) -> Column:
    """html without what runs: script elements, event attributes and javascript: links, which lead to # (case-sensitive)."""
    inert = F.regexp_replace(html, r"""(?<=href=")javascript:[^"]*(?=")|(?<=href=')javascript:[^']*(?=')""", "#")
    return F.regexp_replace(inert, r"""(?s)<script\b[^>]*>.*?</script>| on\w+=(?:"[^"]*"|'[^']*')|(?<=\s)javascript:""", "")


def strip_tags(html: Column) -> Column:
    """Tags and runs of white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "), F.lit(" "))


#: The marks of elements whose opening tags begin so.
ELEMENT_MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "li": "• "}
#: Pieces of a page that are not text: elements and comments that are not shown, and tags, named where they may be marked.
_PIECE = re.compile(rf"<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->|<(?P<open>{'|'.join(ELEMENT_MARKS)})[^>]*>|</(?P<close>{'|'.join(ELEMENT_MARKS)})>|<(?P<other>)[^>]+>", re.DOTALL)


def one_line(html: str) -> str:
    """A page as one line of text with marks for headings and list items, in one walk over its tags.

    An opening tag of a marked element is a mark if the element is closed and none of its name is open; the closing tag of
    an item leaves nothing. All other tags are spaces.
    """
    out: list[str] = []
    begun: dict[str, int] = {}  # by name, where in `out` the mark of an open element may go
    at = 0
    for m in _PIECE.finditer(html):
        out.append(html[at : m.start()])
        at = m.end()
        if (name := m["open"]) is not None:
            begun.setdefault(name, len(out))
            out.append(" ")
        elif (name := m["close"]) is not None:
            if name in begun:
                out[begun.pop(name)] = f" {ELEMENT_MARKS[name]}"
                out.append("" if name == "li" else " ")
            else:
                out.append(" ")
        elif m["other"] is not None:
            out.append(" ")
    out.append(html[at:])
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(out)).strip(" ")


@F.pandas_udf(T.StringType())
def basic_clean_html(html: pd.Series) -> pd.Series:
    """one_line of each page; a null stays null."""
    return html.map(one_line, na_action="ignore")


def tokenize(text: Column) -> Column:
    """Lower-cased words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def fixed_windows(text: Column, size: int, overlap: int, most: int | None = None) -> Column:
    """Array of windows of `size` characters that start every size - overlap."""
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than size ({size})")
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    starts = F.slice(starts, 1, most) if most is not None else starts
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def extract_snippet(text: Column, query: Column, most: int = 160) -> Column:
    """The first of the sentences with most of the query's terms, cut to `most` characters."""
    # terms that repeat count again; a term counts by occurring anywhere
    terms = tokenize(query)
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s, i: F.struct(F.lower(s).alias("low"), (-i).alias("at"), s.alias("sentence")))
    scored = F.transform(sentences, lambda x: F.struct(F.size(F.filter(terms, lambda t: F.contains(x["low"], t))).alias("hits"), x["at"].alias("at"), x["sentence"].alias("sentence")))
    return F.substring(F.array_max(scored)["sentence"], 1, most)
