"""Links and frontiers over a table of fetched pages."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragcorpus.functions.text import url_to_filename
from ragcorpus.operators import _html
from ragcorpus.sources.keyed import append_keyed, read_keyed
from ragcorpus.sources.scratch import drop, new_path


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(html: pd.Series, base: pd.Series) -> pd.Series:
    def one(h: str | None, b: str | None) -> list[str]:
        out = []
        for link in _html.outlinks(_html.read(h)) if h else ():
            try:
                out.append(_html.urljoin(b or "", link))
            except ValueError:
                continue
        return out

    return pd.Series([one(h, b) for h, b in zip(html, base, strict=True)], dtype=object)


def extract_links(pages: DataFrame, sites: DataFrame, match: str = "exact") -> DataFrame:
    """(site, url, link): outlinks of pages(site, url, html), resolved, of http(s) and of an allowed domain of the
    page's site(name, allowed_domains); `subdomain` also admits hosts below one."""
    if match not in ("exact", "subdomain"):
        raise ValueError(f"unknown match {match!r}")
    allowed = sites.select(F.col("name").alias("site"), "allowed_domains")
    links = pages.select("site", "url", F.explode(_resolved("html", "url")).alias("link"))
    links = links.withColumn("_at", F.lower(F.try_parse_url("link", F.lit("AUTHORITY")))).where(F.lower("link").rlike("^https?://"))
    joined = links.join(allowed, "site")
    host = F.col("_at")
    if match == "exact":
        ok = F.array_contains("allowed_domains", host)
    else:
        name = F.regexp_replace(host, r"^.*@|:\d+$", "")
        ok = F.exists("allowed_domains", lambda d: (name == F.lower(d)) | name.endswith(F.concat(F.lit("."), F.lower(d))))
    return joined.where(ok).select("site", "url", "link")


def rewrite_fragment_links(links: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, url, link, target) for links(site, url, link) of help systems, `...#t=<file>`, whose rewritten target
    contains an allowed domain of the site."""
    before = F.substring_index("link", "#t=", 1)
    name = F.substring_index(F.element_at(F.split("link", "#t=", 2), 2), "#", 1)
    base = F.when(before == "", F.col("url")).otherwise(before)
    base = F.when(base.startswith("//"), F.concat(F.lit("https:"), base)).otherwise(base)
    plain = F.substring_index(F.substring_index(base, "#", 1), "?", 1)
    # the parent of the path: what stands before its last slash, behind the host
    target = F.concat(F.regexp_replace(plain, r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?)(.*?)/?[^/]*$", "$1$2"), F.lit("/"), name)
    own = links.where(F.contains(F.col("link"), F.lit("#t="))).withColumn("_name", name).withColumn("target", target).where("_name <> ''").drop("_name")
    allowed = sites.select(F.col("name").alias("site"), "allowed_domains")
    return own.join(allowed, "site").where(F.exists("allowed_domains", lambda d: F.contains(F.col("target"), d))).select("site", "url", "link", "target")


def crawl_frontier(links: DataFrame, seeds: DataFrame, max_depth: int = 0) -> DataFrame:
    """(url, depth): pages reachable from seeds(url) over links(url, link), each at its least depth; 0 is no limit.

    The links stand in buckets of the page that they start from, the known pages in buckets of their URL, each level as
    a partition. So a level is one join that shuffles neither side, one shuffle of what it found, and one anti-join to which
    the known pages are not shuffled. Only whether a level has rows comes to the driver.
    """
    spark = links.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges_path, path = new_path(spark), new_path(spark)
    append_keyed(links.where("url is not null and link is not null").select(F.col("url").alias("start"), "link").distinct(), edges_path, "start", buckets)
    known = lambda: read_keyed(spark, path, "url", buckets, ("depth",))
    append_keyed(seeds.where("url is not null").select("url").distinct().withColumn("depth", F.lit(0)), path, "url", buckets, ("depth",))
    for depth in count(1):
        if max_depth and depth > max_depth:
            break
        new = next_level(read_keyed(spark, edges_path, "start", buckets), known(), depth)
        append_keyed(new, path, "url", buckets, ("depth",))
        if known().where(F.col("depth") == depth).isEmpty():
            break
    drop(spark, edges_path)
    return known()


def next_level(edges: DataFrame | None, known: DataFrame, depth: int) -> DataFrame:
    """(url, depth): pages that links(start, link) of the level before lead to and that are not known."""
    frontier = known.where(F.col("depth") == depth - 1).select("url")
    found = frontier.join(edges, F.col("url") == F.col("start")).select(F.col("link").alias("url")).distinct()
    return found.join(known.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"))


def mark_skipped(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates(site, url, html) with filename and skipped: true, and no content, where existing(site, filename) has
    the target already."""
    own = candidates.withColumn("filename", F.concat(url_to_filename(F.col("url")), F.lit(".html")))
    have = existing.select("site", "filename").distinct().withColumn("skipped", F.lit(True))
    joined = own.join(have, ["site", "filename"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    return joined.withColumn("html", F.when(~F.col("skipped"), F.col("html")))


def crawl_summary(items: DataFrame) -> DataFrame:
    """(site, saved, skipped) counts of items(site, skipped)."""
    return items.groupBy("site").agg(F.count_if(~F.col("skipped")).alias("saved"), F.count_if(F.col("skipped")).alias("skipped"))


def select_sites(sites: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sites of the names, names that are unknown)."""
    wanted = sites.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return sites.join(F.broadcast(wanted), "name", "left_semi"), wanted.join(sites.select("name"), "name", "left_anti")
