"""A site, fetched: its lists of URLs where it has them, else its links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.html import parse_pages
from ..operators import report
from ..sources import discovery, spa
from ..sources.fetch import Fetcher
from ..tables import durable
from .crawl import CrawlOptions, crawl


@dataclass
class Downloaded:
    """pages: as ``crawl`` returns them; files: (rel_path, size_bytes, mtime,
    content) of those that are there; manifest: with validators; layer: what
    the URLs came from (llms, sitemap, links)."""

    pages: DataFrame
    files: DataFrame
    manifest: DataFrame
    layer: str
    rendered: bool
    summary: dict


def _bodies(spark: SparkSession, fetch: Fetcher, urls: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    return fetch(asked.select("url", none.alias("etag"), none.alias("last_modified"))).where(F.col("body").isNotNull()).select("url", "body")


def discover(spark: SparkSession, url: str, fetch: Fetcher, depth: int = 0, least: int = discovery.LEAST_URLS) -> tuple[str, DataFrame]:
    """(layer, URLs): of the site's llms.txt files, else of its sitemaps, where
    at least ``least`` of them are in scope; none: links.  Of each layer the
    first file that names any URL counts."""
    root = f"{urlsplit(url).scheme}://{urlsplit(url).netloc}/"
    llms = [urljoin(root, x) for x in discovery.LLMS_FILES]
    found = discovery.llms_urls(_bodies(spark, fetch, llms).withColumnRenamed("url", "site"))
    maps = [urljoin(root, x) for x in discovery.SITEMAP_FILES]
    for layer, files, named in (("llms", llms, found), ("sitemap", maps, None)):
        for file in files:
            urls = named.where(F.col("site") == file).select("url") if named is not None else _mapped(spark, file, url, fetch)
            if urls.isEmpty():
                continue
            rows = discovery.cascade(urls.select(F.lit(1).alias("layer"), F.lit(0).alias("ord"), "url"), url, depth, least).select("url")
            if not rows.isEmpty():
                return layer, rows
            break  # the first that names URLs is the layer's; too few of them are in scope
    return "links", spark.createDataFrame([(url,)], "url string")


def _mapped(spark: SparkSession, file: str, url: str, fetch: Fetcher) -> DataFrame:
    """Page URLs below a sitemap, whose children in scope are fetched level by level."""
    maps = durable(_bodies(spark, fetch, [file]), "sitemaps")
    seen = maps
    for _ in range(discovery.MAX_DEPTH):
        read = discovery.read_sitemaps(maps, "url").where(F.col("root") == "sitemapindex")
        children = read.select(F.explode("locs").alias("url")).distinct().where(discovery.child_in_scope(F.col("url"), F.lit(url)))
        children = children.join(seen.select("url"), "url", "left_anti")
        if children.isEmpty():
            break
        none = F.lit(None).cast("string")
        maps = durable(fetch(children.select("url", none.alias("etag"), none.alias("last_modified"))).where(F.col("body").isNotNull()).select("url", "body"), "sitemaps")
        seen = seen.unionByName(maps)
    return discovery.walk_sitemaps(seen, file, url).select("url")


def as_files(pages: DataFrame) -> DataFrame:
    """(rel_path, size_bytes, mtime, content) of pages with a body; of several
    URLs of one file the first by code point."""
    got = pages.where(F.col("body").isNotNull()).groupBy("local_path").agg(F.min_by("body", "url").alias("content"), F.min_by("last_modified", "url").alias("_m"))
    return got.select(F.col("local_path").alias("rel_path"), F.octet_length("content").cast("long").alias("size_bytes"), http_time(F.col("_m")).alias("mtime"), "content")


@F.pandas_udf(DoubleType())
def http_time(said: pd.Series) -> pd.Series:
    """Seconds of an HTTP date; what is none has no time."""

    def one(x: str | None) -> float | None:
        try:
            return parsedate_to_datetime(x).timestamp() if x else None
        except ValueError:
            return None

    return said.map(one).astype("float64")


def manifest_of(pages: DataFrame) -> DataFrame:
    """A manifest entry of every file: key without the host, with validators."""
    got = pages.where(F.col("body").isNotNull()).groupBy("local_path").agg(F.min(F.struct("url", F.octet_length("body").cast("long").alias("size_bytes"), "etag", "last_modified")).alias("p"))
    key = F.regexp_replace("local_path", "^[^/]*/", "")
    return got.select(key.alias("key"), "p.url", "p.size_bytes", "p.etag", "p.last_modified", "local_path", http_time(F.col("p.last_modified")).alias("mtime"))


def download(spark: SparkSession, url: str, fetch: Fetcher, base: str | None = None, options: CrawlOptions | None = None, previous: DataFrame | None = None, render: Fetcher | None = None, scope_depth: int = 0, log: Callable[[str], None] = lambda _: None) -> Downloaded:
    """The site below ``url``: the URLs that it lists, else whatever its links
    reach.  Where most pages are shells of an application, and ``render`` (a
    fetcher that runs scripts) is given, the URLs are crawled again with it."""
    o = options or CrawlOptions(depth=scope_depth)
    layer, urls = discover(spark, url, fetch, scope_depth)
    log(f"URLs from {layer}")
    pages = crawl(urls, fetch, base and f"{base}/plain", replace(o, follow=o.follow and layer == "links"), previous)
    rendered = False
    if render is not None:
        parsed = parse_pages(as_files(pages).select("rel_path", "content"))
        facts = spa.is_spa(spa.shells(parsed)).first()
        if facts["spa"] or (layer == "links" and facts["files"] <= 1):
            log("pages are shells: rendered")
            rendered = True
            seeds = urls.unionByName(spark.createDataFrame([(url,)], "url string")).distinct()
            pages = crawl(seeds, render, base and f"{base}/rendered", o, previous)
    manifest = manifest_of(pages)
    counts = pages.agg(F.count_if(F.col("body").isNotNull() & ~F.col("unchanged")).alias("new"), F.count_if("unchanged").alias("same"), F.count_if(F.col("body").isNull()).alias("failed")).first()
    return Downloaded(pages, as_files(pages), manifest, layer, rendered, report.download_summary(manifest, counts["new"], counts["same"]) | {"failed": counts["failed"]})
