"""The data side of a crawl: where a page is kept, which URLs it names, and
which of them are still to be fetched.  Nothing is fetched here."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.html import anchors_of, tape_of

# Suffixes that a page's path keeps.
SUFFIXES = ("html", "md", "txt")


def local_path(url: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """host/path of a page's file: a folder's page is its index.html, and a
    path without one of the suffixes gets .html."""
    path = T.url_part(url, 3)
    known = F.lit(False)
    for x in suffixes:
        known = known | F.endswith(path, F.lit(f".{x.strip().lower()}"))
    full = F.when((path == "") | F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html"))).when(known, path).otherwise(F.concat(path, F.lit(".html")))
    return F.concat(T.url_part(url, 2), F.lit("/"), F.ltrim(full, F.lit("/")))


@F.pandas_udf(ArrayType(StringType()))
def absolute_links(urls: pd.Series, pages: pd.Series) -> pd.Series:
    """URLs that a page's anchors name, on its own host, without fragments, in
    order; those of a page that cannot be parsed: none."""

    def one(url: str | None, page: str | None) -> list[str]:
        try:
            found = [href for href, _ in anchors_of(tape_of(page or "")) if href]
            own = urlsplit(url or "")
        except (AssertionError, ValueError, IndexError):
            return []
        out = []
        for href in found:
            try:
                full = urljoin(url or "", href)
                parts = urlsplit(full)
            except ValueError:  # no URL
                continue
            if parts.netloc == own.netloc and parts.scheme in ("http", "https"):
                out.append(full.partition("#")[0])
        return list(dict.fromkeys(out))

    return pd.Series([one(u, p) for u, p in zip(urls, pages, strict=True)])


def next_frontier(fetched: DataFrame, visited: DataFrame, depth: int = 0) -> DataFrame:
    """fetched: (url, depth, html); visited: (url).  (url, depth) of the URLs
    that the pages name and nobody has visited, each once at its least depth;
    at most ``depth`` steps from the start (0: any)."""
    named = fetched.select((F.col("depth") + 1).alias("depth"), F.explode(absolute_links("url", "html")).alias("url"))
    if depth > 0:
        named = named.where(F.col("depth") <= depth)
    return named.groupBy("url").agg(F.min("depth").alias("depth")).join(visited.select("url").distinct(), "url", "left_anti")
