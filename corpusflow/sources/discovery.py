"""URLs of a site: llms.txt, sitemaps, and the cascade over both.

Nothing is fetched here: a fetcher (url -> bytes or None) is passed in.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..sinks.files import replace_file
from ..tables import durable

Fetch = Callable[[str], bytes | None]

# Where sites keep their lists, and the limits of looking for them.
SITEMAP_SPACE = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
LLMS_FILES = ("llms.txt", "llms-full.txt")
SITEMAP_FILES = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")
MAX_DEPTH = 3
LEAST_URLS = 3


@F.pandas_udf(StringType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """Text of bodies, gunzipped where they are gzip; what does not decode is null."""

    def one(b: bytes | None) -> str | None:
        try:
            return None if b is None else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", errors="replace")
        except (OSError, EOFError):
            return None

    return bodies.map(one)


def llms_urls(bodies: DataFrame) -> DataFrame:
    """bodies: (site, body).  (site, ord, url): absolute links of Markdown,
    then a line that begins with a bare URL; blank lines and # lines say nothing."""
    lines = bodies.select("site", F.posexplode(F.split("body", r"\r\n|[\n\r]")).alias("line_no", "line"))
    lines = lines.withColumn("line", T.trimmed(F.col("line"))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    linked = F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract("line", r"^(https?://\S+)", 1)
    urls = F.concat(linked, F.when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>")))
    found = lines.select("site", "line_no", F.posexplode(urls).alias("at", "url"))
    return ordered_distinct(found, ["site"], ["line_no", "at"])


def ordered_distinct(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """(within, ord, url): each url once, where it comes first."""
    first = rows.groupBy(*within, "url").agg(F.min(F.struct(*order)).alias("first"))
    return first.select(*within, F.col("first").alias("ord"), "url")


def sitemap(body: str | None) -> tuple[str | None, list[str]]:
    """Kind of a sitemap (urlset or sitemapindex) and the trimmed, non-empty
    <loc> texts of its items; neither for anything else, broken XML included."""
    try:
        root = ElementTree.fromstring(body or "")
    except (ElementTree.ParseError, ValueError):
        return None, []
    kind = root.tag.removeprefix(SITEMAP_SPACE)
    item = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if item is None or kind == root.tag:
        return None, []
    found = (x.findtext(f"{SITEMAP_SPACE}loc") for x in root.findall(f"{SITEMAP_SPACE}{item}"))
    return kind, [x.strip() for x in found if x and x.strip()]


#: Maps whose items a task holds at once.
SLICE = 16


def read_sitemaps(bodies: DataFrame, key: str) -> DataFrame:
    """bodies: (key, body).  (key, root, locs), as ``sitemap`` has them, of all
    that are sitemaps.  Each body is read once, by one worker a task: a column
    function would be evaluated again in every filter and field that names it."""
    kind = dict(bodies.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), SLICE):
                part = b.slice(lo, SLICE)
                found = [sitemap(x) for x in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([r for r, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.string()))], names=[key, "root", "locs"])

    return bodies.select(key, "body").mapInArrow(run, f"`{key}` {kind}, root string, locs array<string>").where(F.col("root").isNotNull())


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """bodies: (site, body) of urlsets.  (site, ord, url).  What is no urlset,
    or broken, has no URLs."""
    read = read_sitemaps(bodies, "site").where(F.col("root") == "urlset")
    return ordered_distinct(read.select("site", F.posexplode("locs").alias("at", "url")), ["site"], ["at"])


def child_in_scope(child: Column, base: Column) -> Column:
    """A sub-sitemap on the base's host, or one below a path like the base's."""
    host = T.url_part(child, 2)
    folder = T.canonical_prefix(F.regexp_replace(T.url_part(child, 3), "/[^/]*$", ""))
    return (host == "") | (host == T.url_part(base, 2)) | F.startswith(folder, T.canonical_prefix(T.url_part(base, 3)))


def walk_sitemaps(maps: DataFrame, start: str, base: str, depth: int = MAX_DEPTH) -> DataFrame:
    """maps: (url, body), the sitemaps at hand.  All page URLs below ``start``
    that sit in urlsets, following indexes at most ``depth`` deep, each map
    once.  Maps are parsed once; a broken one ends its own branch alone.  Each
    level's frontier is a table, so the plan does not grow with the depth."""
    spark = maps.sparkSession
    read = durable(read_sitemaps(maps, "url"), "sitemaps")
    frontier = seen = spark.createDataFrame([(start,)], "url string")
    pages = None
    for level in range(depth + 1):
        here = frontier.join(read, "url")
        found = here.where(F.col("root") == "urlset").select(F.lit(level).alias("level"), F.col("url").alias("map"), F.posexplode("locs").alias("at", "url"))
        pages = found if pages is None else pages.unionByName(found)
        if level == depth:
            break
        children = here.where(F.col("root") == "sitemapindex").select(F.explode("locs").alias("url")).distinct()
        frontier = durable(children.where(child_in_scope(F.col("url"), F.lit(base))).join(seen, "url", "left_anti"), "sitemap-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pages.groupBy("url").agg(F.min(F.struct("level", "map", "at")).alias("ord"))


def cascade(layers: DataFrame, base: str, depth: int = 0, least: int = LEAST_URLS) -> DataFrame:
    """layers: (layer, ord, url), the best layer lowest.  In-scope URLs of the
    first layer that has at least ``least`` of them; none if no layer has."""
    scoped = layers.where(T.in_scope(F.col("url"), F.lit(base), depth)).groupBy("layer", "url").agg(F.min("ord").alias("ord"))
    wins = scoped.groupBy("layer").agg(F.count("*").alias("n")).where(F.col("n") >= least).agg(F.min("layer").alias("layer"))
    return scoped.join(wins, "layer").select("layer", "ord", "url")


def fetch_first(fetch: Fetch, base: str, names: Iterable[str], yields: Callable[[bytes], bool]) -> tuple[str, bytes] | None:
    """The first of the host's files that is there and yields anything."""
    for name in names:
        url = urljoin(f"{urlsplit(base).scheme}://{urlsplit(base).netloc}/", name)
        body = fetch(url)
        if body and yields(body):
            return url, body
    return None


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest file; unreadable or missing: none.  Fields that
    are not known are dropped, missing ones are null."""
    entry = "url string, size_bytes long, etag string, last_modified string, local_path string, mtime double"
    empty = spark.createDataFrame([], f"key string, {entry}")
    try:
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.from_json("value", f"files map<string, struct<{entry.replace(' ', ': ').replace(',:', ',')}>>").alias("m"))
        rows = parsed.select(F.explode("m.files").alias("key", "e")).select("key", "e.*")
        rows.schema  # noqa: B018  analysis fails here if the path is missing
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def _manifest_lines(manifest: DataFrame, base_url: str, last_run: str | None) -> Iterator[str]:
    """The manifest as JSON, an entry at a time."""
    last_run = last_run if last_run is not None else datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
    yield f'{{\n  "base_url": {json.dumps(base_url, ensure_ascii=False)},\n  "last_run": {json.dumps(last_run)},\n  "files": {{'
    comma = ""
    for r in manifest.orderBy("key").toLocalIterator():
        entry = json.dumps({k: r[k] for k in ("url", "size_bytes", "etag", "last_modified", "local_path", "mtime")}, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        yield f"{comma}\n    {json.dumps(r['key'], ensure_ascii=False)}: {entry}"
        comma = ","
    yield "\n  }\n}" if comma else "}\n}"


def manifest_json(manifest: DataFrame, base_url: str, last_run: str | None = None) -> str:
    """The manifest as JSON text.  ``last_run`` is now, in UTC, unless it is given."""
    return "".join(_manifest_lines(manifest, base_url, last_run))


def save_manifest(manifest: DataFrame, path: str, base_url: str = "", last_run: str | None = None) -> None:
    """The manifest's file, an entry at a time, in place of the old one at once:
    who reads meanwhile has one of both whole, and so has who comes after a
    failure."""
    replace_file(path, _manifest_lines(manifest, base_url, last_run))
