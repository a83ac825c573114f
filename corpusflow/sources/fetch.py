"""Fetchers: what is asked for in, what came back out.

A fetcher is a function of DataFrames: from (url, etag, last_modified), the
validators of what is already there, to ``FETCHED``.  ``by_host`` makes one of
a function for one URL, ``from_table`` of a table that has the pages already.
One with ``asks_hosts`` false visits no host: a crawl has nobody to spare.
"""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .doctree import decode

#: status: that of HTTP, null where nothing answered; body: text, null where there is none.
FETCHED = "url string, status int, etag string, last_modified string, body string, error string"
_SCHEMA = pa.schema([("url", pa.string()), ("status", pa.int32()), ("etag", pa.string()), ("last_modified", pa.string()), ("body", pa.string()), ("error", pa.string())])

Fetcher = Callable[[DataFrame], DataFrame]

# Attempts, and the base of the seconds between them.
ATTEMPTS, BACKOFF = 3, 2.0


@dataclass
class Response:
    status: int
    body: bytes | None = None
    etag: str | None = None
    last_modified: str | None = None


def http_get(url: str, etag: str | None = None, last_modified: str | None = None, timeout: float = 15.0, agent: str = "corpusflow") -> Response:
    """One conditional GET with a time limit.  Statuses are answers; no answer raises."""
    headers = {"User-Agent": agent, "Accept-Encoding": "gzip"}
    if etag:
        headers["If-None-Match"] = etag
    if last_modified:
        headers["If-Modified-Since"] = last_modified
    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:
            return Response(r.status, r.read(), r.headers.get("ETag"), r.headers.get("Last-Modified"))
    except HTTPError as e:
        e.close()
        return Response(e.code, None, e.headers.get("ETag"), e.headers.get("Last-Modified"))


def text_of(body: bytes | None) -> str | None:
    """Decoded, gunzipped before where it is gzip; broken gzip is nothing."""
    try:
        return None if body is None else decode(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    except (OSError, EOFError):
        return None


def by_host(get: Callable[..., Response] = http_get, delay: float = 0.0, attempts: int = ATTEMPTS, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Fetcher:
    """A host's URLs go to one task, one after the other, at least ``delay``
    seconds apart; hosts side by side.  A URL without answer is tried again,
    ``backoff`` to the power of the attempt later; servers' errors (5xx) too.
    How many URLs of a host come at once is the crawl's to say."""

    def one(url: str, etag: str | None, last: str | None) -> tuple:
        error = None
        for attempt in range(1, attempts + 1):
            try:
                r = get(url, etag, last)
                if r.status < 500 or attempt == attempts:
                    return url, r.status, r.etag or etag, r.last_modified or last, text_of(r.body), None
            except Exception as e:  # whatever a fetch meets is that URL's matter alone
                error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                sleep(backoff**attempt)
        return url, None, None, None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, before = None, 0.0
        for b in batches:
            for h, url, etag, last in zip(*(b.column(c).to_pylist() for c in ("host", "url", "etag", "last_modified")), strict=True):
                if delay > 0 and h == host and (wait := before + delay - clock()) > 0:
                    sleep(wait)
                host, before = h, clock()
                row = one(url, etag, last)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    def fetch(asked: DataFrame) -> DataFrame:
        hosts = asked.select(F.coalesce(T.url_part(F.col("url"), 2), F.lit("")).alias("host"), "url", "etag", "last_modified")
        return hosts.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, FETCHED)

    return fetch


def from_table(pages: DataFrame) -> Fetcher:
    """Pages of a table (url, body, and etag, last_modified if it has them): 200,
    304 where a validator that was sent still holds, 404 where the table has no
    such URL.  Of several rows of a URL one answers."""
    have = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified", "body")]
    held = pages.select("url", F.struct(*have).alias("_p")).groupBy("url").agg(F.min("_p").alias("_p"))

    def fetch(asked: DataFrame) -> DataFrame:
        j = asked.join(held, "url", "left")
        same = F.coalesce(F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("_p.etag")).otherwise(F.col("last_modified") == F.col("_p.last_modified")), F.lit(False))
        status = F.when(F.col("_p").isNull(), 404).when(same, 304).otherwise(200)
        return j.select("url", status.cast("int").alias("status"), F.col("_p.etag").alias("etag"), F.col("_p.last_modified").alias("last_modified"), F.when(status == 200, F.col("_p.body")).alias("body"), F.lit(None).cast("string").alias("error"))

    fetch.asks_hosts = False
    return fetch
