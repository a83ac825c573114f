"""Keyed state over streams: what listings of a tree change, and URLs that are
handed out host by host.

Both are ``transformWithState`` processors: state lies with its key in the
checkpoint (RocksDB), so a restarted query goes on where it was, and a task
holds one key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

#: What a query with state needs of its session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "rel_path string, status string, listed_at timestamp, size_bytes long, mtime double"


def _when(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Listings(StatefulProcessor):
    """One path: what the last listing that had it said.  A timer goes off once
    a later listing is complete; if that did not have the path, it is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "size_bytes long, mtime double, listed long")

    def _watch(self, listed: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(listed + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        path, passed = key[0], timerValues.getCurrentWatermarkInMs()
        held = self.known.get()
        for r in sorted(rows, key=lambda r: r.listed):
            if held is not None and r.listed <= held[2]:
                continue  # an older listing, or a repeated row
            if held is not None and held[2] < passed < r.listed:  # a listing in between did not have it
                yield Row(rel_path=path, status="removed", listed_at=_when(passed), size_bytes=held[0], mtime=held[1])
                held = None
            if held is None:
                yield Row(rel_path=path, status="added", listed_at=_when(r.listed), size_bytes=r.size_bytes, mtime=r.mtime)
            elif (r.size_bytes, r.mtime) != (held[0], held[1]):
                yield Row(rel_path=path, status="modified", listed_at=_when(r.listed), size_bytes=r.size_bytes, mtime=r.mtime)
            held = (r.size_bytes, r.mtime, r.listed)
        if held is not None:
            self.known.update(held)
            self._watch(held[2])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, passed = self.known.get(), timerValues.getCurrentWatermarkInMs()
        if held is not None and held[2] < passed:
            self.known.clear()
            yield Row(rel_path=key[0], status="removed", listed_at=_when(passed), size_bytes=held[0], mtime=held[1])

    def close(self) -> None:
        pass


def listing_changes(listings: DataFrame) -> DataFrame:
    """``CHANGES`` of a stream of listings (rel_path, size_bytes, mtime,
    listed_at), each row of a listing with its time: added, modified (size or
    time differs) and removed, as ``delta.diff`` says it of a listing and the
    one before it.

    A path is removed once a later listing has come whole, that is in the batch
    after it (or in one without data, which Spark runs on its own).  Listings
    that come in one batch count as one for what they lack.  Rows without path
    or time say nothing; repeated rows and late listings change nothing.  A
    listing without any row cannot be seen."""
    rows = listings.where(F.col("rel_path").isNotNull() & F.col("listed_at").isNotNull()).withWatermark("listed_at", "0 seconds")
    rows = rows.select("rel_path", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("mtime").cast("double").alias("mtime"), "listed_at", F.unix_millis("listed_at").alias("listed"))
    return rows.groupBy("rel_path").transformWithState(Listings(), CHANGES, "Append", "EventTime")


DUE = "host string, url string, depth int, due_at timestamp"


class Hosts(StatefulProcessor):
    """One host: its queue, a URL at a time under a running number, so that
    neither a new URL nor a taken one touches the others; and a timer."""

    def __init__(self, delay_ms: int, burst: int):
        self.delay_ms, self.burst = delay_ms, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "n long", "url string, depth int")
        self.seen = handle.getMapState("seen", "url string", "depth int")
        self.ends = handle.getValueState("ends", "head long, tail long, due long")

    def _hand_out(self, host: str, now: int) -> Iterator[Row]:
        head, tail, _ = self.ends.get()
        for _ in range(self.burst):
            if head == tail:
                break
            url, depth = self.queue.getValue((head,))
            self.queue.removeKey((head,))
            head += 1
            yield Row(host=host, url=url, depth=depth, due_at=_when(now))
        self.ends.update((head, tail, now + self.delay_ms))
        if head < tail:
            self.handle.registerTimer(now + self.delay_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        head, tail, due = self.ends.get() or (0, 0, 0)
        waits = head < tail
        for r in rows:
            if not self.seen.containsKey((r.url,)):  # a URL is handed out once
                self.seen.updateValue((r.url,), (r.depth,))
                self.queue.updateValue((tail,), (r.url, r.depth))
                tail += 1
        self.ends.update((head, tail, due))
        if not waits and head < tail:
            if now >= due:
                yield from self._hand_out(key[0], now)
            else:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._hand_out(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def polite_urls(urls: DataFrame, delay_ms: int = 1000, burst: int = 1) -> DataFrame:
    """``DUE`` of a stream of (url, depth): each URL once, at most ``burst`` of a
    host every ``delay_ms``, in the order in which they came.  Feed what the
    fetched pages name back into the stream for a crawl without rounds."""
    rows = urls.where(F.col("url") != "").select(F.coalesce(T.url_part(F.col("url"), 2), F.lit("")).alias("host"), "url", F.col("depth").cast("int").alias("depth"))
    return rows.groupBy("host").transformWithState(Hosts(delay_ms, burst), DUE, "Append", "ProcessingTime")
