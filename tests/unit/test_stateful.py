"""Streams with state: listings with removals, hosts with timers."""

import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import delta
from corpusflow.streaming.stateful import STATE_STORE, listing_changes, polite_urls

LISTINGS = "rel_path string, size_bytes long, mtime double, listed_at timestamp"


@pytest.fixture(scope="module")
def stateful(spark):
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    yield spark
    spark.conf.set(STATE_STORE[0], before)


def listing(n):
    """Paths that come, change, go and come back."""
    rows = [(f"p{i}", 10 + (i % 3 == 0 and n > 1), 1.0 * i) for i in range(12) if (i + n) % 4 and i + n != 5]
    return [(*r, f"2024-01-0{n} 00:00:00") for r in rows]


def manifest(spark, n):
    rows = [(p, "u", s, None, None, p, m) for p, s, m, _ in listing(n)] if n else []
    return spark.createDataFrame(rows, "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double")


def run(spark, source, sink, at):
    stream = spark.readStream.schema(LISTINGS).option("maxFilesPerTrigger", 1).json(source)
    q = listing_changes(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and not q.isActive


def test_listings_give_the_batch_diff(stateful, tmp_path):
    """Three listings, the last after a restart from the checkpoint: what they
    change is what the batch diff of each with the one before says."""
    spark = stateful
    source, sink, at = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(n):
        rows = spark.createDataFrame([(p, s, m, t) for p, s, m, t in listing(n)], "rel_path string, size_bytes long, mtime double, listed_at string")
        rows.unionByName(rows.limit(2)).unionByName(spark.createDataFrame([(None, 1, 1.0, "2024-01-01 00:00:00")], rows.schema)).coalesce(1).write.mode("append").json(source)
        time.sleep(1.1)  # files are taken in order of their times

    arrive(1)
    arrive(2)
    run(spark, source, sink, at)
    arrive(3)
    run(spark, source, sink, at)
    got = sorted((r.rel_path, r.status, r.day) for r in spark.read.parquet(sink).select("rel_path", "status", F.dayofmonth("listed_at").alias("day")).collect())
    want = []
    for n in (1, 2, 3):
        changes = delta.diff(manifest(spark, n - 1), manifest(spark, n)).where("status <> 'same'")
        want += [(r.key, r.status, n) for r in changes.collect()]
    assert got == sorted(want) and {s for _, s, _ in want} == {"added", "modified", "removed"}


def test_a_host_waits(stateful, tmp_path):
    spark = stateful
    source = str(tmp_path / "in")
    rows = [(f"http://a/{i}", 0) for i in range(4)] + [("http://b/0", 0), ("http://a/0", 1), (None, 0)]
    spark.createDataFrame(rows, "url string, depth int").coalesce(1).write.json(source)
    q = polite_urls(spark.readStream.schema("url string, depth int").json(source), delay_ms=1500).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.table("due").count() < 5:
            time.sleep(0.5)
        got = [(r.host, r.url, r.due_at) for r in spark.table("due").orderBy("due_at").collect()]
    finally:
        q.stop()
    assert sorted(u for _, u, _ in got) == sorted({u for u, _ in rows if u})
    a = [t for h, _, t in got if h == "a"]
    assert all((y - x).total_seconds() >= 1.4 for x, y in zip(a, a[1:]))
