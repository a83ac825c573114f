"""Sharding by extendible hashing, in DataFrame operations only.

A directory over hash prefixes says which shard a row belongs to.  It starts
with one bucket; a bucket over the byte limit, and only such a bucket, is split
on one more bit, until each fits.  All depths of a round are found at once from
per-cell sums: a cell is a long prefix, its bytes are added up for each of its
shorter prefixes, and the shallowest prefix that fits is its bucket.  Cells
that are still too large are cut on further bits in the next round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Bits that come from the key; deeper ones tell apart rows that share it.
KEY_BITS = 32
MAX_BITS = 60


def _slim(docs: DataFrame, key: str, text: str, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, bytes, and 60 hash bits: 32 of the key (the start of the MD5 of
    "seed:key"), then bits that differ between rows of one key (of their
    content and their place in the scan)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    top = F.conv(F.substring(F.md5(named.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")
    row = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(text), F.monotonically_increasing_id()), F.lit(1 << (MAX_BITS - KEY_BITS)))
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col(key).alias("_key"), size.alias("_bytes"), (F.shiftleft(top, MAX_BITS - KEY_BITS) + row).alias("_h"), *keep)


def _prefix(h, bits):
    """The first ``bits`` of the hash; as a column expression in both."""
    return F.call_function("shiftright", h, F.lit(MAX_BITS) - bits)


def directory(cells: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """cells: (prefix of ``depth`` bits, bytes, rows), below buckets of
    ``base`` bits known to be too large.  Returns each cell with the local
    depth of its bucket: the shallowest prefix within the limit or with one row
    alone, or null where even the cell is too large."""
    deep = F.lit(depth)
    up = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(base), deep)).alias("bits"))
    up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), deep - F.col("bits")))
    sums = up.groupBy("bits", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n"))
    fits = up.join(sums.where((F.col("b") <= limit) | (F.col("n") == 1)), ["bits", "prefix"]).groupBy("cell").agg(F.min("bits").alias("bits"))
    return cells.join(fits, "cell", "left")


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text", seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, bytes, shard_id, local_depth, shard_bytes, shard_rows, oversize)
    for each row; ``shard_id`` is the bucket's hash prefix with a leading 1.

    Every shard has at most ``limit_bytes`` bytes of text, except a single row
    that is larger alone (``oversize``).  Null texts have no bytes; null keys
    hash like any key; rows with one key stay together until their bucket has
    used up the key's bits, then they part on bits of their own, so a key that
    holds a third of all rows is split like any other.  Extra columns are
    ignored, but for those in ``keep``; an empty table gives an empty result.  The rows' hashes and sizes
    are written once to the shared folder.
    """
    if limit_bytes <= 0:
        raise ValueError("limit_bytes must be positive")
    slim = durable(_slim(docs, key, text, seed, keep), "shard-rows")
    total = slim.agg(F.sum("_bytes")).first()[0] or 0
    depth = min(MAX_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    done, open_, base = None, slim, 0
    while True:
        cells = open_.groupBy(_prefix(F.col("_h"), F.lit(depth)).alias("cell")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("rows"))
        known = durable(directory(cells, limit_bytes, base, depth), "shard-cells")
        found = known.where(F.col("bits").isNotNull()).select(F.lit(depth).alias("depth"), "cell", "bits")
        done = found if done is None else done.unionByName(found)
        rest = known.where(F.col("bits").isNull())
        if depth >= MAX_BITS or rest.isEmpty():
            if depth >= MAX_BITS:
                done = done.unionByName(rest.select(F.lit(depth).alias("depth"), "cell", F.lit(depth).alias("bits")))
            break
        step = min(6, MAX_BITS - depth)
        open_ = open_.join(rest.select(F.col("cell").alias("_cell")), _prefix(F.col("_h"), F.lit(depth)) == F.col("_cell"), "left_semi")
        base, depth = depth + 1, depth + step
    depths = [r[0] for r in done.select("depth").distinct().collect()]  # one per round
    placed = None
    for d in sorted(depths):
        own = done.where(F.col("depth") == d).select("cell", "bits")
        part = slim.withColumn("cell", _prefix(F.col("_h"), F.lit(d))).join(own, "cell")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = slim.withColumn("cell", F.lit(0).cast("long")).withColumn("bits", F.lit(0))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    placed = placed.select("_key", "_bytes", (one + _prefix(F.col("_h"), F.col("bits"))).alias("shard_id"), F.col("bits").alias("local_depth"), *keep)
    sums = placed.groupBy("shard_id").agg(F.sum("_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return placed.join(sums, "shard_id").select(F.col("_key").alias(key), F.col("_bytes").alias("bytes"), "shard_id", "local_depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit_bytes).alias("oversize"), *keep)


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as one folder of Parquet files per shard below ``path``
    and return the shards' sizes.  Rows are numbered in a durable table and
    join their shard by number, so rows of one key part as ``shard`` parts them."""
    rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()), "shard-docs")
    placed = durable(shard(rows, limit_bytes, key, text, keep=("_row",)), "shard-placed", slim=True)
    joined = rows.join(placed.select("_row", "shard_id"), "_row").drop("_row")
    joined.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    return placed.groupBy("shard_id").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_rows").alias("shard_rows"))
