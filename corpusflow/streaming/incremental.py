"""Streaming forms: exact block deduplication and delta packing over arriving files.

First to arrive wins here; the batch form goes by path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import delta


def unique_blocks(docs: DataFrame, delimiter: str = "\n\n", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Blocks of a stream of (rel_path, text) that have not been seen before.
    With a watermark (time column, delay) the state forgets what is older."""
    keep = ["rel_path"] + ([watermark[0]] if watermark else [])
    b = docs.select(*keep, F.posexplode(T.blocks(F.col("text"), delimiter)).alias("pos", "block"))
    b = b.withColumn("words", T.word_count(F.col("block"))).withColumn("fp", F.md5(T.normalised(F.col("block")).cast("binary")))
    short = F.col("words") < T.MIN_BLOCK_WORDS
    b = b.withColumn("key", F.when(short, F.concat_ws("/", F.lit("short"), "rel_path", F.col("pos").cast("string"))).otherwise(F.col("fp")))
    if watermark:
        return b.withWatermark(*watermark).dropDuplicatesWithinWatermark(["key"]).drop("key")
    return b.dropDuplicates(["key"]).drop("key")


def delta_batches(read_manifest: Callable[[], DataFrame], pack_changed: Callable[[DataFrame, DataFrame], None], save_manifest: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over listings (rel_path, size_bytes, mtime, ...):
    packs what a batch adds or changes and then moves the manifest on.  Batches
    only add: what is missing from one has not been removed."""

    def run(batch: DataFrame, _: int) -> None:
        old, new = read_manifest(), delta.build_manifest(batch)
        changes = delta.diff(old, new).where(F.col("status").isin("added", "modified"))
        files = batch.join(changes.select(F.col("key").alias("rel_path")), "rel_path", "left_semi")
        if not files.isEmpty():
            pack_changed(files, changes)
            save_manifest(delta.merge(old, new).unionByName(old.join(new, "key", "left_anti")))

    return run
