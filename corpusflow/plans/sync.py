"""A tree that has been fetched again: what changed, packed, and the new manifest."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delta, report
from ..options import PackOptions
from ..tables import durable
from .pack import Packed, pack

_MANIFEST = "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double"


@dataclass
class Synced:
    """The packed changes, the manifest to keep, and how many files were
    fetched anew or found as they were."""

    packed: Packed
    manifest: DataFrame
    touched: int
    unchanged: int
    summary: dict


def sync(files: DataFrame, options: PackOptions, manifest: DataFrame | None = None, base_url: str = "") -> Synced:
    """files (rel_path, size_bytes, mtime, content) as they are now, and the
    manifest of the last run.  Files that are gone leave the manifest; entries
    of unchanged size keep their validators."""
    old = manifest if manifest is not None else files.sparkSession.createDataFrame([], _MANIFEST)
    new = delta.build_manifest(files, base_url)
    merged = durable(delta.merge(old, new), "manifest")
    before = old.select(F.coalesce("local_path", "key").alias("rel_path"), "mtime")
    seen = delta.touched(before, new.select(F.col("local_path").alias("rel_path"), "mtime")).first()
    packed = pack(files, replace(options, delta=True), manifest=old)
    return Synced(packed, merged, seen["touched"], seen["unchanged"], report.download_summary(merged, seen["touched"], seen["unchanged"]))
