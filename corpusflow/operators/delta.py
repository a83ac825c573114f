"""Manifests of a tree: what changed, and what carries over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def build_manifest(files: DataFrame, base_url: str = "") -> DataFrame:
    """(key, url, size_bytes, etag, last_modified, local_path, mtime) of files
    (rel_path, size_bytes, mtime); a leading host directory is no part of a key."""
    host = base_url.split("://", 1)[-1].split("/", 1)[0] if "://" in base_url else ""
    path, root = F.col("rel_path"), base_url.rstrip("/")
    rel = F.when(F.startswith(path, F.lit(host + "/")), F.ltrim(F.expr(f"substring(rel_path, {len(host) + 1})"), F.lit("/"))).when(path == host, F.lit("")).otherwise(path) if host else path
    url = F.when(rel == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), rel))
    key = F.when(rel == "", path).otherwise(rel)
    none = F.lit(None).cast("string")
    return files.select(key.alias("key"), url.alias("url"), F.col("size_bytes").cast("long").alias("size_bytes"), none.alias("etag"), none.alias("last_modified"), path.alias("local_path"), F.col("mtime").cast("double").alias("mtime"))

def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status): added, removed, modified (size, else time, differs) or same."""
    o = old.select("key", F.col("size_bytes").alias("os"), F.col("mtime").alias("om"), F.lit(True).alias("o"))
    n = new.select("key", F.col("size_bytes").alias("ns"), F.col("mtime").alias("nm"), F.lit(True).alias("n"))
    same = F.col("os").eqNullSafe(F.col("ns")) & F.col("om").eqNullSafe(F.col("nm"))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(same, "same").otherwise("modified")
    return o.join(n, "key", "full").select("key", status.alias("status"))

def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new manifest; where size is unchanged, with the old validators."""
    o = old.select("key", F.col("size_bytes").alias("_s"), F.col("etag").alias("_e"), F.col("last_modified").alias("_l"))
    kept = F.col("_s") == F.col("size_bytes")
    j = new.join(o, "key", "left")
    return j.select("key", "url", "size_bytes", F.when(kept, F.coalesce("etag", "_e")).otherwise(F.col("etag")).alias("etag"), F.when(kept, F.coalesce("last_modified", "_l")).otherwise(F.col("last_modified")).alias("last_modified"), "local_path", "mtime")

def url_map(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(rel_path, url): of the first entry, by key, whose local path, or whose
    key, is the file's path."""
    rows = manifest.where(F.col("url").isNotNull() & (F.col("url") != ""))
    local = rows.select(F.coalesce(F.when(F.col("local_path") != "", F.col("local_path")), F.col("key")).alias("rel_path"), "key", "url")
    both = local.unionByName(rows.select(F.col("key").alias("rel_path"), "key", "url"))
    first = both.groupBy("rel_path").agg(F.min_by("url", "key").alias("url"))
    return files.select("rel_path").join(first, "rel_path")

def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files whose time is new or later, and unchanged ones."""
    j = after.join(before.select("rel_path", F.col("mtime").alias("_m")), "rel_path", "left")
    fresh = F.col("_m").isNull() | (F.col("mtime") > F.col("_m"))
    return j.agg(F.count_if(fresh).alias("touched"), F.count_if(~fresh).alias("unchanged"))

__all__ = ["build_manifest", "diff", "merge", "touched", "url_map"]
