"""A directory tree as a table (rel_path, size_bytes, mtime, content): every
file, hidden ones too, listed and read by tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sinks.files import store_of
from ..tables import durable


def decode(raw: bytes) -> str:
    """UTF-8 with U+FFFD for what is invalid, line ends made alike."""
    return raw.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")


def children(root: str, folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(path below the root, is a folder, bytes, mtime) of what a folder holds;
    links to folders are neither followed nor files."""
    fs, base = store_of(root)
    at = f"{base.rstrip('/')}/{folder}" if folder else base
    below = f"{folder}/" if folder else ""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            entries = os.scandir(at)
        except FileNotFoundError:  # gone meanwhile, or never there
            return
        with entries as found:
            for e in found:
                if e.is_dir():
                    if not e.is_symlink():
                        yield below + e.name, True, 0, 0.0
                elif e.is_file():
                    st = e.stat()
                    yield below + e.name, False, st.st_size, st.st_mtime
        return
    for e in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if e.type == pafs.FileType.Directory:
            yield below + e.base_name, True, 0, 0.0
        elif e.type == pafs.FileType.File:
            yield below + e.base_name, False, e.size, e.mtime_ns / 1e9 if e.mtime_ns else 0.0


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size_bytes, mtime) of every file below ``root``, hidden ones
    too: level by level, a folder a row, so tasks list the folders of a level
    side by side and the driver sees none of their files."""
    levels, folders = [], spark.createDataFrame([("",)], "rel_path string")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("rel_path").to_pylist():
                found = list(children(root, folder))
                for lo in range(0, len(found), 10_000):
                    path, is_dir, size, mtime = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(is_dir), pa.array(size, pa.int64()), pa.array(mtime, pa.float64())], names=["rel_path", "is_dir", "size_bytes", "mtime"])

    n = 1
    while n:
        parts = min(n, max(1, spark.sparkContext.defaultParallelism * 4))
        found = durable(folders.repartition(parts).mapInArrow(look, "rel_path string, is_dir boolean, size_bytes long, mtime double"), "listing")
        levels.append(found.where(~F.col("is_dir")).drop("is_dir"))
        folders = found.where("is_dir").select("rel_path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def contents(root: str) -> Callable[[Column], Column]:
    """A column of files' decoded contents, read by the tasks."""

    @F.pandas_udf(StringType())
    def read(paths: pd.Series) -> pd.Series:
        fs, base = store_of(root)

        def one(path: str) -> str:
            with fs.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                return decode(f.read())

        return paths.map(one)

    return read


def read_store(spark: SparkSession, root: str):
    """The same table of a tree in any store that Spark reads: listed and read
    by Spark, so large trees and remote ones are no matter; like all of its
    readers it passes over names that begin with a dot or an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9+.-]+://[^/]*|^file:", "")
    path = F.expr("substring_index(path, '://', -1)")  # file:/a and store://host/a
    path = F.regexp_replace(F.when(F.contains("path", F.lit("://")), F.regexp_replace(path, "^[^/]*", "")).otherwise(F.col("path")), "^file:", "")
    rel = F.expr("substring(p, length(b) + 2)")
    rows = found.select(path.alias("p"), base.alias("b"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    return rows.select(rel.alias("rel_path"), "size_bytes", "mtime", decoded("content").alias("content"))


@F.pandas_udf(StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode(b))


#: Files that a task reads at once.
SLICE = 256


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree's files, hidden ones too; none at all is an error.  What is
    filtered by path or not asked for is not read.  Trees in stores that only
    Spark knows are read as ``read_store`` does."""
    try:
        store_of(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_store(spark, root)
    files = list_tree(spark, root)
    n = files.count()
    if not n:
        raise FileNotFoundError(f"no files below {root}")
    return files.repartition(-(-n // SLICE), "rel_path").withColumn("content", contents(root)("rel_path"))
