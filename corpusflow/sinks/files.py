"""Files under given names, all of a job or none.

Tasks write below a hidden staging folder of the job, each attempt in a folder
of its own; files move to their names only once every task is done.  What is to
be moved is written down first (a journal), so a driver that dies in between
leaves nothing half told: the next write to the folder goes on with it.  A job
that fails, in its last task too, leaves the files that were there.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..tables import fresh_path

SCHEMA = "name string, body string"
STAGING, JOURNAL = ".staging-", "journal"


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a local path or a store's URI."""
    if folder.startswith("file:/") and "://" not in folder:
        folder = folder.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and names and sizes."""

    folder: str
    files: list[tuple[str, int]]


def _safe(name: str) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"no name of a file below the folder: {name!r}")
    return name


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, report: str | None):
        self.folder, self.report = folder.rstrip("/"), report
        self.stage = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = store_of(self.folder)
        own = f"{self.stage}/{uuid.uuid4().hex}"
        files = []
        for b in iterator:
            for name, body in zip(b.column("name").to_pylist(), b.column("body").to_pylist(), strict=True):
                raw = (body or "").encode("utf-8", "replace")
                at = f"{base}/{own}/{_safe(name)}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(raw)
                files.append((name, len(raw)))
        return Written(own, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = store_of(self.folder)
        recover(self.folder)
        fs.create_dir(f"{base}/{self.stage}", recursive=True)
        with fs.open_output_stream(f"{base}/{self.stage}/{JOURNAL}.part") as f:
            for m in messages:
                for name, _ in m.files if m is not None else ():
                    f.write((json.dumps([f"{m.folder}/{name}", name]) + "\n").encode())
        fs.move(f"{base}/{self.stage}/{JOURNAL}.part", f"{base}/{self.stage}/{JOURNAL}")  # from here on it is done
        recover(self.folder)
        if self.report:
            rfs, to = store_of(self.report)
            rfs.create_dir(to, recursive=True)
            with rfs.open_output_stream(f"{to}/files.json") as f:
                for m in messages:
                    for name, size in m.files if m is not None else ():
                        f.write((json.dumps({"name": name, "bytes": size}) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = store_of(self.folder)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{base}/{self.stage}")


def recover(folder: str) -> int:
    """Finish what jobs that were done have not moved yet; how many there were.
    A staging folder without journal is a job's that still runs, or died."""
    fs, base = store_of(folder)
    n = 0
    for d in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if not d.base_name.startswith(STAGING) or fs.get_file_info(f"{d.path}/{JOURNAL}").type == pafs.FileType.NotFound:
            continue
        n += 1
        with fs.open_input_stream(f"{d.path}/{JOURNAL}") as f:
            lines = f.read().decode().splitlines()
        for line in lines:
            source, name = json.loads(line)
            if fs.get_file_info(f"{base}/{source}").type == pafs.FileType.NotFound:
                continue  # moved before
            if "/" in name:
                fs.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
            fs.move(f"{base}/{source}", f"{base}/{name}")
        fs.delete_dir(d.path)
    return n


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("report"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, body) rows as files of ``folder``, over those of the same
    names; returns (name, bytes).  Other files stay.  A null body is an empty
    file; of rows of one name one wins."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FilesSink)
    report = fresh_path(spark, "written", named=False)
    rows.select(F.col("name").cast("string").alias("name"), F.col("body").cast("string").alias("body")).write.format("committed_files").mode("append").option("path", folder).option("report", report).save()
    return spark.read.schema("name string, bytes long").json(report)


def replace_file(path: str, lines: Iterator[str]) -> None:
    """A file as a whole: written beside, then moved over the old one."""
    fs, at = store_of(path)
    part = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as f:
            for line in lines:
                f.write(line.encode("utf-8", "replace"))
        fs.move(part, at)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            fs.delete_file(part)
        raise
