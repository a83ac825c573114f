"""Shared pieces of the training-data operators: durable intermediate tables,
the hash splits of the query contracts, and partition counts that follow the
data."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scope, fresh_path, owned, shared_dir, write_once

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch where rows hold whole texts or sets.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """From now on Arrow batches of at most so many rows, so that a worker
    and the executor hold a few megabytes of text at once, not tens; returns
    the setting as it was."""
    old = spark.conf.get(_BATCH)
    if not 0 < int(old) <= rows:
        spark.conf.set(_BATCH, str(rows))
    return old


def durable(df: DataFrame, name: str, slim: bool = False, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; it
    belongs to the open scope.  Cuts the lineage; survives lost executors.  ``slim`` rows
    (no texts) pass Python in batches of the usual size, others in batches of at
    most ``rows``."""
    spark = df.sparkSession
    path = fresh_path(spark, name, named=False)
    old = spark.conf.get(_BATCH) if slim else small_batches(spark, rows)
    try:
        write_once(df, path)
    finally:
        spark.conf.set(_BATCH, old)
        release()
    return spark.read.schema(df.schema).parquet(path)


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def _part_files(uri: str):
    """The opened Parquet files of a table, one after the other."""
    fs, path = _fs(uri)
    for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet")):
        with fs.open_input_file(f) as opened:
            yield pq.ParquetFile(opened)


def read_table(uri: str) -> pa.Table:
    """A table of the shared folder, read by this process: for workers and
    tables of bounded size."""
    return pa.concat_tables([f.read() for f in _part_files(uri)])


def read_parts(uri: str, kinds: dict[str, str]) -> list[np.ndarray]:
    """Columns without nulls of such a table as arrays, with one file of it
    besides at a time."""
    out = [np.empty(sum(f.metadata.num_rows for f in _part_files(uri)), kind) for kind in kinds.values()]
    at = 0
    for f in _part_files(uri):
        t = f.read(list(kinds))
        for x, name in zip(out, kinds, strict=True):
            x[at : at + len(t)] = t.column(name).to_numpy()
        at += len(t)
    return out


_HELD: dict[str, list] = {}
_OWNER = ""


def holds(owner: str, *clear) -> None:
    """What a module's functions keep in a worker, and how to let go of it."""
    _HELD.setdefault(owner, []).extend(clear)


def turn_to(owner: str) -> None:
    """This worker does ``owner``'s work now: what other modules keep goes, and
    what it took goes back to the system, so that a worker that lives through
    many stages holds one operator's tables at a time."""
    global _OWNER
    if owner == _OWNER:
        return
    _OWNER = owner
    for other, clears in _HELD.items():
        if other != owner:
            for clear in clears:
                clear()
    release()


def release() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)).cast("int")


def crc_mod(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batches: Iterable, rows: int = 512) -> Iterator:
    """Batches in parts, so that few texts are Python objects at once."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def grouped(batches: Iterable, rows: int, column: str = "text", chars: int = 1 << 20) -> Iterator:
    """(texts, rows of them) of batches in parts of at most ``rows`` rows and
    about ``chars`` characters; a longer text is a part of its own."""
    for b in sliced(batches, rows):
        texts = b.column(column).to_pylist()
        lo = held = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > lo and held + n > chars:
                yield texts[lo:i], b.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if texts:
            yield texts[lo:], b.slice(lo)


#: Characters of a key that is worth remembering.
LONG_KEY = 256


class Bounded(dict):
    """A memo that computes what it lacks, and keeps it but for long keys.  It holds two generations of at most
    ``limit`` entries: what is used again moves from the old one to the new."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_KEY:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


__all__ = ["BATCH_ROWS", "LONG_KEY", "WORD", "Bounded", "Scope", "crc_mod", "durable", "fresh_path", "grouped", "holds", "owned", "read_parts", "read_table", "release", "shared_dir", "shuffle_partitions", "sliced", "small_batches", "split_of", "tokenizer_path", "turn_to", "write_once"]
