"""Intermediate tables in the folder that driver and executors share, and who
owns them."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only where that is unset and the
    master is local a local folder is made; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpusflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_OPEN: ContextVar[Scope | None] = ContextVar("corpusflow-scope", default=None)


class Scope:
    """Owns the tables that are made while it is open, in its own thread or
    task: what other calls make beside it belongs to them.  A scope within a
    scope hands over what it has not deleted; a call that fails leaves nothing.

    Tables that a returned DataFrame reads are known from its plan.  Folders
    that only functions of workers open by name (``named``) are not, so they
    stay until a scope is told that its result has been written."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scope:
        self._above = _OPEN.get()
        self._token = _OPEN.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _OPEN.reset(self._token)
        if kind is not None:
            self._delete(list(self.paths))
        elif self._above is not None:
            self._above.paths.update(self.paths)

    def clear(self, *keep: DataFrame, written: bool = False) -> None:
        """Delete the tables so far but for those that ``keep`` reads, and, with
        ``written``, the folders that are only known by name."""
        read = {part for df in keep for f in df.inputFiles() for part in f.split("/")}
        self._delete([p for p, named in self.paths.items() if p.rsplit("/", 1)[-1] not in read and (written or not named)])

    def _delete(self, paths: list[str]) -> None:
        spark = self.spark or SparkSession.getActiveSession()
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            del self.paths[path]


def owned(f: Callable) -> Callable:
    """A function that returns a DataFrame, and deletes what its tables hold
    besides what that DataFrame reads."""

    @functools.wraps(f)
    def run(*args, **options):
        with Scope() as own:
            out = f(*args, **options)
            if own.paths:
                own.spark = out.sparkSession
                own.clear(out)
        return out

    return run


def fresh_path(spark: SparkSession, name: str, named: bool = True) -> str:
    """A place in the shared folder that nothing else has; the open scope's."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scope = _OPEN.get()
    if scope is not None:
        scope.paths[path] = named
        scope.spark = scope.spark or spark
    return path


#: Spark's setting by which shuffle files go with the execution that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: dict[SparkSession, tuple[int, str | None]] = {}
_LOCK = Lock()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread of the session writes a table, and
    then as it was."""
    with _LOCK:
        n, old = _WRITING.get(spark, (0, None))
        if not n:
            old = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING[spark] = n + 1, old
    try:
        yield
    finally:
        with _LOCK:
            n, old = _WRITING.pop(spark)
            if n > 1:
                _WRITING[spark] = n - 1, old
            elif old is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, old)


def write_once(df: DataFrame, path: str) -> None:
    """Write a table whose shuffles nobody reads again: their files go at once,
    not when the driver happens to collect garbage.  Each write plans anew, so
    a DataFrame that is written twice makes its shuffles twice either way."""
    with _cleaning(df.sparkSession):
        df.write.parquet(path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name, named=False)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
