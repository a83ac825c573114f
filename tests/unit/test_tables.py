"""Durable tables belong to the call that makes them."""

import os
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from corpusflow.tables import CLEANUP, Scope, durable, fresh_path, owned, shared_dir


def there(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://").removeprefix("file:")))


def test_a_scope_deletes_its_own(spark):
    before = there(spark)
    outside = durable(spark.range(3), "outside")
    with Scope(spark) as own:
        gone, kept = durable(spark.range(5), "gone"), durable(spark.range(7), "kept")
        named = fresh_path(spark, "named")
        spark.range(2).write.parquet(named)
        own.clear(kept)
        assert {x.rsplit("-", 1)[0] for x in there(spark) - before} == {"outside", "kept", "named"}
        own.clear(kept, written=True)
    assert kept.count() == 7 and outside.count() == 3
    assert {x.rsplit("-", 1)[0] for x in there(spark) - before} == {"outside", "kept"}
    with pytest.raises(Exception, match="NOT_EXIST|does not exist"):
        gone.collect()


def test_scopes_nest(spark):
    before = there(spark)

    @owned
    def inner():
        durable(spark.range(4), "step")
        return durable(spark.range(9), "inner")

    with Scope(spark) as own:
        a = inner()
        out = durable(a, "outer")
        own.clear(out)
    assert out.count() == 9 and {x.rsplit("-", 1)[0] for x in there(spark) - before} == {"outer"}


def test_a_failed_call_leaves_nothing(spark):
    before = there(spark)

    @owned
    def fails():
        durable(spark.range(4), "step")
        raise ValueError("no")

    with pytest.raises(ValueError):
        fails()
    assert there(spark) == before


def test_threads_do_not_share_scopes(spark):
    meet = Barrier(2, timeout=120)

    @owned
    def call(n):
        mine = durable(spark.range(n), f"mine{n}")
        meet.wait()  # both have made a table
        out = durable(mine, f"out{n}")
        meet.wait()
        return out

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(call, (5, 6))
    assert (a.count(), b.count()) == (5, 6)


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    kept = spark.conf.get(CLEANUP)
    before = files()
    out = durable(spark.range(1000).repartition(3, "id").groupBy("id").count(), "own")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == kept
    assert out.count() == 1000
