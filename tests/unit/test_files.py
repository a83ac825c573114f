"""Files of a job: all or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.sinks.files import JOURNAL, STAGING, FilesWriter, Written, recover, replace_file, write_files
from corpusflow.sources.discovery import load_manifest, manifest_json, save_manifest


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_files_are_written_and_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", "one"), ("d/b.txt", "zwei é"), ("empty", None)], "name string, body string").repartition(3)
    got = write_files(rows, out)
    assert {tuple(r) for r in got.collect()} == {("a.txt", 3), ("d/b.txt", 7), ("empty", 0)}
    assert names(out) == ["a.txt", "d/b.txt", "empty"] and (tmp_path / "out/d/b.txt").read_text() == "zwei é"
    (tmp_path / "out/own").write_text("mine")
    write_files(rows.where("name = 'a.txt'").withColumn("body", F.lit("new")), out)
    assert (tmp_path / "out/a.txt").read_text() == "new" and names(out) == ["a.txt", "d/b.txt", "empty", "own"]
    assert write_files(rows.limit(0), out).count() == 0 and len(names(out)) == 4


def test_a_job_that_fails_late_leaves_the_old_output(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(8).select(F.format_string("f%d", "id").alias("name"), F.lit("old").alias("body"))
    write_files(rows, out)
    bad = spark.range(0, 8, 1, 8).select(F.format_string("f%d", "id").alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("last task"))).otherwise(F.lit("new")).alias("body"))
    with pytest.raises(Exception, match="last task"):
        write_files(bad, out)
    assert names(out) == [f"f{i}" for i in range(8)] and all((tmp_path / "out" / f"f{i}").read_text() == "old" for i in range(8))
    for name in ("/etc/x", "../x", ""):
        with pytest.raises(Exception, match="no name"):
            write_files(spark.createDataFrame([(name, "x")], "name string, body string"), out)


def test_a_driver_that_dies_in_between(tmp_path):
    """Everything is staged and told; the next one moves what is left."""
    base = tmp_path / "out"
    stage = base / f"{STAGING}dead" / "t"
    stage.mkdir(parents=True)
    (base / "a").write_text("moved before")
    (stage / "b").write_text("left")
    (base / f"{STAGING}dead" / JOURNAL).write_text("".join(json.dumps([f"{STAGING}dead/t/{n}", n]) + "\n" for n in ("a", "b")))
    running = base / f"{STAGING}running" / "t"
    running.mkdir(parents=True)
    (running / "c").write_text("not done")
    assert recover(str(base)) == 1 and (base / "a").read_text() == "moved before" and (base / "b").read_text() == "left"
    assert (running / "c").exists() and recover(str(base)) == 0


def test_attempts_that_were_not_committed_do_not_count(tmp_path):
    w = FilesWriter(str(tmp_path), None)
    import pyarrow as pa

    def batch(body):
        return iter([pa.record_batch([pa.array(["x"]), pa.array([body])], names=["name", "body"])])

    w.write(batch("lost attempt"))
    w.commit([w.write(batch("kept")), None, Written(f"{w.stage}/none", [])])
    assert names(tmp_path) == ["x"] and (tmp_path / "x").read_text() == "kept"


def test_manifest_is_swapped(spark, tmp_path):
    path = str(tmp_path / "m.json")
    rows = spark.createDataFrame([("b", "u", 2, "e", None, "b", 1.5), ("a é", None, None, None, None, None, None)], "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double")
    save_manifest(rows, path, "http://h/", "now")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    assert text == manifest_json(rows, "http://h/", "now") and list(json.loads(text)["files"]) == ["a é", "b"]
    assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    assert sorted(map(str, load_manifest(spark, path).collect())) == sorted(map(str, rows.select(*load_manifest(spark, path).columns).collect()))
    assert json.loads(manifest_json(rows.limit(0), "", "t")) == {"base_url": "", "last_run": "t", "files": {}}

    def fails():
        yield "half"
        raise ValueError("no")

    with pytest.raises(ValueError):
        replace_file(path, fails())
    with open(path, encoding="utf-8") as f:
        assert f.read() == text
    assert names(tmp_path) == ["m.json"]
