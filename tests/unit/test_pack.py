import json

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import delta
from corpusflow.options import PackOptions
from corpusflow.plans.pack import dry_run_report, pack, write
from corpusflow.sinks import render
from corpusflow.sources.doctree import read_tree
from corpusflow.streaming.incremental import delta_batches, unique_blocks

PAGE = "<html><body><nav>menu</nav><main><h1>Title</h1><p>{}</p><h2>Part</h2><p>{}</p><a href='b.html'>see b</a> <a href='gone.html'>lost</a></main></body></html>"


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "in/_static").mkdir(parents=True)
    files = {"a.html": PAGE.format("one " * 30, "two " * 30), "b.html": PAGE.format("three " * 30, "four " * 30), "c.md": "plain words\r\nhere", ".hidden.md": "dot file", "_static/d.txt": "under score", "e.png": "binary"}
    for n, t in files.items():
        (tmp_path / "in" / n).write_bytes(t.encode())
    (tmp_path / "in/f.md").write_bytes(b"bad \xff byte")
    return tmp_path


def test_tree(spark, tree):
    got = {r.rel_path: r.content for r in read_tree(spark, str(tree / "in")).collect()}
    assert set(got) == {"a.html", "b.html", "c.md", ".hidden.md", "_static/d.txt", "e.png", "f.md"}
    assert got["c.md"] == "plain words\nhere" and got["f.md"] == "bad � byte"
    (tree / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tree / "empty"))


def written(packed, folder):
    write(packed, str(folder)).collect()
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_markdown(spark, tree):
    packed = pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=70))
    files = written(packed, tree / "out")
    assert sorted(files) == ["docs_chunk_01.md", "docs_chunk_02.md", "docs_chunk_03.md"]
    one = files["docs_chunk_01.md"]
    assert one.startswith("# Chunk 01 of 03\n\n## Files in this chunk (3 files, ~69 words):\n- .hidden.md (2 words)\n- _static/d.txt (2 words)\n- a.html (65 words)\n\n---\n\n<!-- SOURCE: .hidden.md -->\n\ndot file\n\n<!-- SOURCE: _static/d.txt -->\n\nunder score")
    assert "menu" not in one and one.endswith("see b lost")
    again = written(pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=70)), tree / "again")
    assert again == files


def test_text_and_lines(spark, tree):
    files = written(pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=500, format="txt")), tree / "txt")
    assert files["docs_chunk_01.txt"].startswith("Chunk 01 of 01\nFiles in this chunk (6 files, ~") and "=== SOURCE: c.md ===\n\nplain words\nhere" in files["docs_chunk_01.txt"]
    packed = pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=40, format="jsonl", context_header=True, score=True))
    lines = [json.loads(x) for t in written(packed, tree / "jsonl").values() for x in t.splitlines()]
    parts = sorted((x for x in lines if x["source"] == "a.html"), key=lambda x: x["chunk_index"])
    assert [p["breadcrumb"] for p in parts] == [["Title"], ["Title", "Part"]] and parts[0]["id"].endswith("_1_a.html") and parts[0]["total_chunks"] == 2
    assert all(p["schema_version"] == "v1" and p["readiness_grade"] in "ABC" for p in parts)
    plain = next(x for x in lines if x["source"] == "c.md")
    assert set(plain) == {"id", "source", "words", "content", "schema_version"}


def test_context_headers(spark, tree):
    packed = pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=400, context_header=True))
    body = next(iter(written(packed, tree / "ctx").values()))
    header = json.loads(body.split("<!-- context-v1\n")[1].split("\n-->")[0])
    assert list(header) == ["source", "word_count", "context_breadcrumb", "schema_version"] and header["context_breadcrumb"] == ["Title"]
    empty = {"rel_path": "", "url": None, "sub_total": 1, "sub_ord": 1, "words": 0, "breadcrumb": [], "readiness": None}
    assert render.context_header(empty) == ""


def test_cross_references(spark, tree):
    packed = pack(read_tree(spark, str(tree / "in")), PackOptions(max_words_per_chunk=70, cross_refs=True, score=True, show_tokens=True))
    assert packed.adjacency.count() == 2
    assert packed.edges.where(F.col("target_chunk").isNull()).count() == 2
    bodies = "".join(r.body for r in packed.bodies.collect())
    assert bodies.count("see b [-> docs_chunk_02]") >= 1
    refs = json.loads(render.cross_refs_json(packed.adjacency, packed.edges.where("target_chunk is null")))
    assert len(refs["unresolved"]) == 2
    assert json.loads(render.readiness_json(packed.scores))["summary"]["total_chunks"] == 3
    assert packed.tokens.where("tokens > 0").count() == 3
    guide = render.import_guide(packed.totals, packed.chunk_files, packed.docs)
    assert "| 2 | docs_chunk_02.md |" in guide and "Title" in guide


def test_dedup_delta_and_dry_run(spark, tree):
    files = read_tree(spark, str(tree / "in"))
    packed = pack(files, PackOptions(dedup="both", strategy="semantic", bundle="notebooklm", dry_run=True, score=True))
    assert packed.bodies is None and packed.totals.count() == 6
    text = dry_run_report(packed, 7)
    assert "1 excluded, 6 processed" in text and "semantic" in text
    with pytest.raises(ValueError):
        write(packed, str(tree / "x"))
    old = delta.build_manifest(files.where("rel_path <> 'c.md'"))
    changed = pack(files, PackOptions(delta=True), manifest=old)
    assert [r.rel_path for r in changed.chunk_files.collect()] == ["c.md"]
    made = json.loads(render.delta_json(changed.diff, changed.chunk_files, "now"))
    assert made["added"] == ["c.md"] and made["chunks_generated"] == [{"chunk": "docs_chunk_01", "files": ["c.md"]}]


def test_streams(spark, tmp_path):
    long_ = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    rows = [("a", f"{long_}\n\nshort"), ("b", f"{long_.upper()}\n\nshort"), ("c", "other " * 12)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "rel_path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema("rel_path string, text string").parquet(str(tmp_path / "src"))
    q = unique_blocks(stream).writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("uniq").collect()
    assert len(got) == 4 and sum(r.words >= 10 for r in got) == 2
    state = {"m": spark.createDataFrame([], "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double")}
    seen = []
    run = delta_batches(lambda: state["m"], lambda f, c: seen.append(sorted(r.rel_path for r in f.collect())), lambda m: state.update(m=spark.createDataFrame(m.collect(), m.schema)))
    files = "rel_path string, size_bytes long, mtime double"
    run(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], files), 0)
    run(spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], files), 1)
    run(spark.createDataFrame([("a", 1, 1.0)], files), 2)
    assert seen == [["a", "b"], ["b"]] and state["m"].count() == 2
