"""Input that is broken, trees in stores, and the plans around packing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow import __main__ as command
from corpusflow.functions.html import parse_pages, register
from corpusflow.operators import dedup
from corpusflow.options import PackOptions
from corpusflow.plans.pack import document_table
from corpusflow.plans.sync import sync
from corpusflow.sources import crawl, discovery
from corpusflow.sources.doctree import read_store, read_tree

BROKEN = ["<p>one</p><![foo[x]]><p>two</p>", "<![ a b>", "<p>x<!DOCTYPE [<!ELEMENT", "<a href='", "<" * 500, "&#xFFFFFFFF; &#99999999999;", "\x00<p\x00>z"]


def test_a_broken_page_fails_alone(spark):
    rows = [(f"a/{i}.html", t) for i, t in enumerate([*BROKEN, "<article><h1>T</h1><p>fine text</p></article>", None])]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    got = {r.rel_path: r for r in parse_pages(files).collect()}
    assert len(got) == len(rows) and got["a/1.html"].failed and got["a/1.html"].text == "" and got["a/1.html"].raw_words == 0
    assert not got["a/7.html"].failed and got["a/7.html"].text == "T\n\nfine text" and not got["a/8.html"].failed
    assert document_table(files).count() == len(rows)
    register(spark)
    files.createOrReplaceTempView("broken")
    assert {r.s for r in spark.sql("SELECT strip_html(content) AS s FROM broken WHERE rel_path = 'a/1.html'").collect()} == {""}


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_broken_sitemaps_have_no_urls(spark):
    good = f"<urlset {NS}><url><loc> http://h/a </loc></url><url><loc/></url><url/></urlset>"
    bodies = [("good", good), ("cut", good[:40]), ("empty", ""), ("none", None), ("page", "<html><body>x<br></body></html>"), ("bare", "<urlset><url><loc>http://h/b</loc></url></urlset>"), ("text", "urlset <urlset")]
    df = spark.createDataFrame(bodies, "site string, body string")
    assert [(r.site, r.url) for r in discovery.sitemap_urls(df).collect()] == [("good", "http://h/a")]
    maps = [("http://h/i.xml", f"<sitemapindex {NS}><sitemap><loc>http://h/cut.xml</loc></sitemap><sitemap><loc>http://h/good.xml</loc></sitemap></sitemapindex>"), ("http://h/cut.xml", "<urlset"), ("http://h/good.xml", good)]
    walked = discovery.walk_sitemaps(spark.createDataFrame(maps, "url string, body string"), "http://h/i.xml", "http://h/")
    assert [r.url for r in walked.collect()] == ["http://h/a"]


@pytest.mark.parametrize(
    "url,path",
    [("http://h", "h/index.html"), ("http://h/", "h/index.html"), ("http://h/a/", "h/a/index.html"), ("http://h/a.md", "h/a.md"), ("http://h/a", "h/a.html"), ("http://h/a.png?x=1", "h/a.png.html"), ("https://h:8/a/b.html#c", "h:8/a/b.html")],
)
def test_local_path(spark, url, path):
    assert spark.createDataFrame([(url,)], "u string").select(crawl.local_path(F.col("u"))).first()[0] == path


def test_frontier(spark):
    html = '<a href="/b#x">b</a><a href="c/../d">d</a><a href="http://other/e">e</a><a href="mailto:x@h">m</a><a href="b">again</a><a>n</a><a href="http://[bad">z</a><a href="//h/b?q=1">q</a>'
    fetched = spark.createDataFrame([("http://h/a", 0, html), ("http://h/z", 1, '<a href="/d">d</a>'), ("http://h/y", 0, "<![ a b>"), ("http://h/x", 0, None)], "url string, depth int, html string")
    got = {(r.url, r.depth) for r in crawl.next_frontier(fetched, fetched).collect()}
    assert got == {("http://h/b", 1), ("http://h/d", 1), ("http://h/b?q=1", 1)}
    visited = spark.createDataFrame([("http://h/b",), ("http://h/b",)], "url string")
    assert {r.url for r in crawl.next_frontier(fetched, visited, 1).collect()} == {"http://h/d", "http://h/b?q=1"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "b").mkdir(parents=True)
    (root / "a.html").write_text("<main><h1>A</h1><p>one two three</p></main>")
    (root / "b" / "c.txt").write_bytes(b"four\r\nfive\xff")
    return root


def test_a_store_gives_the_same_rows(spark, tree):
    rows = lambda df: sorted((r.rel_path, r.size_bytes, round(r.mtime, 2), r.content) for r in df.collect())
    assert rows(read_store(spark, f"file://{tree}")) == rows(read_tree(spark, str(tree))) == rows(read_store(spark, f"{tree}/"))


def test_sync_packs_what_changed(spark, tree):
    first = sync(read_tree(spark, str(tree)), PackOptions(), base_url="http://h/")
    assert (first.touched, first.unchanged) == (2, 0) and first.packed.chunk_files.count() == 2
    (tree / "b" / "d.md").write_text("new text")
    (tree / "a.html").unlink()
    second = sync(read_tree(spark, str(tree)), PackOptions(), first.manifest, "http://h/")
    assert (second.touched, second.unchanged) == (1, 1)
    assert [r.rel_path for r in second.packed.chunk_files.collect()] == ["b/d.md"]
    assert {r.key for r in second.manifest.collect()} == {"b/c.txt", "b/d.md"}
    assert second.summary == {"files": 2, "downloaded": 1, "skipped": 1, "megabytes": 0.0}


def test_commands(spark, tree, tmp_path, capsys):
    out = tmp_path / "out"
    assert command.main(["pack", str(tree), "-o", str(out), "--score", "--cross-refs", "--bundle", "notebooklm"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["files"] == 2
    assert {"docs_chunk_01.md", "docs_chunk_02.md", "llm-readiness.json", "cross_refs.json", "IMPORT_GUIDE.md"} == {p.name for p in out.iterdir() if not p.name.startswith(".")}
    assert command.main(["pack", str(tree), "-o", str(out), "--dry-run"], spark) == 0 and "Dry run" in capsys.readouterr().out
    manifest = tmp_path / "m.json"
    assert command.main(["-v", "sync", str(tree), "-o", str(out), "--manifest", str(manifest), "--base-url", "http://h/"], spark) == 0
    kept = json.loads(manifest.read_text())
    assert set(kept["files"]) == {"a.html", "b/c.txt"} and kept["last_run"].endswith("Z") and kept["last_run"][10] == "T"
    delta_ = json.loads((out / "delta_manifest.json").read_text())
    assert delta_["added"] == ["a.html", "b/c.txt"] and delta_["timestamp"].endswith("+00:00") and len(delta_["chunks_generated"]) == 1
    capsys.readouterr()
    assert command.main(["-q", "pack", str(tree), "-o", str(out), "--show-tokens", "--token-encoding", "word_bpe_49k"], spark) == 0
    assert "tokens" in capsys.readouterr().out
    assert command.main(["sync", str(tree), "-o", str(out), "--manifest", str(manifest)], spark) == 0
    assert command.main(["pack", str(tmp_path / "nothing"), "-o", str(out)], spark) == 1


def test_distances(spark):
    h = spark.createDataFrame([(0,), (1,), (-1,), (2**62,), (0x00FF_00FF_00FF_00FF,)], "simhash long")
    values = [r.simhash for r in h.collect()]
    for k in (0, 2, 16, 33, 63):
        want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= k}
        assert {tuple(r) for r in dedup.near_pairs(h, k).collect()} == want
    with pytest.raises(ValueError):
        dedup.near_pairs(h, 64)


@pytest.mark.parametrize("few", [0, 5, 10**6])
def test_the_first_of_each_neighbourhood_stays(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW_EDGES", few)
    r = random.Random(few)
    edges = [(i, i + 1) for i in range(12)] + [tuple(sorted(r.sample(range(20, 60), 2))) for _ in range(70)]
    gone = set()
    for b in range(60):
        if any(a not in gone for a, x in edges if x == b):
            gone.add(b)
    nodes = spark.range(60).select("id", F.col("id").alias("place"))
    assert {x.id for x in dedup.first_independent(nodes, spark.createDataFrame(edges, "a long, b long")).collect()} == gone
