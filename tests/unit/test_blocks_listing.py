"""Adjacency in blocks, trees listed by tasks, deep sitemaps."""

import json
import os

import pytest

from corpusflow.operators import links
from corpusflow.sinks import render
from corpusflow.sources import discovery
from corpusflow.sources.doctree import list_tree, read_tree

EDGES = "source_path string, ord int, target_path string, anchor string, link_text string, source_chunk string, target_chunk string"


def edges(spark):
    """A hub that a third of all links lead to, a chunk that names itself, one
    without resolved links."""
    rows = []
    for i in range(120):
        rows.append((f"p{i:03d}", 0, "hub.html" if i % 3 == 0 else f"p{(7 * i) % 120:03d}", "#x" if i % 2 else "", f"é {i}", f"c{i // 4:02d}", "c00" if i % 3 == 0 else f"c{(7 * i) % 120 // 4:02d}"))
        rows.append((f"p{i:03d}", 1, "gone", "", "g", f"c{i // 4:02d}", None))
    rows.append(("z", 0, "gone", "", "g", "c99", None))
    return spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize("most", [3, 10_000])
def test_adjacency_in_blocks(spark, most):
    e = edges(spark)
    whole = {r.chunk_id: r for r in links.adjacency(e).collect()}
    blocks = links.adjacency_blocks(e.repartition(3), most).orderBy("kind", "chunk_id", "block").collect()
    assert max(len(b.entries) for b in blocks) <= most
    got = {}
    for b in blocks:
        got.setdefault((b.kind, b.chunk_id), []).extend(b.entries)
    assert {c: [x.other for x in got[k, c]] for k, c in got if k == "to"} == {c: r.references_to for c, r in whole.items() if r.references_to}
    assert {c: [x.other for x in got[k, c]] for k, c in got if k == "by"} == {c: r.referenced_by for c, r in whole.items() if r.referenced_by}
    assert {c: [(x.source_path, x.ord, x.other, x.link_text) for x in got[k, c]] for k, c in got if k == "link"} == {c: [(x.source_path, x.ord, x.target_chunk, x.link_text) for x in r.links] for c, r in whole.items() if r.links}
    if most == 3:
        assert sum(b.kind == "by" and b.chunk_id == "c00" for b in blocks) > 5


@pytest.mark.parametrize("most", [2, 10_000])
def test_json_of_blocks(spark, most):
    for e in (edges(spark), edges(spark).where("target_chunk is null"), edges(spark).where("target_chunk is not null"), edges(spark).limit(0)):
        text = "".join(render.cross_refs_lines(e, most))
        want = render.cross_refs_json(links.adjacency(e), links.unresolved(e))
        assert json.loads(text) == json.loads(want) and list(json.loads(text)) == list(json.loads(want)) and text == want


def test_a_tree_is_listed_by_tasks(spark, tmp_path):
    paths = ["a.txt", ".hidden", "_under/x.md", "d/.git/config", "d/e/f/g.html", "d/ü é.txt", "z/file.gz"]
    for i, p in enumerate(paths):
        at = tmp_path / "t" / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * i + "\r\n")
    (tmp_path / "t" / "nothing" / "here").mkdir(parents=True)
    os.symlink(tmp_path / "t", tmp_path / "t" / "d" / "loop")
    os.symlink(tmp_path / "t" / "a.txt", tmp_path / "t" / "link.txt")
    os.symlink(tmp_path / "none", tmp_path / "t" / "broken")
    want = {p: i + 2 for i, p in enumerate(paths)} | {"link.txt": 2}
    for root in (str(tmp_path / "t"), f"file://{tmp_path}/t", f"{tmp_path}/t/"):
        got = {r.rel_path: r for r in list_tree(spark, root).collect()}
        assert {p: r.size_bytes for p, r in got.items()} == want
        assert got["a.txt"].mtime == pytest.approx((tmp_path / "t" / "a.txt").stat().st_mtime)
    files = read_tree(spark, str(tmp_path / "t"))
    assert {r.rel_path: r.content for r in files.collect()} == {p: "x" * (n - 2) + "\n" for p, n in want.items()}
    (tmp_path / "t" / "a.txt").unlink()  # listed, but not read where it is not asked for
    assert files.where("rel_path not in ('a.txt', 'link.txt')").select("content").count() == len(want) - 2
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tmp_path / "t" / "nothing"))


def test_deep_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [(f"http://h/{i}.xml", f"<sitemapindex {ns}><sitemap><loc>http://h/{i + 1}.xml</loc></sitemap><sitemap><loc>http://h/u{i}.xml</loc></sitemap><sitemap><loc>http://h/0.xml</loc></sitemap></sitemapindex>") for i in range(30)]
    maps += [(f"http://h/u{i}.xml", f"<urlset {ns}><url><loc>http://h/page{i}</loc></url></urlset>") for i in range(30)]
    maps = spark.createDataFrame(maps, "url string, body string")
    for depth in (0, 3, 14):
        assert {r.url for r in discovery.walk_sitemaps(maps, "http://h/0.xml", "http://h/", depth).collect()} == {f"http://h/page{i}" for i in range(depth)}
