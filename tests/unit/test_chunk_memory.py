"""Chunks and sitemaps pass through Python one by one, and only where they must."""

from pyspark.sql import functions as F

from corpusflow.operators import links, split
from corpusflow.options import PackOptions
from corpusflow.plans.pack import pack
from corpusflow.sources import discovery


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def site(spark, n=300):
    page = "<html><body><article><h1>T{0}</h1><p>see page {1} and more</p><a href='p{1}.html'>see page {1}</a></article></body></html>"
    rows = [(f"h/d{i % 3}/p{i}.html", page.format(i, (i + 3) % n)) for i in range(n)]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    return files.select("rel_path", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(0.0).alias("mtime"), "content")


def test_texts_of_chunks_pass_python_one_chunk_at_a_time(spark):
    """batches of thousands of whole chunks with all marks were one worker's."""
    out = pack(site(spark), PackOptions(max_words_per_chunk=60, cross_refs=True))
    plan = plan_of(out.bodies)
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and "FlatMapGroupsInArrow" in plan
    bodies = {r.chunk_index: r.body for r in out.bodies.collect()}
    plain = {r.chunk_index: r.body for r in pack(site(spark), PackOptions(max_words_per_chunk=60)).bodies.collect()}
    place = {r.rel_path: (r.chunk_index, r.ord) for r in out.chunk_files.collect()}
    marks = {}
    for e in sorted(out.edges.where("target_chunk is not null").collect(), key=lambda e: (place[e.source_path], e.ord)):
        marks.setdefault(place[e.source_path][0], []).append((e.link_text, e.target_chunk))
    assert len(bodies) > 20 and bodies == {c: links.marked(t, marks.get(c, [])) for c, t in plain.items()} != plain


def test_annotated_chunks_without_marks_or_text(spark):
    rows = [(1, "a", "x y x", [("x", "c1"), ("", "c2"), ("y", None)]), (2, "b", None, [("x", "c1")]), (3, "c", "x", None)]
    df = spark.createDataFrame(rows, "chunk_index int, name string, body string, marks array<struct<link_text: string, target_chunk: string>>")
    assert sorted(tuple(r) for r in links.annotate_chunks(df).collect()) == [(1, "a", "x [-> c1] y x"), (2, "b", None), (3, "c", "x")]


def test_headers_keep_texts_out_of_python(spark):
    """only what a header says passes; files are cut a slice at a time."""
    n = 2 * split.SLICE + 5
    out = pack(site(spark, n), PackOptions(max_words_per_chunk=60, context_header=True))
    assert out.parts.count() == n and "MapInArrow" in plan_of(out.parts)
    assert "context-v1" in out.bodies.first().body and plan_of(out.bodies).count("MapInArrow") == plan_of(out.parts).count("MapInArrow")


def test_sitemaps_are_read_once_by_one_worker_a_task(spark):
    """a column function was evaluated for the filter, the kind and the URLs."""
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [(f"http://h/{i}.xml", f"<urlset {ns}><url><loc> http://h/{i} </loc></url><url><loc>http://h/all</loc></url></urlset>") for i in range(3 * discovery.SLICE + 1)]
    rows += [("http://h/broken.xml", "<urlset"), ("http://h/none.xml", None), ("http://h/i.xml", f"<sitemapindex {ns}><sitemap><loc>http://h/0.xml</loc></sitemap></sitemapindex>")]
    maps = spark.createDataFrame(rows, "url string, body string")
    read = discovery.read_sitemaps(maps, "url")
    assert {r.url: (r.root, r.locs) for r in read.collect()} == {u: discovery.sitemap(b) for u, b in rows if discovery.sitemap(b)[0]}
    found = discovery.sitemap_urls(maps.withColumnRenamed("url", "site"))
    assert {r.url for r in found.collect()} == {"http://h/all", *(f"http://h/{i}" for i in range(3 * discovery.SLICE + 1))}
    physical = plan_of(found).split("Initial Plan")[-1]
    assert physical.count("MapInArrow") == 1 and "ArrowEvalPython" not in physical
