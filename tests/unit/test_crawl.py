"""Fetching as a plan: rounds, resuming, validators, hosts, commands."""

import gzip
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

import corpusflow.__main__ as command
from corpusflow.plans.crawl import CrawlOptions, Rounds, crawl, polite
from corpusflow.plans.download import as_files, discover, download, manifest_of
from corpusflow.sources.fetch import Response, by_host, from_table, http_get

S = "http://s.example"
SITE = {
    f"{S}/": '<a href="/a/">a</a><a href="b.html#x">b</a><a href="http://other.example/">o</a>',
    f"{S}/a/": '<a href="../b.html">b</a><a href="c">c</a><a href="mailto:x@y">m</a>',
    f"{S}/b.html": '<a href="/">home</a><a href="gone.html">g</a>',
    f"{S}/a/c": '<a href="d.pdf">d</a><a href="e.html?q=1">e</a>',
    f"{S}/a/e.html?q=1": "<p>end</p>",
    "http://other.example/": '<a href="/never">n</a>',
}


def table(spark, pages=SITE, **more):
    rows = [(u, b, f'"{hash(b) % 1000}"' if more.get("etag") else None, more.get("last")) for u, b in pages.items()]
    return spark.createDataFrame(rows, "url string, body string, etag string, last_modified string")


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def plain(pages, start, depth=0):
    """url -> (depth, status), a queue at a time."""
    from urllib.parse import urljoin, urlsplit

    from corpusflow.functions.html import anchors_of, tape_of

    found, queue = {}, [(u, 0) for u in start]
    while queue:
        u, d = queue.pop(0)
        if u in found or (depth and d > depth):
            continue
        found[u] = (d, 200 if u in pages else 404)
        for href, _ in anchors_of(tape_of(pages.get(u, ""))):
            v = urljoin(u, href).partition("#")[0]
            if urlsplit(v).netloc == urlsplit(u).netloc and urlsplit(v).scheme in ("http", "https"):
                queue.append((v, d + 1))
    return found


def told(pages):
    return {r.url: (r.depth, r.status) for r in pages.collect()}


@pytest.mark.parametrize("depth,per_host", [(0, 1000), (0, 1), (1, 2), (2, 1)])
def test_crawl_is_a_search_by_steps(spark, depth, per_host):
    got = crawl(seeds(spark, f"{S}/", f"{S}/#top", None, "http://other.example/"), from_table(table(spark)), options=CrawlOptions(depth=depth, per_host=per_host))
    assert told(got) == plain(SITE, [f"{S}/", "http://other.example/"], depth)
    where = {r.url: r.local_path for r in got.collect()}
    assert where[f"{S}/"] == "s.example/index.html" and where.get(f"{S}/a/c", "s.example/a/c.html") == "s.example/a/c.html"


def test_a_table_gives_a_step_a_round(spark, tmp_path):
    """No host is visited, so a step is not cut into rounds of a host's URLs."""
    pages = {f"{S}/": "".join(f'<a href="/p{i}.html">p</a>' for i in range(50)), **{f"{S}/p{i}.html": "" for i in range(50)}}
    base = str(tmp_path / "crawl")
    got = crawl(seeds(spark, f"{S}/"), from_table(table(spark, pages)), base, CrawlOptions(per_host=3))
    assert told(got) == plain(pages, [f"{S}/"]) and Rounds(spark, base).done() == 2


def test_a_list_is_not_followed(spark):
    got = crawl(seeds(spark, f"{S}/", f"{S}/nowhere"), from_table(table(spark)), options=CrawlOptions(follow=False))
    assert told(got) == {f"{S}/": (0, 200), f"{S}/nowhere": (0, 404)}
    only = crawl(seeds(spark, f"{S}/a/c"), from_table(table(spark)), options=CrawlOptions(include=("pdf",)))
    assert set(told(only)) == {f"{S}/a/c", f"{S}/a/d.pdf"}
    assert crawl(seeds(spark), from_table(table(spark))).count() == 0


def test_a_killed_crawl_goes_on(spark, tmp_path):
    """It stops in the middle of a round, half written; what was fetched is not
    fetched again, and the end is the same."""
    base, asked = str(tmp_path / "crawl"), []
    inner = from_table(table(spark))

    def fetch(frontier):
        asked.extend(r.url for r in frontier.select("url").collect())
        if len(asked) == 3:
            raise RuntimeError("killed")
        return inner(frontier)

    options = CrawlOptions(per_host=1)
    with pytest.raises(RuntimeError, match="killed"):
        crawl(seeds(spark, f"{S}/"), fetch, base, options)
    rounds = Rounds(spark, base)
    assert rounds.done() == 2
    spark.createDataFrame([("http://half/", 9)], "url string, depth int").write.parquet(rounds.path(2, "pages"))  # half a round
    part = crawl(seeds(spark, f"{S}/"), fetch, base, CrawlOptions(per_host=1, max_rounds=1))
    assert part.count() == 3
    got = crawl(seeds(spark, f"{S}/"), fetch, base, options)
    assert told(got) == plain(SITE, [f"{S}/"])
    assert max(Counter(asked).values()) == 2 and sum(v == 2 for v in Counter(asked).values()) == 1
    assert told(crawl(seeds(spark, f"{S}/"), fetch, base, options)) == told(got)  # a crawl that is done stays so


def test_what_has_not_changed_is_kept(spark):
    old = crawl(seeds(spark, f"{S}/"), from_table(table(spark, etag=True))).drop("local_path")
    site = {**SITE, f"{S}/b.html": '<a href="new.html">n</a>', f"{S}/new.html": "new"}
    sent = []
    inner = from_table(table(spark, site, etag=True))

    def fetch(frontier):
        sent.extend((r.url, r.etag) for r in frontier.collect())
        return inner(frontier)

    got = {r.url: r for r in crawl(seeds(spark, f"{S}/"), fetch, previous=old).collect()}
    assert set(got) == set(plain(site, [f"{S}/"]))
    same = {u for u, r in got.items() if r.unchanged}
    assert same == {u for u in SITE if u in got and site[u] == SITE[u]} and all(got[u].status == 304 and got[u].body == SITE[u] and got[u].etag for u in same)
    assert got[f"{S}/b.html"].status == 200 and got[f"{S}/new.html"].body == "new" and dict(sent)[f"{S}/a/"] is not None
    # what is trusted is not asked for at all
    sent.clear()
    trusted = crawl(seeds(spark, f"{S}/"), fetch, options=CrawlOptions(trust=True), previous=old.where("body is not null"))
    assert {u for u, _ in sent} == {f"{S}/gone.html", f"{S}/a/d.pdf"} and trusted.count() == len(plain(SITE, [f"{S}/"]))


def test_times_are_validators_too(spark):
    last = "Mon, 01 Jan 2024 00:00:00 GMT"
    old = crawl(seeds(spark, f"{S}/"), from_table(table(spark, last=last)))
    again = crawl(seeds(spark, f"{S}/"), from_table(table(spark, last=last)), previous=old)
    assert {r.status for r in again.collect()} == {304, 404}
    files = {r.rel_path: r for r in as_files(again).collect()}
    assert files["s.example/index.html"].mtime == 1704067200.0 and files["s.example/index.html"].content == SITE[f"{S}/"]
    entry = manifest_of(again).where("key = 'a/index.html'").first()
    assert (entry.url, entry.last_modified, entry.local_path) == (f"{S}/a/", last, "s.example/a/index.html")


def test_hot_hosts_take_more_rounds(spark):
    rows = [(f"http://h{i % 3}/{i:03d}", 0) for i in range(90)]
    got = polite(spark.createDataFrame(rows, "url string, depth int"), 7)
    assert sorted(got.toPandas()["url"]) == sorted(u for h in range(3) for u in sorted(x for x, _ in rows if x.startswith(f"http://h{h}/"))[:7])


def test_by_host_waits_and_tries_again(spark):
    def get(url, etag=None, last=None):
        if "down" in url:
            raise OSError("no answer")
        if "busy" in url:
            return Response(503)
        return Response(200, gzip.compress(b"caf\xc3\xa9\r\n") if "gz" in url else b"\xff\n", None, "x")

    slept = []

    def sleep(s):
        slept.append(s)

    urls = ["http://a/1", "http://a/gz", "http://b/down", "http://b/busy", "http://c/1"]
    asked = seeds(spark, *urls).select("url", F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    got = {r.url: r for r in by_host(get, sleep=lambda s: None)(asked).collect()}
    assert got["http://a/gz"].body == "café\n" and got["http://a/1"].body == "�\n" and got["http://a/1"].etag == "e"
    assert got["http://b/down"].status is None and "no answer" in got["http://b/down"].error
    assert got["http://b/busy"].status == 503 and got["http://b/busy"].body is None
    began = time.time()
    assert by_host(get, delay=0.3)(asked.where("url like 'http://a/%'")).count() == 2
    assert time.time() - began >= 0.3


class Site(BaseHTTPRequestHandler):
    pages = {"/": '<a href="/one.html">1</a>', "/one.html": "<p>" + "word " * 60 + '</p><a href="two">2</a>', "/two": "<p>two</p>"}
    seen: Counter = Counter()

    def do_GET(self):
        type(self).seen[self.path] += 1
        body = self.pages.get(self.path)
        if body is None:
            return self.send_error(404)
        tag = f'"{len(body)}"'
        if self.headers.get("If-None-Match") == tag:
            self.send_response(304)
            self.end_headers()
            return
        self.send_response(200)
        self.send_header("ETag", tag)
        self.send_header("Last-Modified", "Mon, 01 Jan 2024 00:00:00 GMT")
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), type("Mine", (Site,), {"pages": dict(Site.pages), "seen": Counter()}))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def test_http_get(server):
    root = f"http://127.0.0.1:{server.server_port}"
    r = http_get(f"{root}/two")
    assert (r.status, r.body, r.etag) == (200, b"<p>two</p>", '"10"')
    assert http_get(f"{root}/two", etag='"10"').status == 304 and http_get(f"{root}/none").status == 404
    with pytest.raises(OSError):
        http_get("http://127.0.0.1:9/", timeout=2)


def test_layers(spark):
    many = [f"{S}/docs/{i}" for i in range(4)]
    pages = dict(SITE)
    assert discover(spark, f"{S}/", from_table(table(spark, pages)))[0] == "links"
    pages[f"{S}/sitemap.xml"] = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>' + f"{S}/m.xml</loc></sitemap><sitemap><loc>{S}/none.xml</loc></sitemap></sitemapindex>"
    pages[f"{S}/m.xml"] = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{u}</loc></url>" for u in many) + "</urlset>"
    layer, urls = discover(spark, f"{S}/", from_table(table(spark, pages)))
    assert layer == "sitemap" and sorted(r.url for r in urls.collect()) == many
    pages[f"{S}/llms.txt"] = "\n".join(f"- [x]({u})" for u in many[:2])
    assert discover(spark, f"{S}/", from_table(table(spark, pages)))[0] == "sitemap"  # too few
    pages[f"{S}/llms.txt"] = "\n".join(f"- [x]({u})" for u in many)
    assert discover(spark, f"{S}/", from_table(table(spark, pages)))[0] == "llms"
    done = download(spark, f"{S}/", from_table(table(spark, pages | {many[0]: "one"})))
    assert done.layer == "llms" and told(done.pages) == {u: (0, 200 if u == many[0] else 404) for u in many}
    assert done.summary["downloaded"] == 1 and done.summary["failed"] == 3


def test_shells_are_rendered(spark):
    shell = '<html><body><div id="root"></div></body></html>'
    pages = {f"{S}/": shell}
    real = {f"{S}/": '<body><p>text</p><a href="/x.html">x</a></body>', f"{S}/x.html": "<body><p>more</p></body>"}
    done = download(spark, f"{S}/", from_table(table(spark, pages)), render=from_table(table(spark, real)))
    assert done.rendered and set(told(done.pages)) == set(real)
    assert not download(spark, f"{S}/", from_table(table(spark, pages))).rendered


def test_download_and_sync_a_site(spark, server, tmp_path, capsys):
    """The commands against a server: fetched, packed, fetched again."""
    root = f"http://127.0.0.1:{server.server_port}"
    host, out, manifest = f"127.0.0.1:{server.server_port}", tmp_path / "mirror", tmp_path / "m.json"
    assert command.main(["-q", "download", f"{root}/", "-o", str(out), "--manifest", str(manifest)], spark) == 0
    assert (out / host / "one.html").read_text() == Site.pages["/one.html"] and (out / host / "two.html").exists()
    kept = json.loads(manifest.read_text())
    assert set(kept["files"]) == {"index.html", "one.html", "two.html"} and kept["files"]["two.html"]["etag"] == '"10"'
    manifest.unlink()
    assert command.main(["-q", "sync", f"{root}/", "-o", str(out), "--manifest", str(manifest)], spark) == 0
    assert any(out.joinpath("chunks").glob("docs_chunk_*")) and "skipped: 3" in capsys.readouterr().out
    server.RequestHandlerClass.pages["/two"] = "<p>two, longer</p>"
    assert command.main(["-q", "sync", f"{root}/", "-o", str(out), "--manifest", str(manifest)], spark) == 0
    changed = json.loads((out / "chunks" / "delta_manifest.json").read_text())
    assert [x.endswith("two.html") for x in changed["modified"]] == [True] and not changed["removed"] and not changed["added"]
