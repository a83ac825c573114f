import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.html import parse_pages, register
from corpusflow.operators import dedup, delta, filters, folds, links, report, score, split, tokens
from corpusflow.options import PackOptions, load_options
from corpusflow.sources import discovery, spa


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


SPACES = "a b c\x1cd\x85e　f g\th\n​i"


@pytest.mark.parametrize("t", [None, "", " ", "one", SPACES, "﻿x y", "a" * 10])
def test_words_are_pythons(spark, t):
    assert column(spark, t, T.word_count) == len((t or "").split())
    if t is not None:
        assert column(spark, t, T.words) == t.split()
        assert column(spark, t, T.trimmed) == t.strip()


@pytest.mark.parametrize("p,s", [("a/b.PNG", ".png"), ("a/.hidden", ""), ("a.b/c", ""), ("x.tar.gz", ".gz"), ("..x", ""), ("a/b.", "."), ("n", "")])
def test_suffix(spark, p, s):
    assert column(spark, p, T.suffix) == s


def apart(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def simhash(t):
    w = t.split()
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [t]
    h = [int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") for g in grams]
    v = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("t", ["", "one", "one two", "a b c", "the quick brown fox jumps over it " * 9, "é ü 言葉 x y"])
def test_simhash(spark, t):
    assert column(spark, t, T.simhash64) == simhash(t)
    df = spark.createDataFrame([(1, t)], "k int, t string")
    assert dedup.simhash(df, "k", "t").first()["simhash"] == simhash(t)


@pytest.mark.parametrize("k", [0, 1, 3, 5, 20])
def test_near_pairs_are_all_pairs(spark, k):
    r = random.Random(k)
    h = [r.getrandbits(63) - (1 << 62) for _ in range(30)]
    for x in list(h):
        y = x
        for _ in range(r.randint(0, k + 1)):
            y ^= 1 << r.randint(0, 62)
        h.append(y)
    got = {(x.a, x.b, x.distance) for x in dedup.near_pairs(spark.createDataFrame([(x,) for x in h], "simhash long"), k).collect()}
    u = sorted(set(h))
    assert got == {(a, b, apart(a, b)) for i, a in enumerate(u) for b in u[i + 1 :] if apart(a, b) <= k}


def greedy(docs, mode, k):
    seen, kept, out = set(), [], {}
    for path in sorted(docs):
        for pos, b in enumerate(x.strip() for x in docs[path].split("\n\n") if x.strip()):
            out[path, pos] = None
            if len(b.split()) < 10:
                continue
            norm = " ".join(b.lower().split())
            if mode in ("exact", "both"):
                if norm in seen:
                    out[path, pos] = "exact"
                    continue
                seen.add(norm)
            if mode in ("fuzzy", "both"):
                h = simhash(norm)
                if any(apart(h, o) <= k for o in kept):
                    out[path, pos] = "fuzzy"
                    continue
                kept.append(h)
    return out


@pytest.mark.parametrize("mode", ["off", "exact", "fuzzy", "both"])
def test_dedup_is_the_greedy_rule(spark, mode):
    r = random.Random(4)
    base = [[r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(r.choice([4, 12, 40]))] for _ in range(8)]
    docs = {}
    for d in range(14):
        parts = []
        for _ in range(5):
            b = list(r.choice(base))
            if r.random() < 0.5:
                b[r.randrange(len(b))] = "changed"
            parts.append(" ".join(b).upper() if r.random() < 0.2 else "  ".join(b))
        docs[f"{r.randint(0, 3)}/{d:02d}"] = "\n\n".join([*parts, ""])
    df = spark.createDataFrame(list(docs.items()), "rel_path string, text string")
    marked = dedup.deduplicate(df, mode, k=14)
    got = {(x.rel_path, x.pos): x.removed for x in marked.collect()}
    want = greedy(docs, mode, 14)
    assert got == want
    s = dedup.stats(marked).first()
    assert (s.total_blocks, s.removed_exact, s.removed_fuzzy) == (len(want), list(want.values()).count("exact"), list(want.values()).count("fuzzy"))
    texts = {x.rel_path: x.text for x in dedup.texts(marked).collect()}
    for p, t in docs.items():
        own = [x.strip() for x in t.split("\n\n") if x.strip()]
        assert texts[p] == "\n\n".join(b for i, b in enumerate(own) if want[p, i] is None)


def next_fit(sized, most):
    out, cur, held = [], [], 0
    for p, w in sized:
        if w > most:
            if cur:
                out.append(cur)
            out.append([p])
            cur, held = [], 0
        else:
            if cur and held + w > most:
                out.append(cur)
                cur, held = [], 0
            cur.append(p)
            held += w
    return out + [cur] * bool(cur)


def chunks_of(df):
    found = {}
    for r in df.orderBy("chunk_index", "ord").collect():
        found.setdefault(r.chunk_index, []).append(r.rel_path)
    assert sorted(found) == list(range(1, len(found) + 1))
    return [found[i] for i in sorted(found)]


@pytest.mark.parametrize("seed", range(5))
def test_packing_by_size_and_module(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(folds, "RANGE_ROWS", [3, 7, 20, 60, 1000][seed])
    most = r.choice([10, 50, 300])
    files = sorted((f"{r.choice(['', 'Z/', 'a/', 'a/b/', 'é/'])}{i:03d}", r.choice([0, 0, 1, 3, 7, most, most + 1, r.randint(0, most)])) for i in range(150))
    df = spark.createDataFrame(files, "rel_path string, word_count long")
    assert chunks_of(folds.pack_by_size(df, most)) == next_fit(files, most)
    modules = {}
    for p, w in files:
        modules.setdefault(p.rpartition("/")[0] or "_", []).append((p, w))
    want, cur, held = [], [], 0
    for m in sorted(modules):
        total = sum(w for _, w in modules[m])
        if total > most:
            want += [cur] * bool(cur) + next_fit(modules[m], most)
            cur, held = [], 0
            continue
        if cur and held + total > most:
            want.append(cur)
            cur, held = [], 0
        cur = cur + [p for p, _ in modules[m]]
        held += total
    assert chunks_of(folds.pack_by_module(df, most)) == [sorted(c) for c in want + [cur] * bool(cur)]


def balance(files, target, most):
    """Balanced packing, file by file."""
    want, out, held = sum(w for _, w in files) // target, [[]], 0
    for i, (p, w) in enumerate(files):
        if out[-1] and held + w > most and len(out) < target:
            out.append([])
            held = 0
        out[-1].append(p)
        held += w
        if held >= want and len(out) < target and i + 1 < len(files):
            out.append([])
            held = 0
    return out


@pytest.mark.parametrize("seed", range(8))
def test_balanced_packing(spark, monkeypatch, seed):
    r = random.Random(seed)
    files = [(f"{i:03d}", r.choice([0, 0, 1, 3, 7, 40, r.randint(0, 20)])) for i in range(r.choice([30, 90]))]
    target, most = r.choice([1, 3, 9, 20]), r.choice([15, 60, 10_000])
    df = spark.createDataFrame([(1, i + 1, p, w) for i, (p, w) in enumerate(files)], "chunk_index int, ord int, rel_path string, word_count long")
    monkeypatch.setattr(folds, "RANGE_ROWS", [3, 7, 20, 1000][seed % 4])
    assert chunks_of(folds.pack_balanced(df, target, most)) == balance(files, target, most)


@pytest.mark.parametrize("seed", range(200))
def test_ranges_chain(seed):
    """Outcomes of ranges, chained, against one fold over all."""
    r = random.Random(seed)
    words = np.array([r.choice([0, 1, 2, 5, 9, r.randint(0, 30)]) for _ in range(40)])
    rule = folds.Rule(r.choice([5, 12, 30]), r.choice([None, 0, 4, 11, 25]))
    ends = folds._ends(np.array(sorted(r.choice("abcd") for _ in range(40))) if r.random() < 0.5 else np.zeros(40))
    total, after = folds.jumps(words, rule, ends)
    for i in range(40):
        held, j = 0, i
        while j < ends[i] and (j == i or held + words[j] <= rule.most):
            held, j = held + words[j], j + 1
            if rule.want is not None and held >= rule.want:
                break
        assert after[i] == j
    _, count, left, is_open = folds.outcome(words, rule, ends)
    at = [0]
    while at[-1] < 40:
        at.append(int(after[at[-1]]))
    assert count[0] == len(at) - 1 and left[0] == words[at[-2] :].sum() and is_open[0] == rule.takes_all(left[0], 0)


def test_running(spark, monkeypatch):
    monkeypatch.setattr(folds, "RANGE_ROWS", 4)
    rows = [(i * 3, i % 5) for i in range(30)]
    got = sorted(tuple(x) for x in folds.running(spark.createDataFrame(rows, "k int, v long"), "k", "v").collect())
    assert got == [(k, sum(v for x, v in rows if x < k)) for k, _ in rows]


def test_packing_examples(spark):
    three = spark.createDataFrame([(x, 100) for x in "abc"], "rel_path string, word_count long")
    assert chunks_of(folds.pack_by_size(three, 250)) == [["a", "b"], ["c"]]
    assert chunks_of(folds.pack_by_size(three, 100)) == [["a"], ["b"], ["c"]]
    assert folds.pack_by_size(three.limit(0), 10).count() == 0
    t = folds.chunk_totals(folds.pack_by_size(three, 250)).orderBy("chunk_index").collect()
    assert [(x.chunk_id, x.n_files, x.total_words) for x in t] == [("docs_chunk_01", 2, 200), ("docs_chunk_02", 1, 100)]
    hundred = spark.createDataFrame([(f"{i:03d}", 1000) for i in range(100)], "rel_path string, word_count long")
    balanced = chunks_of(folds.pack_balanced(folds.pack_by_size(hundred, 3000), 10, 500_000))
    assert [len(c) for c in balanced] == [10] * 10
    assert len(chunks_of(folds.pack_balanced(folds.pack_by_size(three, 250), 10, 250))) == 3


@pytest.mark.parametrize(
    "pattern,path,hit",
    [
        ("*.png", "a/b.png", 1), ("*.png", "b.pngx", 0), ("temp/", "a/temp/x", 1), ("temp/", "temp", 0), ("/x", "x", 1), ("/x", "a/x", 0),
        ("a/b", "a/b/c", 1), ("a/b", "z/a/b", 0), ("**/t/**", "x/t/y/z", 1), ("**/t/**", "t/y", 1), ("a/**/b", "a/b", 1), ("a/**/b", "a/x/y/b", 1),
        ("f[0-9].md", "f7.md", 1), ("f[!0-9].md", "f7.md", 0), ("?.md", "ab.md", 0), ("404.html", "x/404.html", 1), (r"\#x", "#x", 1), ("a/**", "a", 0), ("doc", "doc/x", 1),
    ],
)
def test_ignore_patterns(spark, pattern, path, hit):
    assert column(spark, path, lambda c: filters.ignored(c, [pattern])) is bool(hit)


def test_filtering(spark):
    files = spark.createDataFrame([(p,) for p in ("a.md", "b.PNG", "c.log", "keep.log", "temp/x.md")], "rel_path string")
    kept = filters.filter_files(files, "# comment\n\n*.log\n!keep.log\n", ("temp/",))
    assert {r.rel_path for r in kept.collect()} == {"a.md", "keep.log"}
    assert "b.PNG" in {r.rel_path for r in filters.filter_files(files, skip_binary=False).collect()}


def test_splitting():
    words = "w " * 49 + "w"
    fence = "```\n" + "c " * 30 + "\n\nmore\n\n```"
    found = split.pieces(f"{words}\n\n{fence}\n\nend", 60)
    assert [p.split()[0] for p, _ in found] == ["w", "```"]
    text = f"{words}\n\n- a\n\n- b\n\n1. c\n\n| x |\n\n| y |\n\n<pre>\n\nz\n\n</pre>\n\n{words}"
    for most in (1, 3, 10, 60, 1000):
        parts = split.pieces(text, most)
        assert "\n\n".join(p for p, _ in parts) == text
        assert all(text[at : at + len(p)] == p for p, at in parts)
    assert split.structural_blocks(text.split("\n\n"))[1:4] == ["- a\n\n- b\n\n1. c", "| x |\n\n| y |", "<pre>\n\nz\n\n</pre>"]
    assert split.pieces("", 5) == split.pieces(None, 5) == [("", 0)] and split.pieces("a b", 0) == [("a b", 0)]
    assert split.structural_blocks(["```a```", "b", "```\nx\n```", "c"]) == ["```a```\n\nb\n\n```\nx\n```", "c"]


def test_breadcrumbs(spark):
    h = [{"level": a, "text": b, "char_offset": c} for a, b, c in ((1, "A", 5), (2, "B", 20), (3, "C", 30), (2, "D", 40), (1, "E", 60))]
    kind = "array<struct<level: int, text: string, char_offset: int>>"
    df = spark.createDataFrame([(h, o, 1 if o == 0 else 2) for o in (0, 4, 5, 35, 45, 99)], f"headings {kind}, char_offset int, sub_ord int")
    assert [r.breadcrumb for r in split.breadcrumbs(df).orderBy("char_offset").collect()] == [["A"], [], ["A"], ["A", "B", "C"], ["A", "D"], ["E"]]


def test_cross_references(spark):
    files = spark.createDataFrame([(1, 1, "a.html", 5), (1, 2, "d/index.html", 5), (2, 1, "b.html", 5)], "chunk_index int, ord int, rel_path string, word_count long")
    found = spark.createDataFrame([("a.html", 0, "b.html", "#x", "B"), ("a.html", 1, "d", "", "D"), ("b.html", 0, "none", "", "N"), ("lost.html", 0, "a.html", "", "A")], "source_path string, ord int, target_path string, anchor string, link_text string")
    e = links.resolve(found, links.file_to_chunk(files))
    a = {r.chunk_id: r for r in links.adjacency(e).collect()}
    assert a["docs_chunk_01"].references_to == ["docs_chunk_02", "docs_chunk_01"] and a["docs_chunk_02"].referenced_by == ["docs_chunk_01"]
    assert a["docs_chunk_02"].references_to == [] and len(a["docs_chunk_01"]["links"]) == 2
    assert [r.target_path for r in links.unresolved(e).collect()] == ["none"]
    marks = [{"link_text": a, "target_chunk": b} for a, b in (("x", "c1"), ("x", "c2"), ("", "c3"), ("zz", "c4"), ("y", None), ("y", "c5"))]
    df = spark.createDataFrame([("x y x", marks)], "t string, m array<struct<link_text: string, target_chunk: string>>")
    assert df.select(links.annotate(F.col("t"), F.col("m"))).first()[0] == "x [-> c1] y [-> c5] x"


MANIFEST = "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double"


def test_manifests(spark):
    old = spark.createDataFrame([("a", "u", 1, "e", "l", "a", 1.0), ("b", "u", 1, "e", "l", "b", 1.0), ("c", "u", 1, "e", "l", "c", 1.0), ("d", "u", 1, "e", "l", "d", 1.0)], MANIFEST)
    new = spark.createDataFrame([("a", "v", 1, None, None, "a", 1.0), ("b", "v", 2, None, None, "b", 1.0), ("c", "v", 1, None, None, "c", 2.0), ("n", "v", 1, None, None, "n", 1.0)], MANIFEST)
    assert {r.key: r.status for r in delta.diff(old, new).collect()} == {"a": "same", "b": "modified", "c": "modified", "d": "removed", "n": "added"}
    assert {r.key: r.etag for r in delta.merge(old, new).collect()} == {"a": "e", "b": None, "c": "e", "n": None}
    files = spark.createDataFrame([("h.io/x/a.html", 3, 1.5), ("h.io", 1, 1.0), ("z.md", 2, 1.0)], "rel_path string, size_bytes long, mtime double")
    got = {r.key: r.url for r in delta.build_manifest(files, "https://h.io/docs/").collect()}
    assert got == {"x/a.html": "https://h.io/docs/x/a.html", "h.io": "https://h.io/docs", "z.md": "https://h.io/docs/z.md"}


@pytest.mark.parametrize(
    "url,depth,ok",
    [
        ("https://h.io/docs/a", 0, 1), ("http://h.io/docs", 0, 1), ("https://h.io/docsextra", 0, 0), ("https://x.io/docs/a", 0, 0), ("ftp://h.io/docs/a", 0, 0),
        ("https://h.io/docs/a/b", 1, 0), ("https://h.io/docs/a?q=/b/c", 1, 1), ("https://h.io/docs/a/", 1, 1), ("mailto:x", 0, 0), ("", 0, 0),
    ],
)
def test_scope(spark, url, depth, ok):
    assert column(spark, url, lambda c: T.in_scope(c, F.lit("https://h.io/docs/"), depth)) is bool(ok)


def test_discovery(spark):
    body = "# c\n- [a](https://h/a) and [b](http://h/b)\nhttps://h/c tail\n\n[a](https://h/a)\nsee https://h/no\n[r](/rel)"
    got = discovery.llms_urls(spark.createDataFrame([("s", body)], "site string, body string")).orderBy("ord").collect()
    assert [r.url for r in got] == ["https://h/a", "http://h/b", "https://h/c"]
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = spark.createDataFrame(
        [
            ("http://h/s.xml", f"<sitemapindex {ns}><sitemap><loc> http://h/1.xml </loc></sitemap><sitemap><loc>http://h/s.xml</loc></sitemap><sitemap><loc>http://cdn/docs/2.xml</loc></sitemap><sitemap><loc>http://cdn/o/3.xml</loc></sitemap></sitemapindex>"),
            ("http://h/1.xml", f"<urlset {ns}><url><loc>http://h/docs/a</loc></url><url><loc> </loc></url></urlset>"),
            ("http://cdn/docs/2.xml", f"<urlset {ns}><url><loc>http://h/docs/b</loc></url></urlset>"),
            ("http://cdn/o/3.xml", f"<urlset {ns}><url><loc>http://h/docs/no</loc></url></urlset>"),
        ],
        "url string, body string",
    )
    assert {r.url for r in discovery.walk_sitemaps(maps, "http://h/s.xml", "http://h/docs/").collect()} == {"http://h/docs/a", "http://h/docs/b"}
    layers = spark.createDataFrame([(1, i, f"http://h/docs/{i}") for i in range(2)] + [(2, i, f"http://h/docs/{i}") for i in range(4)], "layer int, ord int, url string")
    assert {r.layer for r in discovery.cascade(layers, "http://h/docs/").collect()} == {2}
    assert discovery.cascade(layers, "http://other/").count() == 0
    import gzip

    packed = spark.createDataFrame([(gzip.compress(b"x"),), (b"y",), (b"\x1f\x8bbad",), (None,)], "b binary")
    assert [r[0] for r in packed.select(discovery.unpacked("b")).collect()] == ["x", "y", None, None]
    served = {"https://h/llms-full.txt": b"https://h/x"}
    assert discovery.fetch_first(served.get, "https://h/docs", discovery.LLMS_FILES, bool) == ("https://h/llms-full.txt", b"https://h/x")


def test_manifest_files(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"base_url": "b", "files": {"k": {"url": "u", "size_bytes": 3, "unknown": 1}}}')
    assert [tuple(r) for r in discovery.load_manifest(spark, str(p)).collect()] == [("k", "u", 3, None, None, None, None)]
    p.write_text("not json")
    assert discovery.load_manifest(spark, str(p)).count() == 0
    assert discovery.load_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_shells(spark):
    pages = spark.createDataFrame([(f"p{i}.html", f"<body>{'x' * n}</body>") for i, n in enumerate((10, 500, 199, 200))] + [("q.txt", "<body></body>")], "rel_path string, content string")
    found = spa.shells(parse_pages(pages))
    assert {r.rel_path: r.shell for r in found.collect()} == {"p0.html": True, "p1.html": False, "p2.html": True, "p3.html": False}
    assert spa.is_spa(found).first().spa is True
    assert spa.is_spa(found.limit(0)).first().spa is False


def test_scores(spark):
    kind = "array<struct<level: int, text: string, char_offset: int>>"
    docs = spark.createDataFrame([("a", 100, 50, [(2, "t", 1)], "x ```"), ("b", 0, 0, None, "y <pre> </PRE>"), ("c", 10, 10, [], "z")], f"rel_path string, raw_words long, extracted_words long, headings {kind}, text string")
    files = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 0), (2, 1, "c", 10)], "chunk_index int, ord int, rel_path string, word_count long")
    got = score.chunk_scores(files, docs).orderBy("chunk_index").collect()
    assert [(r.noise_ratio, r.boundary_integrity, r.context_depth, round(r.score, 6), r.grade) for r in got] == [(0.5, False, 2, 0.5, "B"), (0.0, True, 0, 0.7, "B")]
    assert score.chunk_scores(files, docs, with_text=False).where("boundary_integrity").count() == 2


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "<|endoftext|>")], "k int, text string")
    got = {r.k: (r.words, r.tokens) for r in tokens.token_counts(df).collect()}
    assert got[1] == (2, 2) and got[2] == got[3] == (0, 0) and got[4][1] > 1
    for e in ("word_bpe_49k", "piece_bpe_32k"):
        assert tokens.token_counts(df, e).where("k = 1").first().tokens > 0
    with pytest.raises(ValueError):
        tokens.encoder("no such encoding")
    s = tokens.summary(spark.createDataFrame([(3,), (4,)], "tokens long")).first()
    assert tuple(s) == (7, 3, 3, 4)


def test_report(spark):
    docs = spark.createDataFrame([(f"dir/{'n' * 50}{i:02d}", 100, 100 - i) for i in range(15)], "rel_path string, raw_words long, extracted_words long")
    stats = report.file_stats(docs)
    top = report.top_files(stats).collect()
    assert len(top) == 10 and top[0].words == 100 and top[0].removed is None and top[1].removed == 1
    assert top[0].name.startswith("...") and len(top[0].name) == 40
    text = report.dry_run(stats, 3, 95, 50, "size", 17, 2)
    assert "2 excluded, 15 processed" in text and "5 files exceed" in text and "~465 words a chunk" in text


def test_options():
    o = load_options('{"pack": {"max-chunks": 9, "prefix": "p", "other": 1}}', prefix="q")
    assert (o.max_chunks, o.prefix) == (9, "q")
    assert PackOptions(bundle="notebooklm", max_words_per_chunk=900_000, max_chunks=80).preset().max_words_per_chunk == 500_000
    assert PackOptions(bundle="rag-standard").preset() == PackOptions(bundle="rag-standard")
    for bad in ({"format": "xml"}, {"strategy": "x"}, {"dedup": "x"}, {"bundle": "x"}):
        with pytest.raises(ValueError):
            PackOptions(**bad)
    with pytest.raises(ValueError, match="line 1"):
        load_options("{bad")


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT strip_html('<p>a</p>b'), strip_html(extract_content('<nav>x</nav><main>y</main>'))").first()[:] == ("a\n\nb", "y")
