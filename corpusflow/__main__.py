"""``python -m corpusflow pack|sync TREE -o FOLDER`` and ``download|sync URL -o
FOLDER``: the plans as commands."""

from __future__ import annotations

import argparse
import json
import logging
import os
import shutil
import sys
import uuid

from . import options as O

LOG = logging.getLogger("corpusflow")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusflow", description="Turn a tree of pages and texts into chunks.")
    said = top.add_mutually_exclusive_group()
    said.add_argument("-v", "--verbose", action="store_true", help="say more")
    said.add_argument("-q", "--quiet", action="store_true", help="say nothing but errors")
    top.add_argument("--config", help="JSON file with a section per command")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("pack", "pack all files"), ("sync", "pack what changed since the last run")):
        c = commands.add_parser(name, help=text)
        c.add_argument("tree")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--max-words-per-chunk", type=int)
        c.add_argument("--max-chunks", type=int)
        c.add_argument("--strategy", choices=O.STRATEGIES)
        c.add_argument("--format", choices=O.FORMATS)
        c.add_argument("--dedup", choices=O.DEDUP)
        c.add_argument("--dedup-threshold", type=int)
        c.add_argument("--bundle", choices=O.PRESETS)
        c.add_argument("--prefix")
        c.add_argument("--delimiter")
        c.add_argument("--token-encoding")
        c.add_argument("--ignore", action="append")
        c.add_argument("--ignore-file")
        c.add_argument("--manifest")
        c.add_argument("--base-url", default="")
        c.add_argument("--no-index", dest="with_index", action="store_false", default=None)
        if name == "sync":
            _fetching(c)
            c.add_argument("--chunks-dir", help="of a URL: where the chunks go (the folder's chunks, by default)")
        for flag in ("no-extract", "show-tokens", "dry-run", "context-header", "cross-refs", "score", "legacy-headers", "delta"):
            c.add_argument(f"--{flag}", action="store_true", default=None)
    c = commands.add_parser("download", help="fetch a site")
    c.add_argument("tree", metavar="url")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--manifest")
    _fetching(c)
    return top


def _fetching(c: argparse.ArgumentParser) -> None:
    c.add_argument("--depth", type=int, default=0, help="steps from the URL at most (0: any)")
    c.add_argument("--delay", type=int, default=0, help="milliseconds between two fetches of a host")
    c.add_argument("--include-extensions", default="html,md,txt")
    c.add_argument("--fetcher", help="module:name of a function (url, etag, last_modified) -> Response, in place of HTTP")
    c.add_argument("--renderer", help="the same, of one that runs a page's scripts")


def main(given: list[str] | None = None, spark=None) -> int:
    a = arguments().parse_args(given)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(message)s", stream=sys.stderr)
    try:
        return run(a, spark)
    except (ValueError, OSError) as e:
        LOG.error("%s", e)
        return 1


def run(a: argparse.Namespace, spark=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import pack as P
    from .plans.sync import sync
    from .sinks import render
    from .sinks.files import replace_file
    from .sources.discovery import load_manifest, save_manifest
    from .sources.doctree import read_tree
    from .tables import durable

    config = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = f.read()
    own = {k: v for k, v in vars(a).items() if k in O.PackOptions.__dataclass_fields__}
    o = O.load_options(config, a.command, **own)
    ignore = None
    if getattr(a, "ignore_file", None):
        with open(a.ignore_file, encoding="utf-8") as f:
            ignore = f.read()
    spark = spark or SparkSession.builder.getOrCreate()
    fetched = False
    if "://" in a.tree and a.tree.split("://")[0] in ("http", "https") and a.command != "pack":
        fetch_site(a, spark)
        if a.command == "download":
            return 0
        a.base_url, a.tree, a.output, fetched = "", a.output, a.chunks_dir or os.path.join(a.output, "chunks"), True
        os.makedirs(a.output, exist_ok=True)
    files = read_tree(spark, os.path.abspath(a.tree) if "://" not in a.tree else a.tree)
    if fetched:  # neither the pages' table nor the chunks of the last run are the site's
        files = files.where(~F.startswith("rel_path", F.lit(".")) & ~F.startswith("rel_path", F.lit(os.path.relpath(a.output, a.tree) + "/")))
    manifest = None
    if a.manifest and os.path.exists(a.manifest):  # a table: the file is replaced before the changes are told
        manifest = durable(load_manifest(spark, os.path.abspath(a.manifest)), "manifest-before")
    if a.command == "sync":
        done = sync(files, o, manifest, a.base_url)
        packed = done.packed
        print("\n".join(f"{k}: {v}" for k, v in done.summary.items()))
        if a.manifest:
            save_manifest(done.manifest, os.path.abspath(a.manifest), a.base_url)
    else:
        packed = P.pack(files, o, ignore, manifest)
    if o.dry_run:
        print(P.dry_run_report(packed, files.count()))
        return 0
    if packed.totals.isEmpty():
        LOG.warning("nothing to pack")
        return 0
    written = P.write(packed, a.output)
    LOG.info("%d files written", written.count())
    side = {}
    if packed.scores is not None:
        side["llm-readiness.json"] = render.readiness_json(packed.scores)
    if packed.adjacency is not None:
        replace_file(os.path.join(os.path.abspath(a.output), "cross_refs.json"), render.cross_refs_lines(packed.edges))
    if packed.diff is not None:
        side["delta_manifest.json"] = render.delta_json(packed.diff, packed.chunk_files, prefix=packed.options.prefix)
    if packed.options.show_tokens:
        for r in packed.tokens.orderBy("chunk_index").toLocalIterator():  # a row per chunk
            print(f"{r['name']}: {r['words']:,} words, {r['tokens']:,} tokens")
    if packed.options.bundle:
        side["IMPORT_GUIDE.md"] = render.import_guide(packed.totals, packed.chunk_files, packed.docs, packed.options.bundle, packed.options.format)
    for name, body in side.items():
        replace_file(os.path.join(os.path.abspath(a.output), name), iter([body]))
    print(json.dumps(P.report.pack_summary(packed.totals, files.count() - packed.docs.count(), packed.options.max_chunks, packed.options.max_words_per_chunk)))
    return 0


def fetch_site(a: argparse.Namespace, spark) -> None:
    """The site as files of the folder, and its pages as a table beside them,
    whose validators the next run sends along."""
    from importlib import import_module

    from pyspark.sql import functions as F

    from .plans.crawl import CrawlOptions
    from .plans.download import as_files, download
    from .sinks.files import write_files
    from .sources.fetch import by_host, http_get

    def named(spec: str | None):
        if not spec:
            return None
        module, _, name = spec.partition(":")
        return by_host(getattr(import_module(module), name), delay=a.delay / 1000)

    folder = os.path.abspath(a.output)
    os.makedirs(folder, exist_ok=True)
    table = os.path.join(folder, ".pages")
    previous = spark.read.parquet(table) if os.path.exists(os.path.join(table, "_SUCCESS")) else None
    options = CrawlOptions(depth=a.depth, include=tuple(x.strip() for x in a.include_extensions.split(",") if x.strip()))
    got = download(spark, a.tree, named(a.fetcher) or by_host(http_get, delay=a.delay / 1000), options=options, previous=previous, render=named(a.renderer), scope_depth=a.depth, log=LOG.info)
    fresh_files = as_files(got.pages.where(~F.col("unchanged")))  # others keep their time
    write_files(fresh_files.select(F.col("rel_path").alias("name"), F.col("content").alias("body")), folder)
    fresh = os.path.join(folder, f".pages-{uuid.uuid4().hex}")
    got.pages.where(F.col("body").isNotNull()).select("url", "etag", "last_modified", "body").write.parquet(fresh)
    if os.path.exists(table):
        os.rename(table, f"{fresh}-old")
    os.rename(fresh, table)
    shutil.rmtree(f"{fresh}-old", ignore_errors=True)
    if a.manifest and a.command == "download":
        from .sources.discovery import save_manifest

        save_manifest(got.manifest, os.path.abspath(a.manifest), a.tree)
    print("\n".join(f"{k}: {v}" for k, v in got.summary.items()))


if __name__ == "__main__":
    sys.exit(main())
