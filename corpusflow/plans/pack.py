"""The packing run: files to chunks, as one lazy plan with few tables between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import parse_pages
from ..operators import dedup, delta, filters, folds, links, report, score, tokens
from ..options import PackOptions
from ..sinks import render
from ..tables import durable


@dataclass
class Packed:
    """Tables of a run; those that were not asked for are None."""

    options: PackOptions
    docs: DataFrame
    chunk_files: DataFrame
    totals: DataFrame
    diff: DataFrame | None = None
    dedup_stats: DataFrame | None = None
    scores: DataFrame | None = None
    edges: DataFrame | None = None
    adjacency: DataFrame | None = None
    parts: DataFrame | None = None
    bodies: DataFrame | None = None
    tokens: DataFrame | None = None


def document_table(files: DataFrame, extract: bool = True) -> DataFrame:
    """files (rel_path, content, ...) to (rel_path, text, raw_words,
    extracted_words, headings, links, body_chars, app_root); pages are parsed,
    all else is text as it is.  Path tests come before any parse."""
    html = T.is_html(F.col("rel_path"))
    pages = parse_pages(files.where(html).select("rel_path", "content"), extract).drop("failed")
    n = T.word_count(F.col("content"))
    empty = {c: F.lit(None).cast(t) for c, t in pages.dtypes}
    plain = files.where(~html).select("rel_path", F.coalesce("content", F.lit("")).alias("text"), n.alias("raw_words"), n.alias("extracted_words"), *[empty[c].alias(c) for c in ("headings", "links", "body_chars", "app_root")])
    return pages.unionByName(plain)


def pack(files: DataFrame, options: PackOptions, ignore_file: str | None = None, manifest: DataFrame | None = None, total_chunks: bool = True) -> Packed:
    """Filter, delta, deduplicate, pack, score, link and render."""
    o = options.preset()
    chosen = filters.filter_files(files, ignore_file, o.ignore)
    changes = None
    if o.delta:
        old = manifest if manifest is not None else chosen.sparkSession.createDataFrame([], "key string, url string, size_bytes long, etag string, last_modified string, local_path string, mtime double")
        changes = delta.diff(old, delta.build_manifest(chosen))
        chosen = filters.changed_only(chosen, changes)
    docs = durable(document_table(chosen, not o.no_extract), "docs")
    removed = None
    if o.dedup != "off":
        marked = durable(dedup.deduplicate(docs, o.dedup, o.dedup_threshold, o.delimiter), "dedup")
        removed = dedup.stats(marked)
        left = dedup.texts(marked).withColumnRenamed("text", "_left")
        docs = docs.join(left, "rel_path", "left").withColumn("text", F.coalesce("_left", F.lit(""))).drop("_left")
        docs = durable(docs.withColumn("words_after_dedup", T.word_count(F.col("text"))), "docs")
    words = F.coalesce(F.col("words_after_dedup"), F.col("extracted_words")) if o.dedup != "off" else F.col("extracted_words")
    sized = docs.select("rel_path", words.alias("word_count"))
    chunk_files = (folds.pack_by_module if o.strategy == "semantic" else folds.pack_by_size)(sized, o.max_words_per_chunk)
    if o.bundle == "notebooklm":
        chunk_files = folds.pack_balanced(durable(chunk_files, "chunk-files"), o.max_chunks, o.max_words_per_chunk)
    chunk_files = durable(chunk_files, "chunk-files")
    out = Packed(o, docs, chunk_files, folds.chunk_totals(chunk_files, o.prefix), changes, removed)
    if o.score:
        out.scores = score.chunk_scores(chunk_files, docs, o.prefix, with_text=not o.dry_run)
    if o.dry_run:
        return out
    if o.cross_refs:
        out.edges = links.resolve(links.links(docs), links.file_to_chunk(chunk_files, o.prefix))
        out.adjacency = links.adjacency(out.edges)
    context = o.context_header or (o.score and o.legacy_headers)
    urls = delta.url_map(docs, manifest) if manifest is not None else None
    out.parts = render.parts(chunk_files, docs, o.max_words_per_chunk, urls, out.scores, context)
    out.bodies = render.bodies(out.parts, o.format, o.with_index, o.header_tag, o.prefix, context=context)
    if out.edges is not None:
        marks = out.edges.where(F.col("target_chunk").isNotNull()).join(chunk_files.select(F.col("rel_path").alias("source_path"), "chunk_index", F.col("ord").alias("file")), "source_path")
        marks = marks.groupBy("chunk_index").agg(F.array_sort(F.collect_list(F.struct("file", "ord", "link_text", "target_chunk"))).alias("marks"))
        out.bodies = links.annotate_chunks(out.bodies.join(marks, "chunk_index", "left"))
    if o.show_tokens:
        out.tokens = tokens.token_counts(out.bodies.select("chunk_index", "name", F.col("body").alias("text")), o.token_encoding)
    return out


def write(packed: Packed, folder: str) -> DataFrame:
    """Write the chunk files; returns (name, bytes)."""
    if packed.bodies is None:
        raise ValueError("a dry run has nothing to write")
    return render.write(packed.bodies, folder)


def dry_run_report(packed: Packed, found: int) -> str:
    o = packed.options
    stats = report.file_stats(packed.docs)
    kept = packed.docs.count()
    return report.dry_run(stats, packed.totals.count(), o.max_words_per_chunk, o.max_chunks, o.strategy, found, found - kept, packed.dedup_stats, packed.scores)
